"""Scans and sinks.

Every reader returns a DataFrame whose float/double NaN values are already
NULL (decision D2: pandas skips NaN as missing, Spark does not), so the
profiling aggregates downstream treat both as one concept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens pandas.read_csv treats as missing by default.
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every float/double column; other columns untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def spread_small(df: DataFrame) -> DataFrame:
    """A file written as one row group is read by one task whatever its size.
    When the scan has fewer input partitions than the cluster has cores, a
    round-robin repartition over the default parallelism lets the CPU-heavy
    first stage (tokenising, exploding, partial aggregation) use every core.
    A large input is already read by many tasks and is left alone - a full
    shuffle would only cost. (Planning only; no job runs.)"""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def read_parquet(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """Parquet scan (S2). Filters and projections applied later reach the scan."""
    df = spark.read.parquet(path)
    return normalise_missing(df) if normalise else df


def read_table(spark: SparkSession, sf_dir: str, name: str, normalise: bool = True,
               spread: bool = False) -> DataFrame:
    """One test table; ``spread=True`` spreads a table read by fewer tasks than
    there are cores (:func:`spread_small`) before CPU-heavy per-row work such as
    tokenising."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        df = spread_small(df)
    return normalise_missing(df) if normalise else df


def _quotes(line):
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, record): the records of csv files whose quoted values may hold newlines.

    ``multiLine`` would make every file one task. Here files are split as text: a line starts inside
    a quoted value if the quotes before it in the file are odd in number (a quote written twice
    counts two). Each split adds up its quotes; the sums of the splits before (a row per split) tell
    how it starts. Lines that start outside and hold an even number of quotes are records as they
    are; only the lines of the others are shuffled and put together, each to the last line before it
    that starts outside. A file that ends inside a quote gives its rest as one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    # Rows of a split come in file order, so ``at`` orders them; splits of a file are ordered by ``block``.
    in_split = Window.partitionBy("file", "block").orderBy("at")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("odd", _quotes(F.col("line")) % 2)
    lines = lines.withColumn("run", F.coalesce(F.sum("odd").over(before), F.lit(0)))
    splits = lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias("base"))
    same = (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))
    lines = lines.join(splits, same).drop("f", "b").withColumn("inside", (F.col("base") + F.col("run")) % 2 == 1)
    alone = lines.where(~F.col("inside") & (F.col("odd") == 0)).select("file", "block", "at", F.col("line").alias("record"))
    # Lines of longer records, led by one that starts outside and holds an odd number of quotes.
    parts = lines.where(F.col("inside") | (F.col("odd") == 1))
    heads = parts.where(~F.col("inside"))
    last = heads.groupBy(F.col("file").alias("f"), F.col("block").alias("b")).agg(F.max(F.struct("block", "at")).alias("last"))
    every = splits.join(last, ["f", "b"], "left")
    carried = every.select("f", "b", F.last("last", ignorenulls=True).over(
        Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    head = F.max(F.when(~F.col("inside"), F.struct("block", "at"))).over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    owned = parts.withColumn("own", head).join(carried, same).withColumn("head", F.coalesce("own", "carried"))
    joined = owned.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("ls"))
    long = joined.select("file", F.col("head.block").alias("block"), F.col("head.at").alias("at"), F.array_join(F.col("ls.line"), "\n").alias("record"))
    return alone.unionByName(long)


def _csv_rows(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """All columns of csv files as strings, the names from their header."""
    odd = spark.read.option("lineSep", "\n").text(path).where(_quotes(F.col("value")) % 2 == 1)
    plain = spark.read.option("header", True).option("inferSchema", False).option("sep", delimiter).option("escape", '"')
    if odd.isEmpty():  # no quoted value goes on in another line
        return plain.csv(path)
    records = csv_records(spark, path).where("trim(record) != ''")
    first = records.groupBy("file").agg(F.min(F.struct("block", "at", "record")).alias("first"))  # a row per file
    header = first.orderBy("file").select("first.record").first()["record"].rstrip("\r")
    import csv
    names = next(csv.reader([header], delimiter=delimiter))
    schema = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    body = records.join(first.select("file", F.col("first.block").alias("b"), F.col("first.at").alias("a")), "file").where(
        (F.col("block") != F.col("b")) | (F.col("at") != F.col("a")))
    options = {"sep": delimiter, "escape": '"', "multiLine": "true"}
    parsed = F.from_csv(F.regexp_replace("record", "\r$", ""), F.lit(schema.toDDL()), options)
    return body.select(parsed.alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, na_tokens=None, delimiter: str = ",") -> DataFrame:
    """CSV scan with type inference.

    Spark's ``nullValue`` takes one token, so every column is read as string,
    the pandas missing-token list is mapped to NULL, and each column is cast
    to the narrowest of bigint / double / timestamp / boolean whose
    ``try_cast`` fails on no non-null value (one aggregation job for all
    columns), else kept as string. Only the words true and false make a boolean
    column, and only values with a date make a timestamp column; a quote inside a
    quoted value is written twice. Quoted values may hold newlines (:func:`csv_records`).
    """
    na = list(CSV_NA_TOKENS if na_tokens is None else na_tokens)
    raw = _csv_rows(spark, path, delimiter)
    cleaned = raw.select(*[
        F.when(~F.col(f"`{c}`").isin(na), F.col(f"`{c}`")).alias(c) for c in raw.columns
    ])
    candidates = [("bigint", T.LongType()), ("double", T.DoubleType()),
                  ("timestamp", T.TimestampType()), ("boolean", T.BooleanType())]
    checks = []
    for c in cleaned.columns:
        col = F.col(f"`{c}`")
        for name, _ in candidates:
            fits = F.expr(f"try_cast(`{c}` as {name})").isNotNull()
            if name == "boolean":
                fits &= F.lower(F.trim(col)).isin("true", "false")
            elif name == "timestamp":
                fits &= F.trim(col).rlike(r"^[+-]?\d{4,}-\d")
            bad = F.sum(F.when(col.isNotNull() & ~fits, 1).otherwise(0))
            checks.append(bad.alias(f"{c}\u0001{name}"))
    if not checks:
        return cleaned
    bad_counts = cleaned.agg(*checks).first().asDict()
    out = []
    for c in cleaned.columns:
        chosen = None
        for name, _ in candidates:
            if (bad_counts[f"{c}\u0001{name}"] or 0) == 0:
                chosen = name
                break
        if chosen is None:
            out.append(F.col(f"`{c}`"))
        else:
            out.append(F.expr(f"try_cast(`{c}` as {chosen})").alias(c))
    return normalise_missing(cleaned.select(*out))


# Suffixes by the way they are read.
SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".txt": "text"}


def path_listing(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, files) under ``path`` (recursive), listed by Spark; file contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path"))
    return (files.select(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))
            .groupBy("suffix").agg(F.count(F.lit(1)).alias("files")))


# Suffixes that count as texts when a folder or file is told by its names.
TEXT_SUFFIXES = [".txt", ".json", ".jsonl"]


def path_suffix(path: str) -> str:
    """Lower-cased suffix of the last part of a path, also of a table that Spark wrote as a folder."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""


def path_modality(spark: SparkSession, path: str) -> str:
    """``vision`` for an image or a folder that holds one, ``nlp`` for a text file or a folder where
    over half of the files are, else ``tabular`` (to be refined by the columns)."""
    from .images import IMAGE_EXTENSIONS
    suffix = path_suffix(path)
    if suffix in IMAGE_EXTENSIONS:
        return "vision"
    if suffix in TEXT_SUFFIXES:
        return "nlp"
    if suffix in SUFFIXES:
        return "tabular"
    counts = {r["suffix"]: r["files"] for r in path_listing(spark, path).collect()}
    if any(counts.get(x) for x in IMAGE_EXTENSIONS):
        return "vision"
    texts = sum(counts.get(x, 0) for x in TEXT_SUFFIXES)
    return "nlp" if texts * 2 > sum(counts.values()) else "tabular"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per text file of a folder, whole, whatever lies deeper."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(TEXT_SUFFIXES))


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """A table by the suffix of its path (csv, tsv, parquet, json, jsonl, txt)."""
    name = path.rstrip("/").lower()
    kind = next((k for x, k in SUFFIXES.items() if name.endswith(x)), None)
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, delimiter="\t" if kind == "tsv" else ",")
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind in ("json", "jsonl"):
        return normalise_missing(spark.read.option("multiLine", kind == "json").json(path))
    if kind == "text":
        return read_text_lines(spark, path)
    raise ValueError(f"unknown suffix: {path}")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text-line scan (S3): one row per line in column ``text``.

    Departure: the trailing newline the reference keeps is not counted.
    """
    return spark.read.text(path).withColumnRenamed("value", "text")


def head(df: DataFrame, n: int = 100) -> DataFrame:
    """Head scan used by detection."""
    return df.limit(n)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet sink."""
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV sink with header."""
    df.write.mode(mode).option("header", True).csv(path)


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test fixture: ``events`` with missing values and duplicate rows added.

    value -> NULL where event_id % 17 = 0, NaN where event_id % 29 = 0;
    event_type -> NULL where event_id % 23 = 0; rows with event_id % 50 = 0
    appear twice. Only builds input rows; NaN is left in place so the
    profiling operators' own normalisation is exercised.
    """
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    eid = F.col("event_id")
    dirty = ev.select(
        "event_id", "ts", "user_id",
        F.when(eid % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid % 17 == 0, F.lit(None).cast("double"))
         .when(eid % 29 == 0, F.lit(float("nan")))
         .otherwise(F.col("value")).alias("value"),
        "props",
    )
    return dirty.unionByName(dirty.where(eid % 50 == 0))


DIRTY_EVENTS_SQL = """(
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 17 = 0 THEN NULL
              WHEN event_id % 29 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value,
         props
  FROM events
  UNION ALL
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 17 = 0 THEN NULL
              WHEN event_id % 29 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value,
         props
  FROM events WHERE event_id % 50 = 0
)"""

# The same view with NaN already mapped to NULL, as the Spark scan normalises.
DIRTY_EVENTS_NORM_SQL = f"""(
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN isnan(value) THEN NULL ELSE value END AS value, props
  FROM {DIRTY_EVENTS_SQL}
)"""
