"""Image-folder sources.

Files are listed once with the ``binaryFile`` source (recursive) and filtered on the lower-cased
extension; the class is the first folder below the root. Width, height and mode are read from the
bytes of the file header, as column expressions: nothing is decoded and no Python worker runs. The
format is told by the header's signature, not by the extension:

* PNG, GIF, BMP and WebP hold their size at fixed places;
* JPEG is a chain of segments, followed by their lengths to the frame header;
* TIFF holds its size in the entries of its first directory, wherever that lies in the file.

``status`` is ``ok``; ``truncated`` where the file ends before its size; ``corrupt`` where the
header contradicts itself (an unknown signature, a size of 0, a segment that cannot be); a file that
is not ``ok`` has NULL width, height, channels and mode. Files of 0 bytes have no partition in Spark's
scan and are not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions that count as images.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp"]
# Image mode names and their channels.
MODES = {"1": 1, "L": 1, "P": 1, "I;16": 1, "LA": 2, "RGB": 3, "RGBA": 4, "CMYK": 4}
MAX_SEGMENTS = 4096  # JPEG segments before the frame header; a file with more is corrupt
MAX_ENTRIES = 4096   # entries of a TIFF directory; more cannot be


def _ext(path_col):
    return F.lower(F.regexp_extract(path_col, r"(\.[^./]+)$", 1))


def _listing(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(_ext(F.col("path")).isin(IMAGE_EXTENSIONS))


def _file_columns(root: str) -> list[Column]:
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _regex_escape(root.rstrip("/")) + "/", "")
    cls = F.when(F.instr(rel, "/") > 0, F.substring_index(rel, "/", 1))
    return [_norm_path(F.col("path")).alias("path"), cls.alias("class"),
            F.upper(F.regexp_replace(_ext(F.col("path")), r"^\.", "")).alias("format"), F.col("length")]


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, class, format, length) for every image file below ``root`` (S5); contents are not read."""
    return _listing(spark, root).select(*_file_columns(root))


def _norm_path(col):
    """file:/x and file:///x name the same file."""
    return F.regexp_replace(col, r"^file:/+", "file:/")


def _regex_escape(s: str) -> str:
    import re
    return re.escape(s)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.transform(F.array(value), body)[0]


def _number(data: Column, at: Column, n: int, little=False) -> Column:
    """Unsigned number of ``n`` bytes at the 0-based place ``at``; NULL where the file is too short.
    ``little``: little-endian, as a bool or a column."""
    def of(raw: Column) -> Column:
        turned = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(n))])
        text = turned if little is True else raw if little is False else F.when(little, turned).otherwise(raw)
        return F.when(F.length(raw) == 2 * n, F.conv(text, 16, 10).cast("bigint"))

    return _let(at, lambda i: F.when((i >= 0) & (i < F.length(data)), _let(F.hex(F.substring(data, (i + 1).cast("int"), F.lit(n))), of)))


def _is(data: Column, at: int, *signatures: bytes) -> Column:
    return F.hex(F.substring(data, at + 1, len(signatures[0]))).isin([x.hex().upper() for x in signatures])


def _size(width: Column, height: Column, mode: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), mode.alias("mode"))


def _png(data: Column) -> Column:
    at = lambda i, n: _number(data, F.lit(i), n)
    depth, kind = at(24, 1), at(25, 1)
    grey = F.when(depth == 1, "1").when(depth == 16, "I;16").otherwise("L")
    mode = F.when(kind == 0, grey).when(kind == 2, "RGB").when(kind == 3, "P").when(kind == 4, "LA").when(kind == 6, "RGBA")
    return F.when(_is(data, 12, b"IHDR"), _size(at(16, 4), at(20, 4), mode))


def _gif(data: Column) -> Column:
    return _size(_number(data, F.lit(6), 2, True), _number(data, F.lit(8), 2, True), F.lit("P"))


def _bmp(data: Column) -> Column:
    at = lambda i, n: _number(data, F.lit(i), n, True)
    old = at(14, 4) == 12  # the oldest header has 16-bit sizes
    signed = lambda x: F.abs(F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))  # a negative height: rows from the top
    bits = F.when(old, at(24, 2)).otherwise(at(28, 2))
    mode = F.when(bits == 1, "1").when(bits.isin(4, 8), "P").when(bits.isin(16, 24), "RGB").when(bits == 32, "RGBA")
    return _size(F.when(old, at(18, 2)).otherwise(signed(at(18, 4))), F.when(old, at(20, 2)).otherwise(signed(at(22, 4))), mode)


def _webp(data: Column) -> Column:
    at = lambda i, n: _number(data, F.lit(i), n, True)
    low = lambda x: x.bitwiseAND(F.lit(0x3FFF))
    packed = at(21, 4)
    lossless = _size(low(packed) + 1, low(F.shiftright(packed, 14)) + 1,
                     F.when(F.shiftright(packed, 28).bitwiseAND(F.lit(1)) == 1, "RGBA").otherwise("RGB"))
    extended = _size(at(24, 3) + 1, at(27, 3) + 1, F.when(at(20, 1).bitwiseAND(F.lit(16)) > 0, "RGBA").otherwise("RGB"))
    return (F.when(_is(data, 12, b"VP8 ") & _is(data, 23, b"\x9d\x01\x2a"), _size(low(at(26, 2)), low(at(28, 2)), F.lit("RGB")))
            .when(_is(data, 12, b"VP8L") & _is(data, 20, b"\x2f"), lossless).when(_is(data, 12, b"VP8X"), extended))


def _jpeg(data: Column) -> Column:
    """Follows the segments: the state is the place of the next marker, or the frame header's size."""
    frame = [m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]
    alone = [0x01, *range(0xD0, 0xD9)]  # markers without a length

    none = F.lit(None).cast("struct<width: int, height: int, mode: string>")
    go = lambda to: F.struct(to.cast("bigint").alias("at"), none.alias("found"))
    ended, lost = go(F.lit(-2)), go(F.lit(-1))  # the file ends here; no segment can start here

    def follow(state: Column, _: Column) -> Column:
        at = state["at"]
        size_at = lambda i: _size(_number(data, i + 7, 2), _number(data, i + 5, 2), _let(
            _number(data, i + 9, 1), lambda k: F.when(k == 1, "L").when(k == 3, "RGB").when(k == 4, "CMYK")))

        def by_marker(m: Column) -> Column:
            return (F.when(m["head"].isNull() | m["kind"].isNull(), ended).when(m["head"] != 255, lost).when(m["kind"] == 255, go(at + 1))
                    .when(m["kind"].isin(alone), go(at + 2))
                    .when(m["kind"].isin(frame), F.struct(F.lit(-2).cast("bigint").alias("at"), size_at(at).alias("found")))
                    .when(m["kind"].isin(0xD9, 0xDA), lost).when(m["size"].isNull(), ended).when(m["size"] < 2, lost).otherwise(go(at + 2 + m["size"])))

        marker = F.struct(_number(data, at, 1).alias("head"), _number(data, at + 1, 1).alias("kind"), _number(data, at + 2, 2).alias("size"))
        return F.when(at < 0, state).otherwise(_let(marker, by_marker))

    start = F.struct(F.lit(2).cast("bigint").alias("at"), F.lit(None).cast("struct<width: int, height: int, mode: string>").alias("found"))
    # No more steps than the file has room for.
    steps = F.sequence(F.lit(1), F.least(F.lit(MAX_SEGMENTS), F.length(data) + 1))
    # at: -2 the file ended or the frame was met, else no frame can follow
    return _let(F.aggregate(steps, start, follow), lambda end: F.struct(end["found"].alias("found"), (end["at"] == -2).alias("ended")))


def _tiff(data: Column) -> Column:
    def with_order(little: Column) -> Column:
        at = lambda i, n: _number(data, i, n, little)

        def value(e: Column) -> Column:
            # Several values lie elsewhere in the file, their place in the entry; the first one is enough.
            near = F.when(e["kind"] == 3, at(e["at"] + 8, 2)).when(e["kind"] == 4, at(e["at"] + 8, 4))
            far = F.when(e["kind"] == 3, at(at(e["at"] + 8, 4), 2)).when(e["kind"] == 4, at(at(e["at"] + 8, 4), 4))
            return F.when(e["held"] <= F.when(e["kind"] == 3, 2).otherwise(1), near).otherwise(far)

        def directory(d: Column) -> Column:
            entry = lambda i: d["first"] + 2 + 12 * i
            entries = F.transform(F.sequence(F.lit(0), F.least(F.greatest(d["n"], F.lit(1)), F.lit(MAX_ENTRIES)) - 1), lambda i: F.struct(
                entry(i).alias("at"), at(entry(i), 2).alias("tag"), at(entry(i) + 2, 2).alias("kind"), at(entry(i) + 4, 4).alias("held")))

            def tags(known: Column) -> Column:
                tag = lambda number: _let(F.filter(known, lambda e: e["tag"] == number), lambda hit: F.when(F.size(hit) > 0, value(hit[0])))
                return _let(F.struct(tag(256).alias("width"), tag(257).alias("height"), F.coalesce(tag(258), F.lit(1)).alias("bits"), tag(262).alias("ink"),
                                     F.coalesce(tag(277), F.lit(1)).alias("samples")), sized)

            return F.when(d["n"].isNotNull() & (d["first"] + 2 + 12 * d["n"] <= F.length(data)), _let(entries, tags))

        def sized(t: Column) -> Column:
            one = t["samples"] == 1
            mode = (F.when(t["ink"] == 3, "P").when(t["ink"] == 5, "CMYK").when(one & (t["bits"] == 1), "1").when(one & (t["bits"] == 16), "I;16")
                    .when(one, "L").when(t["samples"] == 2, "LA").when(t["samples"] == 3, "RGB").when(t["samples"] == 4, "RGBA"))
            return _size(t["width"], t["height"], mode)

        return _let(at(F.lit(4), 4), lambda first: _let(F.struct(first.alias("first"), at(first, 2).alias("n")), directory))

    return _let(_is(data, 0, b"II"), with_order)


def _tiff_end(data: Column) -> Column:
    """Where the first directory ends; behind the file if that cannot be read."""
    beyond = F.length(data) + 1
    return _let(_is(data, 0, b"II"), lambda little: _let(_number(data, F.lit(4), 4, little), lambda first: F.coalesce(
        first + 2 + 12 * _number(data, first, 2, little), beyond)))


def with_headers(files: DataFrame) -> DataFrame:
    """Adds width, height, n_channels, mode and status to rows with a ``content`` column, which goes."""
    data = F.col("content")
    jpeg = _is(data, 0, b"\xff\xd8")
    tiff = _is(data, 0, b"II*\x00", b"MM\x00*")
    fixed = (F.when(_is(data, 0, b"\x89PNG\r\n\x1a\n"), _png(data)).when(_is(data, 0, b"GIF87a", b"GIF89a"), _gif(data))
             .when(_is(data, 0, b"BM"), _bmp(data)).when(_is(data, 0, b"RIFF") & _is(data, 8, b"WEBP"), _webp(data))
             .when(tiff, _tiff(data)))
    found = files.withColumn("__jpeg", F.when(jpeg, _jpeg(data))).withColumn("__size", F.coalesce(fixed, F.col("__jpeg.found")))
    width, height = F.col("__size.width"), F.col("__size.height")
    whole = width.isNotNull() & height.isNotNull()
    # Fewer bytes than any of these headers take, or a chain that the end of the file cut.
    need = (F.when(_is(data, 0, b"GIF87a", b"GIF89a"), 10).when(_is(data, 0, b"BM"), 30).when(_is(data, 0, b"RIFF"), 30)
            .when(_is(data, 0, b"\x89PNG\r\n\x1a\n"), 33).when(tiff, _tiff_end(data)).otherwise(8))
    short = (F.length(data) < need) | F.coalesce(F.col("__jpeg.ended") & ~whole, F.lit(False))
    status = (F.when(whole & (width > 0) & (height > 0), "ok").when(short, "truncated").otherwise("corrupt"))
    out = found.withColumn("status", status)
    ok = F.col("status") == "ok"
    modes = F.create_map(*[x for m, n in MODES.items() for x in (F.lit(m), F.lit(n))])
    mode = F.coalesce(F.col("__size.mode"), F.lit("other"))
    return out.select(*[F.col(f"`{x}`") for x in files.columns if x != "content"], F.when(ok, width).alias("width"), F.when(ok, height).alias("height"),
                      F.when(ok, modes[mode]).alias("n_channels"), F.when(ok, mode).alias("mode"), "status")


def image_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, n_channels, mode, status) from the header bytes of every image file."""
    return with_headers(_listing(spark, root).select(_norm_path(F.col("path")).alias("path"), "content"))


def image_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files with their headers, from one listing (files without a readable size have NULL sizes)."""
    return with_headers(_listing(spark, root).select(*_file_columns(root), "content"))
