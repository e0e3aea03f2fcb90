import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cleaned(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return [r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").orderBy("doc_id").collect()]


def words(tag, n=40):
    return " ".join(f"{tag}w{j}" for j in range(n))


def test_a_line_in_few_pages_of_a_large_source_goes(spark):
    """6 of 600 pages, a hundredth; the line in 4 pages stays."""
    own = [words(f"p{i}") for i in range(600)]
    rare = [f"{t}\nLicensed alike." if i < 6 else f"{t}\nFour times." if i < 10 else t for i, t in enumerate(own)]
    assert cleaned(spark, rare) == [f"{t}\nFour times." if 6 <= i < 10 else t for i, t in enumerate(own)]


def test_near_copies_do_not_make_their_lines_boilerplate(spark):
    """30 near copies of one page among 60 pages keep the lines they share; a menu goes from
    all pages, and of the copies the next stage keeps one whole document."""
    shared = [words(f"c{j}", 12) for j in range(10)]
    copies = ["\n".join([*shared, f"copy {i}"]) for i in range(30)]
    own = [words(f"p{i}") for i in range(30)]
    got = cleaned(spark, ["Home About\n" + t for t in copies + own])
    assert got == copies + own
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(got)], SCHEMA)
    kept = [r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").orderBy("doc_id").collect()]
    assert kept == copies[:1] + own


def test_lines_of_copies_in_enough_other_pages_go(spark):
    """Near copies are cleaned of a line that other pages make boilerplate."""
    shared = [words(f"c{j}", 12) for j in range(10)]
    copies = ["\n".join([*shared, f"copy {i}"]) for i in range(8)]
    own = [words(f"p{i}") for i in range(6)]
    assert cleaned(spark, copies + [f"{t}\n{shared[3]}" for t in own]) == [t.replace(shared[3] + "\n", "") for t in copies] + own
