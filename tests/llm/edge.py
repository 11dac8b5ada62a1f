"""Tables of strange rows for all operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def strange_docs(spark):
    """Nulls in every column, empty, blank, repeated and long rows, and columns whose names operators might use."""
    body = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "one short text", "en", "s1", 14),
        (None, body, "en", "s1", 5),
        (3, None, "en", None, None),
        (4, "", None, "s1", 0),
        (5, " \t\n\x0b ", "de", "s2", -1),
        (6, "twice the same row", "en", "s1", 18),
        (6, "twice the same row", "en", "s1", 18),
        (7, "ünï çödé 😀 " + "long text here " * 20_000, "fr", "s2", 300_000),
        (8, body, "en", "s2", 400),
        (9, body, None, None, 400),
        (10, "<b>odd</b> | signs # * $ % &\x00 @ + 1.2.3.4", "xx", "", 3),
        (11, "x" * 400_000, "en", "s3", 400_000),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "shard", "slot", "node", "rep", "band", "label", "key", "bucket", "target", "whole", "long", "short", "_mix", "_source", "_leaks", "digest", "score", "kept", "w1", "n", "copy"):
        df = df.selectExpr("*", f"'clash' as `{c}`")
    return df
