"""Small tables for the tests of the training-data operators."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None, "", " \n\t ", "one", "one two three four", "a b c d e", "The of and\nThe of and\n\nother line",
    "x" * 5000, "word " * 3000, "é " * 300 + "日本語 テキスト", "'s 't 'll ''s don't 're<|endoftext|>x", "\x1c\x85 　",
]


def docs_table(spark, rows, extra=False):
    """rows of (doc_id, text) or (doc_id, text, lang); extra adds columns with names that operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("node", "label", "key", "cell", "block", "copies", "digest", "words", "t", "__id", "starts", "kept"):
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def by_id(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)
