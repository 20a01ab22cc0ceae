"""Small tables with what real ones have: nulls, empties, long texts, ties, repeats, clashing columns."""

LONG = "the quick brown fox " * 40_000

DOCS = [
    (1, "alpha  beta\tgamma"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, " \n "), (6, LONG), (7, LONG), (None, "alpha beta gamma"), (None, "only here"),
    (8, "Ünïcode straße 東京 😀 text"), (8, "Ünïcode straße 東京 😀 text"), (9, "<|endoftext|> it's we'll \x01 x"), (10, "a"), (11, "A"), (12, "x y z  "), (13, "\n\n\nline\n\n"),
]
#: Names that the operators use themselves.
EXTRA = "digest n_words spans item_ids piece start length fp node root score rule verdict host path keep_id kept row text_sha256 task archive value".split()


def documents(spark, rows=None, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA)) if extra else df


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
