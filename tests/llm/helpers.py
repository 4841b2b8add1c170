"""Rows that every operator is tried on."""

from pyspark.sql import functions as F

LONG = "word other thing " * 4000
ODD = [(1, "one two three four"), (2, None), (3, ""), (4, LONG), (5, "one two three four"), (5, "one two three four"), (None, "no id\n\nat  all "), (7, " \t\n"), (8, "é漢字🙂 <|endoftext|> x  y")]


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with those of the operators."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("lang", "source"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    for name in ("n", "h", "fp", "length", "ids", "first", "n_words", "score", "lines", "key", "value", "x", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def none_of(df):
    return df.where("false")
