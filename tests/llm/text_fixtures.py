"""Documents that the tests of the text operators share."""

# Columns named like those that the operators use inside.
CLASHES = ("id", "row", "fp", "key", "spans", "n", "place", "marks", "u", "v", "ids", "label", "score", "start")


def table(spark, rows, schema="doc_id long, text string"):
    """Documents with the usual columns and others whose names clash."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, schema)
    for name, value in (("lang", "en"), ("source", "s"), ("n_chars", 1)):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(value))
    return docs.select("*", *(F.lit("other").alias(c) for c in CLASHES))


LONG = "lorem ipsum dolor sit amet " * 40_000  # a million characters
ODD = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "one"),
    (5, "a b c d e f g h i j k l m n o p"),
    (5, "a b c d e f g h i j k l m n o p"),
    (6, "A B C D E F G H I J K L M N O P"),
    (7, "été ÉTÉ 東京 🙂 ▁ naïve"),
    (None, "no id here but some words to read"),
    (8, LONG),
    (9, "x" * 5000),
    (10, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie"),
]


def thue_morse(n, a, b):
    """A word of ``n`` letters; with both letters exchanged, a polynomial modulo 2^64 maps it to the same value from 1,024 on."""
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))
