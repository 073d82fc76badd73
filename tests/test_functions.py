from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions.text import jaccard, levenshtein_similarity, name_key, tokens


def test_text_functions(spark):
    df = spark.createDataFrame([("Re-entrancy", "reentrancy", "\t A b\n")], "a string, b string, c string")
    r = df.select(levenshtein_similarity(F.col("a"), F.col("b")).alias("l"), jaccard(tokens(F.lit("a b c")), tokens(F.lit("B c d"))).alias("j"), name_key(F.col("c")).alias("k"),
                  levenshtein_similarity(F.lit(""), F.lit("")).alias("e")).first()
    assert (round(r.l, 6), r.j, r.k, r.e) == (round(1 - 1 / 11, 6), 0.5, "a b", 1.0)
