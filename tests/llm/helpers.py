"""Small documents with the cases that every operator must bear."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "ti", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(words(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
        out.append((i, text, "en", rng.choice(["a", "b", "b", "b", None]), len(text)))
    long = words(rng, 6000)
    out += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n ", "en", "z", 4), (103, long, "en", "b", len(long)), (104, out[3][1], "en", "a", out[3][4]), (104, out[3][1], "en", "a", out[3][4]), (None, "no id but some words", "en", "é", 20), (105, out[5][1] + " more", "de", "a", 9), (106, "x", "en", "a", 1)]
    return out


def documents(spark, data=None):
    """With extra columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ("h", "fp", "size", "_id", "component_id", "kept", "score", "keys", "mix_key")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
