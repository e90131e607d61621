"""Small tables for the operator tests."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that operators use inside; documents may have columns of these names.
CLASHING = ["key", "fp", "gid", "shard", "slot", "at", "row", "slice", "media", "ids", "component_id", "keep", "rule", "host"]


def documents(spark, rows, **columns):
    """doc_id, text and the columns of the table, with clashing extra ones."""
    df = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def prose(seed, n):
    """n words that hardly repeat in runs of five."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


def empty(spark):
    return documents(spark, [])
