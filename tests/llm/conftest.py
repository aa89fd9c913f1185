import random

import pytest
from llm_brute import CLASH, prose
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, repeated rows and columns with names that operators use."""
    rng = random.Random(11)
    long = prose(rng, 60_000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "!!! ... ###"), (5, long), (5, long), (6, long), (None, prose(rng, 80)), (None, None), (7, "ünïcode 你好 مرحبا 😀 line\r\nnext\x0b\x00end"), (7, "another text of the same id")]
    rows += [(8 + k, prose(rng, 60)) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.when(F.col("doc_id") % 3 == 0, "s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.when(F.col("doc_id") % 2 == 0, F.lit("x")) for c in CLASH})
