import os
import random

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The whole smallest table of documents."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables not present")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    prose = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(90))
    long = "\n".join(" ".join(rng.choice(words) + str(rng.randrange(9999)) for _ in range(12)) for _ in range(2000))
    rows = [
        (1, prose, "en", "a", 3), (1, prose, "en", "a", 3), (2, None, None, None, None), (3, "", "en", "b", 0),
        (None, prose, "en", "a", 1), (None, None, None, None, None), (4, " \n\t ", "en", "", 4), (5, long, "de", "b", 9),
        (6, prose, None, "b", 3), (7, "one", "en", "a", 3), (7, "ONE", "en", "c", 3), (8, prose + " end", "en", None, 3),
        (9, "Łódź é 😀 x\r\ny", "pl", "ż", 3), (10, "a b c d\n\na b c d\n", "en", "a", 3), (3, "", "en", "b", 0),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names clash with those that the operators make."""
    names = ["score", "size", "shard", "slot", "law", "hits", "media", "frames", "payload", "n", "k1", "k2", "node", "class", "target",
             "taken", "source_size", "spans", "h", "route", "component_id", "n_shingles", "near", "place", "row", "cut", "id", "bytes", "w"]
    return spark.createDataFrame(odd_rows, SCHEMA).select("*", *[F.lit("own").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.where("false")
