"""Tables and texts for the tests of this folder."""

import random

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string"


@pytest.fixture
def frame(spark):
    """A table whose extra columns clash with the operators' own names."""
    def make(rows, schema=DOC):
        df = spark.createDataFrame(rows, schema)
        extra = ["bucket", "group", "payload", "label", "component_id", "spans", "items", "score", "kept", "id", "a", "b", "codes"]
        return df.withColumns({x: F.lit("clash") for x in extra if x not in df.columns})
    return make


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"x{seed}e{i}" if rng.random() < share else w for i, w in enumerate(text.split()))
