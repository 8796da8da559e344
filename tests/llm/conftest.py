import random

import pytest

WORDS = [a + b for a in "ba de ki lo mu na po ri su ta ve wi".split() for b in "ran sel tin vor mek dal pus".split()]


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def prose(rng):
    return lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
