import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import make, texts  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(8)
    out = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for k, t in enumerate(texts())]
    out += [out[30], out[31], (30, out[40][1], "en", "b"), (None, out[50][1], "en", "a"), (None, "lonely text", "en", None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
