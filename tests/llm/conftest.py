import os

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text[, lang[, source]]), with columns whose names operators also use inside."""
    def run(*rows, extra=True):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            r = (*r, *("en", "s")[len(r) - 2:])
            full.append((*r[:4], len(r[1] or "")))
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("pos", "key", "doc", "body", "fp", "root", "id", "n", "size", "block", "target", "kept", "total", "mix", "q", "d1", "path", "v"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return run


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path


def words(seed, n):
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
