import glob
import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


#: Nulls in any column, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, prose(1, 300), "en", "a", 1),
    (2, prose(1, 300), "en", "a", None),
    (2, prose(1, 300), "en", "a", None),
    (3, None, "en", "b", 1),
    (4, "", None, None, 0),
    (5, " \t\n", "de", "b", 3),
    (6, "12 34 !!", "de", None, 8),
    (7, prose(2, 40_000), "de", "c", 1),
    (None, prose(3, 80), None, "c", 1),
    (None, "kurz", "de", "c", 4),
    (None, "kurz", "de", "c", 4),
    (8, prose(1, 299) + " changed", "en", "d", 1),
    (9, "é́ Ünïcode ß text \U0001f600 here", "fr", "d", 1),
    (9, "another text of the same id", "fr", "d", 1),
    (-5, prose(4, 120) + "\n" + prose(5, 120), "es", "e", 1),
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    for c in ("n", "t1", "t2", "uid", "key", "mark", "all", "pos", "size", "position", "shard", "slot", "kept", "digest", "lang_pred", "row", "copy", "nth", "own", "count", "h", "lo", "marks"):
        odd = odd.withColumn(c, F.lit("x"))
    return odd


@pytest.fixture(scope="session")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con
