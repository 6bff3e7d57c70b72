import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k + k * seed) % len(WORDS)] + str((seed + k) % 9) for k in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns of clashing names."""
    rows = [
        (1, text(1, 60), "en", "a", 5, "x", 0.5),
        (2, text(1, 60), "en", "a", 5, "x", 0.5),
        (2, text(1, 60), "en", "a", 5, "x", 0.5),
        (3, text(1, 59) + " changed", None, None, None, None, None),
        (4, None, "en", "b", None, None, None),
        (5, "", "de", "b", 0, None, None),
        (6, " \t\n ", "de", "b", 4, None, None),
        (7, "two words", "de", "b", 9, None, None),
        (8, "Two WORDS", "de", "b", 9, None, None),
        (None, text(9, 40), None, None, None, None, None),
        (None, None, None, None, None, None, None),
        (10, text(3, 30_000), "fr", "c", 1, "y", 0.1),
        (11, "ünï çödé 日本語 x \x1c y\n\nünï çödé 日本語 x \x1c y <|endoftext|> password = 'abcdefgh1234'", "fr", "c", 1, "y", 0.1),
        (12, "one\nline\none\nline\r\none", "fr", "c", 1, "y", 0.1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    con = duckdb.connect()
    return lambda name: con.sql(f"select * from '{DATA}/{name}.parquet'").fetchall()


@pytest.fixture(scope="session")
def data():
    return DATA
