import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, size long, key string, ids string"


def odd_rows():
    """Nulls in every column, blank, one-word and very long texts, repeated rows, clashing column names."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, "The cat sat on the mat.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "fr", "b"),
            (5, "word", "en", "b"), (None, "The cat sat on the mat.", None, None), (6, long_text, "en", "c"),
            (7, "12345 678 !!", "de", "c"), (1, "The cat sat on the mat.", "en", "a"), (8, "ééé ß x 日本語", None, "c")]
    return [(*r, None, "row", "node", 7, "key", None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
