import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = "wörd " * 3000 + "x" * 50_000 + " 你好🙂\n" * 500
PASSAGE = " ".join(f"passage{i % 7}x{i}" for i in range(60))
#: Every awkward case in one table: nulls in each column, empty and very long texts, repeated rows, ties.
ROWS = [
    (1, "Plain words of a first text, long enough to say something.", "en", "a", 5), (2, None, "en", None, None), (3, "", None, "a", 0), (4, "   \n\t ", "en", "a", 6),
    (5, "123 456 !!", "en", "a", 10), (6, LONG, "de", "b", len(LONG)), (7, LONG, "de", "b", len(LONG)), (8, "Plain words of a first text, long enough to say something.", "en", "a", 5),
    (8, "Plain words of a first text, long enough to say something.", "en", "a", 5), (None, "no id here but words", "en", "a", 3), (None, None, None, None, None), (10, "word", "fr", "c", 4),
    (11, f"before one {PASSAGE} after one", "en", "a", 9), (12, f"other start {PASSAGE} other end", "en", "a", 9), (13, "a\x00b 'll 've's don't   x ½ ²", "es", "c", 3), (-5, "negative id", "en", "a", 1),
]


def docs_of(spark, rows):
    """A documents table with these rows and more columns whose names operators use themselves."""
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.selectExpr("*", "1 AS score", "'x' AS node", "true AS kept", "2 AS part", "3 AS digest", "4 AS length", "5 AS key", "6 AS `at`", "7 AS component", "8 AS cuts", "9 AS fingerprint", "10 AS ids")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    docs_of(spark, ROWS).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, 1) for i in range(1, 12)] + [(None, 1, None, 2), (3, None, None, 3)], "doc_id long, quality int, toxic int, mark int")


@pytest.fixture(scope="session")
def texts(sf):
    """doc_id → text of the small table."""
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], table["text"], strict=True))


@pytest.fixture
def arrow():
    return lambda values: pa.array(values, pa.string())
