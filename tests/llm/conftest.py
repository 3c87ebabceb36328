import pytest

from tests.conftest import spark  # noqa: F401

SF = "/root/testdata/sf0.001"
LONG = "zebra crossing " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, ids string, cid long, n long, root long, key long, b int, copies int"


def frame(spark, rows):  # noqa: F811
    """Documents with further columns, named like results and working columns."""
    full = [(i, t, la, s, None if t is None else len(t), 7, 0.5, "x", 1, 2, 3, 4, 5, 6) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    plain = " ".join(f"word{i} and more" for i in range(40))
    return [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, None, None, None), (None, plain + " end", "en", None), (None, None, "en", "b"),
        (3, "", "de", "b"), (4, " \n\t ", None, "b"), (5, LONG, "en", "a"), (6, LONG, "en", "c"), (7, "1 2 3 !!", "en", "c"), (8, "é\x1c漢字 " * 30, "fr", "c"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):  # noqa: F811
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def rules_sf(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/documents.parquet")
