import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names an operator may use."""
    long = "word " * 60_000
    rows = [(1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, long, "de", "b", len(long), None),
            (4, "Some plain text that is short.", None, None, None, "y"),
            (4, "Some plain text that is short.", None, None, None, "y"), (None, "no id here", "en", "a", 10, "z"),
            (5, "line one\nline two\n\nline one\n", "en", "c", 28, "z"), (6, " \n\t ", "en", "c", 4, "q")]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string"
    ).selectExpr("*", "'e' as ids", "1 as score", "'h' as node", "2 as row", "3 as sequence_id", "'m' as items")
