import pytest

SF = "/root/testdata/sf0.001"

#: Odd rows: null and empty texts, null ids, repeated rows, ties, long texts; and columns that clash with inner names.
ODD = [
    (1, "The cat sat on the mat and looked at the moon above the old barn today.", "en", "a"),
    (1, "The cat sat on the mat and looked at the moon above the old barn today.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "   \n\t ", "en", None),
    (None, "No identity here, yet some words stand in this row of the table.", "en", "b"),
    (5, "Die Katze saß auf der Matte und sah den Mond über der alten Scheune an.", "de", "b"),
    (6, "The cat sat on the mat and looked at the moon above the old barn today.", "en", None),
    (7, "1234 5678 !!", "en", "c"),
    (8, "word " * 30000, "en", "c"),
    (9, "x" * 100000, "en", "c"),
    (None, None, None, None),
]
CLASH = "n long, node string, key string, score string, predicted string, size string, target string, rid string, pm_low string, mix_size string, rare_base string, h string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars", *[f"cast(null as {k}) {c}" for c, k in (x.split() for x in CLASH.split(", "))])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def count_of(df):
    return df.count()
