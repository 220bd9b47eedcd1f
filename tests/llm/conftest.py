import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_words string, print string, unit string, part string, c string, row string, size string, media string, kept string, count long"


def extra(doc_id, text, source="src1"):
    return (doc_id, text, "en", source, len(text or ""), "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", 5)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, long), (5, "é" * 5000), (6, "one two three"), (7, " \n\t "), (-8, "UPPER lower İΣ 漢字 👍")]
    return spark.createDataFrame([extra(d, t, None if d == 5 else "src1") for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
