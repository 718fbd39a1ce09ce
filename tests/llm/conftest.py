import pytest

from paysieve.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node string"
# Columns of documents plus two whose names operators use themselves.


@pytest.fixture(scope="session")
def docs_frame(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1]), "x", "y") for r in rows]
        return prepare(spark).createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, repeated rows, one id with two texts."""
    long_text = " ".join(f"w{i % 977} x{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (None, "no id here at all today"), (5, long_text), (6, "same row again and again"), (6, "same row again and again"),
            (7, "first text of seven"), (7, "second text of seven"), (8, "ünï çödé wörds \U0001f600 tail", None, None)]
