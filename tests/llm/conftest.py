import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


@pytest.fixture
def docs(spark):
    """Documents with two extra columns whose names operators use themselves."""

    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture
def hard():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977} tail{i}" for i in range(20_000))
    return [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (None, "some text of no id", "en", "b"), (3, "", "en", "b"), (4, " \n\t ", None, "b"), (5, long_text, "de", "a"), (6, long_text, "de", None), (7, "ünï ▁ \U0001f600\n\nzweite Zeile", "de", "a"), (1, "another text with the same id", "en", "c")]
