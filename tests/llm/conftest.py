import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, key string"


@pytest.fixture
def frame(spark):
    """Documents from (id, text, source), with extra columns whose names the operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, -7, "x", "y") for i, t, s in rows], DOCS)
    return make


@pytest.fixture
def awkward(frame):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, "alpha beta gamma", "a"), (1, "alpha beta gamma", "a"), (2, "alpha beta gamma", None), (None, "delta", "b"),
            (None, None, "b"), (3, None, None), (4, "", "c"), (5, " \n\t ", "c"), (6, long, "a"), (7, "żółć Ümlaut 漢字 🙂", "c")]
    return frame(rows)


@pytest.fixture
def none(frame):
    return frame([])
