import pytest

#: Names that operators use inside.
CLASHING = ("keep", "kept", "n", "count", "map", "bits", "bit", "of", "component", "words", "node", "place", "bucket", "first", "level", "turn", "score", "start", "end", "n_words", "fingerprint")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table with columns whose names operators use inside, from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), "x", 1, *["y"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(data, DOCS + ", key string, size int, " + ", ".join(f"`{n}` string" for n in CLASHING))

    return make


@pytest.fixture
def by_id():
    """The rows of a frame by doc_id; ids must be distinct."""

    def collect(df):
        found = df.collect()
        out = {r["doc_id"]: r for r in found}
        assert len(out) == len(found)
        return out

    return collect
