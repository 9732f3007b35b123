import pytest


@pytest.fixture
def frame(spark):
    """A documents table of the given texts with doc_ids from 0."""
    def make(texts, **more):
        rows = [(k, t, *(v[k] for v in more.values())) for k, t in enumerate(texts)]
        kinds = {"lang": "string", "source": "string", "n_words": "string", "score": "string"}
        return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string"] + [f"{c} {kinds[c]}" for c in more]))
    return make
