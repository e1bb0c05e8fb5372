import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A document table from (doc_id, text) pairs, with a column whose name clashes with the operators' own."""
    def make(pairs, source="s"):
        rows = [(i, t, "en", source if not isinstance(source, list) else source[k], None if t is None else len(t), k) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid long")
    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented words."""
    import random

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))
    return make
