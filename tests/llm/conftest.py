import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, pos int"
REPEATED = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, very long and repeated texts, ties in ids, and columns that clash with inner names."""
    texts = [None, "", " \n\t ", "one", "one two", "One TWO", REPEATED, REPEATED.upper(), REPEATED + " and more " + REPEATED, "x" * 50_000, "w " * 30_000, "É é ß \U0001f600   a b   c", " lead and trail ", REPEATED]
    rows = [(i, t, "en", "s", len(t or ""), 1, "k", 2) for i, t in enumerate(texts)]
    return rows + [(6, REPEATED, "en", "s", 1, 1, "k", 2), (6, "another text " + REPEATED, "en", "s", 1, 1, "k", 2), (None, REPEATED, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (-5, "one", "fr", "s", 3, 1, "k", 2)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    return spark.createDataFrame(odd_texts, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
