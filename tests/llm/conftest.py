import pytest

from ebbmark.llm.common import prepared

#: Extra columns whose names occur inside the operators.
CLASH = ["row", "fp", "label", "words", "ids", "at", "kind", "items", "n", "group", "text_hash", "_hash", "score",
         "set", "best", "best_id", "best_hash", "_best_id", "_best_hash", "hashes", "cuts", "_cuts", "_cut_id", "_bad_id", "run", "owner", "edits"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))

TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n\x0b\x0c\r ", "en", "b"),
    (4, "The quick brown fox jumps over the lazy dog, again and again.", "en", "c"),
    (4, "The quick brown fox jumps over the lazy dog, again and again.", "en", "c"),  # a repeated row
    (5, LONG, "de", "b"),
    (None, "Émile va à l'école; DÉJÀ vu ! 中文 😀 don't <|endoftext|> 123", "fr", "a"),
    (6, "x", "fr", "a"),
    (7, "one two", "es", "a"),
    (8, "line one here\nline one here\n\nline two\nline one here", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    prepared(spark)
    return spark.createDataFrame([(i, t, l, s, len(t or ""), *[f"{c}!" for c in CLASH]) for i, t, l, s in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
