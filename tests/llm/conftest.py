import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, word string"
#: Nulls, empty and blank texts, repeats, ties, letters of several bytes, odd spaces, a long text and a long word.
TEXTS = [
    None, "", " \n\t ", "one", "Two Words", "a b c d e", "a b c d e", "A B C D E", "x y 　z", "don't we'll 's 'RE 12½ 漢字 😀!",
    "line one\nline two\nline one\n\n\nline one", "the cat sat " * 60, " ".join(f"word{i}" for i in range(3000)), "é" * 700,
    "spam! " * 20 + " ".join(f"w{i * 7919 % 1009}" for i in range(100)), " lead and trail ", "#*$%&|<> & #",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case, clashing extra columns, a null id, equal rows and null sources."""
    rows = [(i, t, ["en", "de", None][i % 3], [f"src{i % 4}", None][i % 5 == 4], None if t is None else len(t), "k", "w") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "src0", 3, "k", "w"), (3, "one", "en", "src0", 3, "k", "w"), (None, "no id here", "en", "src1", 10, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
