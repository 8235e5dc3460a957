import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ", name string, label string, token long, n long, _row long, _id long, kind string, size long, cls binary"


@pytest.fixture
def frame(spark):
    """docs from (doc_id, text[, source]) rows; with clash, extra columns with the operators' own names."""

    def make(rows, clash=False):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) + ((None,) * 9 if clash else ()) for r in rows]
        return spark.createDataFrame(rows, DOCS + (CLASH if clash else ""))

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and white-space texts, ties, repeated rows, a long text, other scripts."""
    long = " ".join(f"w{i * i % 977}x" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "a b"), (5, "ab"), (6, " ab "), (6, " ab "), (None, "ab"), (None, None), (7, long), (8, long + " "),
        (9, "Ünïcödé ß Ελλάς привет 日本語 🙂 x y"), (10, "x" * 20_000), (11, "one\ntwo\none\n\n"), (12, "<|endoftext|> END"),
    ]


def table(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
