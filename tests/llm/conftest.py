import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, ties, and columns with the operators' names."""
    r = random.Random(4)
    vocab = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "été", "ÑANDÚ", "don't", "x1y2", "eta.", "theta"] + [f"w{i}" for i in range(60)]
    base = " ".join(r.choice(vocab) for _ in range(120))
    near = base.split()
    near[50] = "CHANGED"
    rows = [
        (1, base, "en", "a", 1),
        (2, base.upper().replace("É", "é").replace("Ñ", "ñ").replace("Ú", "ú"), "en", "a", 2),
        (3, " ".join(near), "en", "b", None),
        (4, None, "fr", None, 4),
        (5, "", None, "b", 5),
        (6, "   \t\n  ", "fr", "b", 5),
        (7, "one two", "fr", "b", 5),
        (8, "one two", "fr", "b", 5),
        (8, "one two", "fr", "b", 5),
        (None, "one TWO", "fr", "b", 5),
        (None, base, None, None, None),
        (9, (base + "\n") * 300, "en", "c", 9),
        (10, "shared line of some length\nown line number ten here\nshort\nshared line of some length", "en", "c", 9),
        (11, "  SHARED line of some length\t\nshort\n\n", "en", "c", 9),
        (12, "12 34 %% --", "de", "c", 9),
        (13, " ".join(r.choice(vocab) for _ in range(40)), "de", "d", 9),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in ("class", "n", "row_id", "key", "held_out", "ids", "d", "th"):
        df = df.selectExpr("*", f"'clash' as `{c}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
