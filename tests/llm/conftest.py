import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, epoch int, component string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns
    whose names clash with those of operators."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base, other = prose(120), prose(90)
    rows = [
        (0, base, "en", "src0"), (1, base, "en", "src0"), (2, base.replace(" ", "  ", 1), "en", "src1"),
        (3, " ".join(base.split()[:-1] + ["omega"]), "en", "src1"), (4, other, "de", "src2"),
        (5, other + " " + base, "de", "src0"), (6, "", "en", "src0"), (7, None, "en", "src3"),
        (8, "   \n\t ", "fr", "src3"), (9, "x", None, None), (9, "x", None, None), (10, "çà été " * 30, "fr", "src4"),
        (11, "a" * 30_000, "en", "src0"), (12, "0123456789 " * 40, "en", "src5"), (13, prose(6000), "en", "src0"),
        (14, "▁ leading\x00 zero ퟿ 🙂 " + base, "es", "src0"), (None, base, "en", "src0"), (None, None, None, None),
    ]
    return spark.createDataFrame([(i, t, lg, s, None if t is None else len(t), "k", 1, "c") for i, t, lg, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
