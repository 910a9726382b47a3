import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, repeated lines, junk, an empty and a very long one."""
    rng = random.Random(5)

    def line(n):
        return " ".join(rng.choice(WORDS) + rng.choice(["", ",", "."]) for _ in range(n)).capitalize()

    shared = line(60)
    texts = ["\n".join(line(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[1] + " extra"] + [t + "\n" + shared for t in texts[10:20]]
    texts += ["", "one", "Two words", " ".join(["same"] * 300), line(20_000), "a" * 5000, "\n\n  \t\n", "ÉÀ ß 漢字 🙂 ümlaut"]
    return texts


@pytest.fixture()
def docs(spark, prose):
    """Documents with a null text, a null id, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src0", len(t), float(i), "x", 1) for i, t in enumerate(prose)]
    rows += [(1000, None, "en", "src0", 0, 0.0, None, None), (None, "null id here with some words", None, None, None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, template string, line int")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
