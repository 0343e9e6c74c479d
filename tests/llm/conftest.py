import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "rn st lo xa vy zi qe th mo du".split()]
# Names that the operators use themselves.
CLASHES = ("score predicted spans redacted ids start length doc mark id none n label class_id links copies row rank "
           "size taken target place _key _id _copies _copy words bucket band range guest _words toxic").split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with columns of clashing names."""

    def make(rows, clashes=True):
        extra = CLASHES if clashes else []
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]),
                 *[f"{c}{i}" for c in extra]) for i, r in enumerate(rows)]
        schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long",
                            *[f"`{c}` string" for c in extra]])
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty, blank, very short and very long texts, repeated rows, repeated ids, null ids."""
    same = prose(1, 80)
    return [
        (0, "", "a"), (1, None, "a"), (2, " \n\t ", None), (3, "x", "b"), (4, prose(2, 60_000), "b"), (5, same, "a"),
        (6, same, "c"), (6, same, "c"), (7, prose(3, 50), None), (7, prose(4, 50), None), (None, prose(5, 40), "b"),
        (None, None, "b"), (-9, "é ü 中文 \U0001f600 password=hunter22x ﬁ", "ü"), (2**60, prose(6, 400), "a"),
    ]


@pytest.fixture(scope="session")
def messy(make_docs, messy_rows):
    return make_docs(messy_rows)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
