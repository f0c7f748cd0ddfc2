from __future__ import annotations

import random

import pytest

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Ids and texts: prose, exact and near copies, shared passages, runs, short, empty and null texts."""
    rng = random.Random(7)
    out: list[tuple] = []
    passage = words(rng, 60)
    for i in range(40):
        w = words(rng, rng.choice([3, 12, 13, 40, 120, 400]))
        if i % 4 == 0:
            at = rng.randrange(len(w) + 1)
            w = w[:at] + passage[rng.randrange(20) : 40 + rng.randrange(20)] + w[at:]
        out.append((i, " ".join(w)))
    base = words(rng, 150)
    for i in range(40, 70):  # near copies, some only linked through others
        w = list(base)
        for _ in range(rng.randrange(1, 10)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        out.append((i, " ".join(w)))
    out += [(70 + i, out[5][1]) for i in range(4)]
    out += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "One"), (85, "a b c d"), (86, "A b\nc  d"), (87, " ".join(["x"] * 40)), (88, " ".join(["x"] * 55)), (89, " ".join(["p", "q"] * 30)), (90, " ".join(["q", "p"] * 25)), (91, out[41][1].upper())]
    out.append((92, " ".join(words(rng, 4000))))
    out.append((93, out[-1][1] + " tail"))
    out.append((94, "été 中文 naïve x " * 6))
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "zz", "s", 0) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
