from __future__ import annotations

import random

import pytest

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omikron pi rho sigma tau upsilon "
         "phi chi psi omega one two three four five six seven eight nine ten").split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with exact copies, near copies, a shared passage, nulls, empties and a long text."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    passage = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(5)]
    for i in range(8):
        w = base[1].split()
        w[10 * i + 3] = "edited%d" % i
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, "  .,! "), (403, "two words"), (404, "two  WORDS!"), (405, "é" * 150), (406, "é" * 150),
             (407, prose(rng, 4000)), (None, base[2]), (7, base[7]), (7, base[7])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", i, "x", 1, 2, 0.5) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, band string, n int, rep int, toxicity double").repartition(3)
