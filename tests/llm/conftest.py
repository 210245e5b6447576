import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, id string"
TEMPLATES = "the of and river stone window garden quiet morning letter paper forest bright silver under along between teacher music village history number simple yellow orange market travel winter summer".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(TEMPLATES) + rnd.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Ordinary texts, copies, nulls, empty and blank texts, a very long one, repeated rows, null languages and sources."""
    rnd = random.Random(5)
    out = []
    for k in range(60):
        out.append((k, prose(rnd, 30 + k), "en" if k % 3 else "de", f"s{k % 4}"))
    out.append((60, out[7][1], "en", "s1"))  # a copy
    out.append((61, out[50][1] + " stone", "en", "s1"))  # a near copy
    out += [(62, None, "en", "s0"), (63, "", "en", "s0"), (64, " \n\t ", None, None), (65, "word", None, None)]
    out.append((66, prose(rnd, 60_000), "en", "s2"))
    out += [out[3], out[3]]  # repeated rows
    out.append((67, "Á é ü\x0b日本語 x y", "en", None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "a", "b", "c") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
