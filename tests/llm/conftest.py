import random

import pytest
from brute import SCHEMA


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of key and text with copies, near copies, shared passages and lines, NULLs, empties and repeats."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "the and of ta ör né ß ko li mu".split() for b in "ra st ö nd ing le xi wo".split()]
    passage = prose(rng, 60, words)
    line = "This Line stands in many documents"
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(1, 120), words)
        if i % 5 == 0:
            text = f"{text} {passage[: rng.randint(150, len(passage))]} {prose(rng, 5, words)}"
        if i % 4 == 0:
            text = f"{text}\n  {line}\t\n{text[:30]}"
        rows.append((i, text))
    base = prose(rng, 100, words).split(" ")
    for i in range(60, 90):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(90 + i, rows[3][1].replace(" ", "  " if i % 2 else "\n")) for i in range(6)]
    rows += [(100 + i, rows[7][1]) for i in range(5)]
    rows += [(110, None), (111, ""), (112, " \n\t "), (113, "one"), (114, "ONE"), (115, "two words"), (116, "\n\n")]
    rows += [(None, rows[5][1]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (5, "another text under a known key")]
    rows += [(120, " ".join(["again"] * 300)), (121, prose(rng, 4000, words)), (122, "x" * 5000 + " " + passage)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def frame(spark):
    """A frame of rows; extra columns carry names that operators use themselves."""

    def make(rows, clash=True, parts=5):
        if not clash:
            return spark.createDataFrame(rows, SCHEMA).repartition(parts)
        extra = "_text string, _row long, kept boolean, score double, n long, spans string, key string, h1 long"
        full = [(k, t, "x", 7, None, 0.5, k, None, None, 1) for k, t in rows]
        return spark.createDataFrame(full, f"{SCHEMA}, {extra}").repartition(parts)

    return make


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def apart(spark):
    """Small partitions are not put together, as large ones would not be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
