from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passages(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    return lambda n: " ".join(word() for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    text = passages()
    base, shared = text(120), text(60)
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Une phrase çà et là."), (5, base), (6, base), (6, base),
        (7, base.replace(" ", "  ", 1)), (8, base + " tail"), (9, text(30) + " " + shared + " " + text(30)), (10, text(40) + " " + shared),
        (11, LONG), (12, "Shti " * 200), (13, "é" * 300), (14, "é" * 299 + "x"), (None, base), (None, None), (15, "<|endoftext|> a  b c\n\nd "), (16, "😀 \U0001f600" * 90),
    ]
    return [(i, t, None if i == 3 else "en", None if i in (1, 9) else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(edges):
    """The edge rows with extra columns that operators use names like."""
    names = ["score", "kept", "spans", "component_id", "fp", "slot", "shard", "copy", "n_copies", "mix_key", "sketch", "posterior", "rank", "_row", "_found", "start", "length", "doc_tokens"]
    return edges.withColumns({n: F.lit(-1) for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
