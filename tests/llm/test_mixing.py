from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import mixing


def poisson(seed, doc, rate):
    parts = max(1, math.ceil(rate / mixing.PART))
    n = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{part}|{doc}".encode()).hexdigest()[:13], 16) / 16**13
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u:
            k += 1
            p *= rate / parts / k
            c += p
            n += 1
    return n


def test_mixing(spark, edges, edge_rows, clashing, nothing):
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 40.0), (None, 2.0), ("absent", 9.0), ("s2", None)], "source string, weight double")
    out = mixing.mix(edges, weights, F.lit(400)).collect()
    sizes = Counter(r[3] for r in edge_rows)
    got = Counter((r["doc_id"], r["source"]) for r in out)
    for (doc, source), rows in Counter((r[0], r[3]) for r in edge_rows).items():
        rate = 400 * ({"s0": 1.0, "s1": 40.0, None: 2.0}.get(source, 0.0) / 43) / sizes[source]
        assert got[(doc, source)] == rows * poisson(mixing.SEED, "" if doc is None else doc, rate)
    assert [r["mix_key"] for r in out] == sorted(r["mix_key"] for r in out) and all(0 <= r["copy"] < r["n_copies"] for r in out)
    assert mixing.mix(nothing).count() == 0 and mixing.mix(clashing).count() == mixing.mix(edges).count()


def test_hot_and_rare_sources(spark):
    """A source of a third of the rows is broadcast, sources of one row each are merged; all get what is drawn."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i}") for i in range(6000)]
    got = Counter(r["doc_id"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), power=1.0).collect())
    assert got == Counter({i: n for i, _ in rows if (n := poisson(mixing.SEED, i, 1.0))})
