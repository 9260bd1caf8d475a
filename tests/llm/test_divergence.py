from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import divergence as d


def brute(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [w for w, k in docs[lang].items() if k >= min_docs]
        mates = [s for g, s in groups if g == lang]

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = shares(counts[lang, source]), shares(sum((counts[lang, s] for s in mates), Counter()))
        pairs = [(-sum(abs(p[w] - o[w]) for w in kept), s.encode()) for s in mates if s != source for o in [shares(counts[lang, s])]]
        terms = sorted((q[w] - p[w], w.encode()) for w in kept if counts[lang, source][w] and p[w] > q[w])[:top]
        for part, found in (("pair", sorted(pairs)), ("term", terms)):
            out += [(lang, source, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def result(df, **kw):
    return sorted(tuple(x) for x in d.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("block", [2, 32])
def test_against_brute_force(spark, block):
    """Several blocks of sources, terms in several words and parts, counts of many levels, a source without terms."""
    r = random.Random(block)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyzéß" for b in ("", *"xyzçñTUVWabcdefghijklmnopqrstuvwQRSXY", "中", "😀")]
    rows = [(" ".join(r.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=r.randint(0, 120))), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "c", "é", "Z", None])) for _ in range(260)]
    rows += [(None, "en", "mute"), ("12 34 _!", "en", "digits"), ("the " * 400, "fr", "x"), ("the " * 400, "fr", "y")]
    df = spark.createDataFrame([(*x, -1, "q") for x in rows], "text string, lang string, source string, value long, item string").repartition(3)
    assert result(df, min_docs=4, top=6, block=block) == brute(rows, 4, 6)


def test_edges(spark, clashing, edge_rows, nothing):
    assert result(nothing) == []
    assert result(clashing, min_docs=2) == brute([(t, g, s) for _, t, g, s, _ in edge_rows], 2, 50)
    assert result(clashing.withColumn("text", F.lit("12"))) == brute([("12", g, s) for _, t, g, s, _ in edge_rows], 30, 50)
