from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from lectern.llm import collocations as c


def brute(rows, support, length, absorb, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, length + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= support and len(key[1]) > 1}
    out = []
    for lang in n:
        mine = {p: a for (g, p), a in found.items() if g == lang}
        rows = []
        for p, a in mine.items():
            inside = (x for q, x in mine.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * x >= absorb * a for x in inside):
                continue
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("length", "top"), [(3, 2000), (4, 7), (2, 5)])
def test_against_brute_force(spark, length, top):
    r = random.Random(length)
    texts = ["".join(r.choice(["a ", "b  ", "C ", "d\t", "éé ", "x", ". ", "\n", "  ", "😀 "]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    rows = [(t, r.choice(["en", "en", "de", "und", None])) for t in texts] + [("the very same words again. Of all", "en")] * 50 + [(None, "en"), ("", None), (" . ,", "zz")]
    df = spark.createDataFrame([(t, g, -1, "x") for t, g in rows], "text string, lang string, piece long, word string").repartition(3)
    got = sorted(tuple(x) for x in c.collocations(df, 4, length, 50, top, buckets=3).collect())
    assert got == brute(rows, 4, length, 50, top) and got


def test_edges(spark, clashing, edge_rows, nothing):
    assert c.collocations(nothing).count() == 0
    got = sorted(tuple(x) for x in c.collocations(clashing, 3).collect())
    assert got == brute([(t, g) for _, t, g, *_ in edge_rows], 3, 3, 50, 2000)


def test_counts_beyond_64_bits(spark):
    """Counts of 10^13 give products of 33 digits."""
    one = 10**13
    df = spark.createDataFrame([(one - 7, one, one - 1)], "a long, l1 long, r1 long")
    from pyspark.sql import functions as F

    assert df.select(F.expr(c.SCORE.format(at=1))).first()[0] == 10**6 * (one - 7) ** 2 // (one * (one - 1))
