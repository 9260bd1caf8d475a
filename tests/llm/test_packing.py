from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_tokens_are_the_tokenizers(whole, edge_rows):
    texts = ["", "a", "a  b", " a", "a ", "\n\n", "x\n\ny", "<|endoftext|> a", "a\tb \t c", "it's, don't!?", "a.\n", ".\n.", "a ,b", "1, 2.", "x .\n", "a  b", "one. two, 3? \U0001f600! four", *[r[1] for r in edge_rows if r[1]]]
    got = [np.frombuffer(b, "<u4").tolist() for b in P.Tokens(PATH).encode_all(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_demand(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 257, 40)
    demand = {int(k): int(r.integers(1, 300)) for k in lengths}
    plan = P.plan(demand, 256)
    used = {}
    for copies, pattern in plan:
        assert copies > 0 and sum(k * n for k, n in pattern.items()) <= 256
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + copies * n
    assert used == demand
    assert P.plan({}, 256) == []


def test_column_generation_beats_first_fit():
    # Thirds that first-fit decreasing pairs badly.
    lengths, demand = np.array([30, 40, 60]), np.array([600.0, 600.0, 300.0])
    use = sum(u for _, u in P.column_generation(lengths, demand, 100))
    assert use <= 600 * 30 / 100 + 600 * 40 / 100 + 300 * 60 / 100 + 10


def check(pieces, texts, whole, capacity=1024):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"] is None, p["doc_id"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
    want = sorted(((i is None, i or 0), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes()), a, len(ids)) for i, t in texts for ids in [[*whole.encode(t or "", add_special_tokens=False).ids, 0]] for a in range(0, len(ids), capacity))
    assert want == sorted(((p["doc_id"] is None, p["doc_id"] or 0), p["ids_crc32"], p["start"], p["doc_tokens"]) for p in pieces)
    return by_sequence


def test_documents(edges, edge_rows, clashing, nothing, whole):
    check(P.pack(edges, PATH).collect(), [(r[0], r[1]) for r in edge_rows], whole)
    assert P.pack(clashing, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert P.pack(nothing, PATH).count() == 0


def test_little_padding(spark, whole):
    from lectern.llm.common import table

    from ..conftest import SMALL

    docs = table(spark, SMALL, "documents")
    pieces = P.pack(docs, PATH).collect()
    sequences = check(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()], whole)
    assert sum(p["length"] for p in pieces) > 0.97 * 1024 * len(sequences)
