"""The pipeline against brute force, stage by stage, each on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as C
from pyspark.sql import functions as F

from lectern.llm import mixing, simhash

from ..conftest import SMALL
from .test_mixing import poisson
from .test_simhash import brute_similar
from .test_suffix_dedup import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for _, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.collect())
    first, clean, single, cut, mixed = seen
    assert 0.8 * len(first) < len(clean) <= len(first) and set(clean) <= set(first)
    assert sorted(r["doc_id"] for r in single) == sorted(set(brute_similar([(r["doc_id"], r["text"]) for r in clean]).values()))
    kept = brute([r["text"] for r in single])
    assert sorted((r["doc_id"], r["text"]) for r in cut) == sorted((r["doc_id"], k.decode("utf-8", "ignore")) for r, k in zip(single, kept))
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    sizes = Counter(r["source"] for r in cut)
    total = sum(n**0.5 for n in sizes.values())
    got = Counter(r["doc_id"] for r in mixed)
    for r in cut:
        n = sizes[r["source"]]
        assert got[r["doc_id"]] == poisson(mixing.SEED, r["doc_id"], len(cut) * (n**0.5 / total) / n)


def test_run(spark):
    pieces = C.run(spark, SMALL)
    assert pieces.count() > 0 and pieces.where("length > 1024 or length < 1").count() == 0


OWN = ["_score", "_text_id", "kept", "spans", "n_copies", "copy", "mix_key", "component", "node", "_n", "fp", "sketch"]


def test_stages_on_edges(spark, edges, edge_rows):
    """Nulls, empty and long texts, repeated rows; columns called like the operators' own come through unharmed."""
    docs = edges.withColumns({n: F.concat(F.lit("mine "), F.coalesce("doc_id", F.lit(-1))) for n in OWN})
    at_first = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        rows = docs.collect()
        assert rows and all(r[n] == f"mine {-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for n in OWN), name
        if name == "simhash near-dedup":
            assert len(rows) == len(set(rows)) and {(r["doc_id"], r["text"]) for r in rows} <= at_first
            assert {3, 4, 5, 11, 12} <= {r["doc_id"] for r in rows} and not {6, 7, None} & {r["doc_id"] for r in rows}


def test_stage_on_nothing(spark, nothing):
    for name, stage in C.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0, name
    assert simhash.keep_first(nothing).count() == 0
