"""Source divergence audit by count-level bitmaps.

For each (lang, source) and each count c, a bitset holds the ids of the terms that occur c times there. The AND of
two bitsets and its popcount give one joint cell of two sources: the terms with count c here and d there. A cell
times |p(c) - p(d)| sums to the divergence of the pair; cells with a zero follow by complement from the sizes of
the levels. Bitsets are words of 64 terms of like frequency, so that few levels share a word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_skewed, materialize, salted_rank

#: Documents of its lang that hold a kept term, at least; rows of the term part; added to each count.
DOCS, TOP, ADD = 30, 50, 5
#: Sources in a block, on average; words of 64 terms in a part.
BLOCK, WORDS = 32, 16
#: Groups of (lang, source, term) that a task gathers before it sends them on.
GATHER = 400_000

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_COUNTS = "lang string, source string, term string, n long, docs long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term, n, docs) of documents; bytes.lower() changes A to Z alone."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        columns: list[list] = [[] for _ in range(5)]
        for (lang, source), (n, docs) in groups.items():
            for column, values in zip(columns, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(docs.__getitem__, n))):
                column.extend(values)
        groups.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),) * 2)], names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            found = TERM.findall(text.encode("utf-8", "replace").lower().decode("utf-8"))
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size > GATHER:
                yield flush()
                size = 0
    if groups:
        yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents that hold it. Null lang, source
    and text are empty strings."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).where("text != ''")
    return rows.mapInArrow(_gather, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, v: str = "v") -> Column:
    """p of a count: 1 + floor(10^9 (n + ADD) / (total + ADD v)), in decimals, as products may pass 64 bits; 0 without terms."""
    of = f"(cast({total} as decimal(20,0)) + {ADD} * cast({v} as decimal(18,0)))"
    return F.expr(f"if({v} = 0, 0L, 1L + (cast(1000000000 as decimal(11,0)) * (cast({n} as decimal(20,0)) + {ADD})) div {of})")


def levels(kept: DataFrame) -> DataFrame:
    """(lang, source, part, word, c, bits) of kept (lang, source, kind, id, n): the bitset of each count in each
    word of 64 term ids of a kind."""
    word = F.expr("id div 64")
    rows = kept.select("lang", "source", "kind", word.alias("at"), F.col("n").alias("c"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bit"))
    whole = rows.groupBy("lang", "source", "kind", "at", "c").agg(F.bit_or("bit").alias("bits"))
    return whole.select("lang", "source", F.struct("kind", F.expr(f"at div {WORDS}").alias("run")).alias("part"), F.expr(f"cast(at % {WORDS} as int)").alias("word"), "c", "bits")


_PAIR = "lang string, source string, item string, value long"


def _sides(table: pa.Table) -> tuple[np.ndarray, list[str], int, int]:
    """Source index of each row, the sources by index, and the two blocks of the group."""
    names = table.column("source").combine_chunks().dictionary_encode()
    return np.asarray(names.indices), names.dictionary.to_pylist(), table.column("one")[0].as_py(), table.column("other")[0].as_py()


def _wanted(blocks: np.ndarray, one: int, other: int, names: list[str]) -> list[tuple[int, int]]:
    """Pairs of sources, the smaller name first, that this pair of blocks answers for."""
    if one == other:
        return [(i, j) for i in range(len(names)) for j in range(len(names)) if names[i].encode() < names[j].encode()]
    return [(i, j) if names[i].encode() < names[j].encode() else (j, i) for i in np.flatnonzero(blocks == one) for j in np.flatnonzero(blocks == other)]


def _per_source(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, values.dtype)
    out[index] = values
    return out


def joint_cells(key: tuple, table: pa.Table) -> pa.Table:
    """Of one part of the terms and two blocks of sources: for each pair the popcounts of the ANDs of all levels
    times f, less what the complement will give for the same terms."""
    index, names, one, other = _sides(table)
    c = {k: np.asarray(table.column(k)) for k in ("word", "bits", "p", "p0", "block")}
    g = len(names)
    p0, blocks = _per_source(index, c["p0"], g), _per_source(index, c["block"], g)
    value, both = np.zeros((g, g), np.int64), np.zeros((g, g), np.int64)
    for word in np.unique(c["word"]):
        rows = np.flatnonzero(c["word"] == word)
        rows = rows[np.argsort(index[rows], kind="stable")]
        of, bits, p = index[rows], c["bits"][rows].view(np.uint64), c["p"][rows]
        present, starts = np.unique(of, return_index=True)
        for s, lo, hi in zip(present, starts, [*starts[1:], len(rows)]):
            cells = np.bitwise_count(bits[lo:hi, None] & bits[None, :]).astype(np.int64)
            f = np.abs(p[lo:hi, None] - p[None, :]) - np.abs(p[lo:hi, None] - p0[of][None, :]) - np.abs(p0[s] - p)[None, :] + np.abs(p0[s] - p0[of])[None, :]
            value[s, present] += np.add.reduceat((cells * f).sum(0), starts)
            both[s, present] += np.add.reduceat(cells.sum(0), starts)
    return _pairs(table, names, [(i, j) for i, j in _wanted(blocks, one, other, names) if both[i, j]], value)


def zero_cells(key: tuple, table: pa.Table) -> pa.Table:
    """Of two blocks of sources: for each pair the cells with a zero, by complement from level sizes. Every source
    has a row of count 0 and size 0."""
    index, names, one, other = _sides(table)
    c = {k: np.asarray(table.column(k)) for k in ("c", "size", "p", "p0", "block", "v")}
    g, v = len(names), int(c["v"][0])
    p0, blocks = _per_source(index, c["p0"], g), _per_source(index, c["block"], g)
    value, have = np.zeros((g, g), np.int64), np.zeros(g, np.int64)
    np.add.at(have, index, c["size"])
    for s in range(g):
        mine = index == s
        value[s] = (np.abs(c["p"][mine][:, None] - p0[None, :]) * c["size"][mine][:, None]).sum(0)
    whole = value + value.T + (v - have[:, None] - have[None, :]) * np.abs(p0[:, None] - p0[None, :])
    return _pairs(table, names, _wanted(blocks, one, other, names), whole)


def _pairs(table: pa.Table, names: list[str], wanted: list[tuple[int, int]], value: np.ndarray) -> pa.Table:
    columns = [[table.column("lang")[0].as_py()] * len(wanted), [names[i] for i, _ in wanted], [names[j] for _, j in wanted], [int(value[i, j]) for i, j in wanted]]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),))], names=["lang", "source", "item", "value"])


def _meet(rows: DataFrame) -> DataFrame:
    """Each row once for each pair of blocks that its block is in."""
    many = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return many.withColumn("one", F.least("block", "_with")).withColumn("other", F.greatest("block", "_with")).drop("_with", "blocks")


def audit(docs: DataFrame, min_docs: int = DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the divergence from each other source of the lang, summed
    over its kept terms; part `term`: the `top` terms that the source holds more often than its lang.

    Null lang, source and text are empty strings; a source without terms has its pairs; an empty table gives no
    rows; other columns are not read. Pairs of sources are the result, so they grow with the square of the sources
    of a lang, in blocks of about `block` sources; terms are dealt by parts of WORDS * 64."""
    counts = materialize(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    kept = materialize(kept.select("lang", F.length(F.bin("lang_n")).alias("kind"), "term", "lang_n"), "kept")
    terms = materialize(salted_rank(kept, ["lang", "kind"], ["term"], "id", kept.count()), "terms")
    cells = materialize(counts.select("lang", "source", "term", "n").join(terms.hint("merge"), ["lang", "term"]), "cells")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).drop("docs")
    have = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    blocks = named.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("blocks"))
    info = named.join(have.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), ["lang"], "left").join(blocks.hint("merge"), ["lang"]).na.fill(0, ["total", "n_terms", "v", "lang_total"])
    info = info.withColumn("p0", _share("0", "total")).withColumn("block", F.expr("cast(pmod(xxhash64(source), blocks) as int)"))
    info = materialize(info, "sources")

    found = materialize(levels(cells), "levels")
    total, n = found.count(), cells.count()
    held = found.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"))
    known = materialize(info.join(held.hint("merge"), ["lang", "source"]), "held")
    placed = join_skewed(found, known, ["lang", "source"], total).withColumn("p", _share("c", "total"))
    joint = _meet(placed.select("lang", "source", "part", "word", "bits", "p", "p0", "block", "blocks"))
    joint = joint.groupBy("lang", "part", "one", "other").applyInArrow(joint_cells, _PAIR)

    sizes = found.groupBy("lang", "source", "c").agg(F.sum(F.bit_count("bits")).alias("size"))
    sizes = sizes.unionByName(info.select("lang", "source", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("size")))
    zeros = sizes.join(info.hint("merge"), ["lang", "source"]).withColumn("p", _share("c", "total"))
    zeros = _meet(zeros.select("lang", "source", "c", "size", "p", "p0", "v", "block", "blocks"))
    zeros = zeros.groupBy("lang", "one", "other").applyInArrow(zero_cells, _PAIR)

    pairs = joint.unionByName(zeros).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("_way"), "value").select("lang", "_way.source", F.lit("pair").alias("part"), "_way.item", "value")

    of_source = materialize(info.select("lang", "source", "total", "v", "lang_total", F.col("n_terms").alias("_n")), "totals")
    above = join_skewed(cells, of_source, ["lang", "source"], n)
    above = above.withColumn("value", _share("n", "total") - _share("lang_n", "lang_total")).where("value > 0")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    first = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + {ADD})) // (sum(n) OVER (PARTITION BY lang, source) + {ADD} * count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000::HUGEINT * (lang_n + {ADD})) // (sum(lang_n) OVER (PARTITION BY lang, source) + {ADD} * count(*) OVER (PARTITION BY lang, source)) AS q
  FROM cells),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
