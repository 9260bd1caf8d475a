"""Packing token sequences by cutting-stock column generation.

A document's tokens are cut into full pieces and one remainder. Full pieces are sequences by themselves.
The remainders are a cutting-stock problem over their length histogram: a linear program whose columns
are patterns (how many remainders of each length share a sequence), priced by a knapsack dynamic
program; rounded-down patterns are used as often as the program says and what is left is packed
first-fit. Only the histogram (at most 256 numbers) reaches the driver; ranked remainders then find
their pattern, copy and place by arithmetic."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_ROWS, materialize, salted_rank

CAPACITY = 1024
#: Remainders are planned by length in steps of this many tokens, rounded up: fewer rows for the program,
#: at the price of half a step of padding for each remainder.
STEP = 4
#: Column generation stops when the bound shows that this share of sequences or less could be saved.
GAP = 2e-4
#: ... or after this many columns; the rounding works with any set of columns.
COLUMNS = 3000
#: Pieces of text between spaces whose ids a task remembers.
CACHE = 800_000
#: Characters of texts that are taken apart at a time.
GROUP = 1 << 20
#: White space other than blanks and line breaks.
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
MARKS = ",.!?;:"


# --- tokens -----------------------------------------------------------------------------------


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokens:
    """text -> little-endian 32-bit ids, as tokenizers gives them without special tokens added.

    Where every white space is a lone blank or line break, a byte-level vocabulary's split never crosses the
    place before one, so the text is taken apart there and each part's ids are remembered; new parts are
    encoded together. Texts with other white space or special tokens are encoded whole, and so is every
    text if the vocabulary file names another split or changes texts first."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split = file.get("pre_tokenizer") or {}
        self.apart = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file.get("normalizer") and not file["model"].get("dropout")
        self.mark = dict(zip(MARKS, self._encode(list(MARKS))))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> set[str]:
        """Ids of parts not met yet; a mark behind a letter or digit is a token run of its own. When too many
        are known, those of this group stay. Returns the parts with other white space, which have none."""
        known = self.known
        if len(known) > CACHE:
            known = self.known = {p: known[p] for p in parts if p in known}
        new = parts.difference(known)
        odd = {p for p in new if OTHER_SPACE.search(p)}
        marked = [p for p in new - odd if p[-1] in MARKS and p[-2:-1].isalnum()]
        ask = list((new - odd).difference(marked).union(p[:-1] for p in marked).difference(known))
        known.update(zip(ask, self._encode([p if p[0] == "\n" else " " + p for p in ask])))
        known.update((p, known[p[:-1]] + self.mark[p[-1]]) for p in marked)
        return odd

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; texts are taken in groups, so that new parts are met together."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        split: list[list[str] | None] = []
        met: set[str] = set()
        for t in texts:
            parts = None
            if self.apart and t and not any(s in t for s in self.special):
                parts = t.replace("\n", " \n").split(" ")
                if "" in parts or "\n" in parts:
                    parts = None
                else:
                    met.update(parts[1:])
            split.append(parts)
        odd = self._learn(met)
        get = self.known.__getitem__
        for t, parts in zip(texts, split):
            if parts is None or OTHER_SPACE.search(parts[0]) or (odd and not odd.isdisjoint(parts)):
                yield self._encode([t])[0] if t else b""
            else:  # the first part has no blank before it
                yield self._encode(parts[:1])[0] + b"".join(map(get, parts[1:]))


@functools.lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    """The worker's Tokens: what is known stays from task to task."""
    return Tokens(path)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[int]:
    """CRC-32 of each piece of at most `capacity` ids."""
    step = 4 * capacity
    return [zlib.crc32(ids[a : a + step]) for a in range(0, len(ids), step)]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """docs without text, with doc_tokens (the closing id 0 included) and crcs, one for each piece."""
    ends = np.zeros(1, "<u4").tobytes()

    @F.pandas_udf("struct<n: long, crcs: array<long>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(tokenizer)
        for texts in batches:
            out = []
            for ids in tokens.encode_all([t or "" for t in texts]):
                ids += ends
                out.append((len(ids) // 4, pieces_of(ids, capacity)))
            yield pd.DataFrame(out, columns=["n", "crcs"])

    named = docs.withColumn("_t", encode("text"))
    return named.select(*[c for c in docs.columns if c != "text"], F.col("_t.n").alias("doc_tokens"), F.col("_t.crcs").alias("crcs"))


# --- the cutting-stock plan ---------------------------------------------------------------------


def _price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the greatest worth: an unbounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    small = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if small[c]:
            gain = best[c - lengths[: small[c]]] + worth[: small[c]]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], k
    use, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            use[took[c]] += 1
            c -= lengths[took[c]]
    return float(best[capacity]), use


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each: least total use that covers the demand."""
    m = len(lengths)
    # First-fit decreasing gives a triangular basis: each length's pattern adds only shorter ones, and
    # only as many as are left.
    left, use, basis = demand.copy(), np.zeros(m), np.zeros((m, m))
    for i in range(m - 1, -1, -1):
        n = capacity // lengths[i]
        basis[i, i], use[i] = n, left[i] / n
        left[i], room = 0.0, capacity - n * lengths[i]
        for j in range(np.searchsorted(lengths, room, "right") - 1, -1, -1) if use[i] > 0 else ():
            j = min(j, i - 1)
            if j >= 0 and lengths[j] <= room and basis[i, j] == 0 and (n := min(room // lengths[j], int(left[j] / use[i]))) > 0:
                basis[i, j] = n
                left[j] -= n * use[i]
                room -= n * lengths[j]
    # Sums of products rather than matrix products: the driver's BLAS threads are left alone.
    inverse = np.zeros((m, m))
    for i in range(m - 1, -1, -1):
        inverse[i] = -(basis[i + 1 :, i, None] * inverse[i + 1 :]).sum(axis=0)
        inverse[i, i] += 1
        inverse[i] /= basis[i, i]
    for _ in range(COLUMNS):
        worth = inverse.sum(axis=0)  # every pattern costs one sequence
        value, column = _price(lengths, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-9 or use.sum() * (1 - 1 / value) <= GAP * use.sum():
            break
        direction = (inverse * column).sum(axis=1)
        positive = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[positive] = use[positive] / direction[positive]
        out = int(ratio.argmin())
        step = ratio[out]
        use = use - step * direction
        use[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[out] = column
    return [(np.rint(b).astype(np.int64), float(u)) for b, u in zip(basis, use) if u > 1e-9]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Length histogram -> (copies, {length: how many in each}); the counts add up exactly."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if not left:
        return []
    out: list[tuple[int, dict[int, int]]] = []

    def add(copies: int, pattern: dict[int, int]) -> None:
        out.append((copies, pattern))
        for k, v in pattern.items():
            left[k] -= copies * v

    lengths = np.array(sorted(left))
    for pattern, use in sorted(column_generation(lengths, np.array([left[k] for k in lengths], float), capacity), key=lambda x: -x[1]):
        named = {int(k): int(n) for k, n in zip(lengths, pattern) if n}
        copies = min([int(use + 1e-6), *(left[k] // n for k, n in named.items())])
        if copies > 0:
            add(copies, named)
    # First-fit decreasing for the rest; a pattern is repeated while it lasts.
    while any(left.values()):
        room, pattern = capacity, {}
        for k in sorted((k for k, v in left.items() if v), reverse=True):
            n = min(left[k], room // k)
            if n:
                pattern[k] = n
                room -= n * k
        add(min(left[k] // n for k, n in pattern.items()), pattern)
    return out


def plan_rows(patterns: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each length and pattern: the ranks it takes, its first sequence and its first slot there."""
    rows, sequence, rank = [], 0, {}
    for copies, pattern in patterns:
        slot = 0
        for k in sorted(pattern, reverse=True):
            n = pattern[k]
            rows.append((k, rank.get(k, 0), n, sequence, slot))
            rank[k] = rank.get(k, 0) + copies * n
            slot += n
        sequence += copies
    return pd.DataFrame(rows, columns=["length", "from_rank", "each", "sequence", "slot"]).astype("int64")


# --- pieces -----------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every row of docs (doc_id, text; other columns are left out, whatever their names): doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's ids end with 0, so null and empty texts have one id. Repeated rows and ids are packed
    each for itself. Pieces of a sequence lie gapless from offset 0; sequences are at most capacity
    long. sequence_id counts the shared sequences first, then the full pieces. The plan stops at COLUMNS columns or
    within GAP of the least number of sequences; that bears on padding alone, every piece is placed."""
    spark = docs.sparkSession
    named = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    tokens = materialize(tokenized(named, tokenizer, capacity), "tokens")
    rest = tokens.where(F.col("doc_tokens") % capacity > 0).select("_row", (F.col("doc_tokens") % capacity).cast("long").alias("_rest"))
    rest = rest.withColumn("_class", F.ceil(F.col("_rest") / STEP).cast("long"))
    counts = {r["_class"]: r["count"] for r in rest.groupBy("_class").count().collect()}  # at most capacity / STEP rows
    patterns = plan(counts, capacity // STEP)
    shared = sum(c for c, _ in patterns)
    # The plan has at most a row for each length of each pattern: bounded by the capacity, not by the input.
    by_class = plan_rows(patterns).sort_values("from_rank").groupby("length")
    where = spark.sparkContext.broadcast({k: g[["from_rank", "each", "sequence", "slot"]].to_numpy() for k, g in by_class})

    @F.pandas_udf("struct<sequence_id: long, slot: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(k), 2), np.int64)
        for one in np.unique(k):
            here = np.flatnonzero(k == one)
            at = where.value[int(one)]
            row = at[np.searchsorted(at[:, 0], r[here], "right") - 1]
            copy, slot = np.divmod(r[here] - row[:, 0], row[:, 1])
            out[here, 0], out[here, 1] = row[:, 2] + copy, row[:, 3] + slot
        return pd.DataFrame(out, columns=["sequence_id", "slot"])

    placed = salted_rank(rest, ["_class"], ["_row"], "_rank", sum(counts.values())).withColumn("_p", place("_class", "_rank"))
    before = Window.partitionBy("_sequence").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("_row").alias("_r"), F.col("_p.sequence_id").alias("_sequence"), F.col("_p.slot").alias("_slot"), "_rest")
    placed = placed.select("_r", "_sequence", F.coalesce(F.sum("_rest").over(before), F.lit(0)).alias("_offset"))
    full = (F.col("doc_tokens") / capacity).cast("long")
    # Where each document's full pieces begin: sums by parts of the rows, then within a part.
    parts = max(256, tokens.count() // PART_ROWS)
    part = F.pmod(F.xxhash64("_row"), F.lit(parts))
    fulls = tokens.select("_row", part.alias("_part"), full.alias("_full"))
    by_part = fulls.groupBy("_part").agg(F.sum("_full").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows
    by_part = by_part.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    begun = fulls.join(F.broadcast(by_part), "_part").select(
        F.col("_row").alias("_b"), (F.col("_base") + F.coalesce(F.sum("_full").over(inside), F.lit(0)) + shared).alias("_first")
    )
    all_rows = tokens.join(placed.hint("merge"), F.col("_row") == F.col("_r"), "left").join(begun.hint("merge"), F.col("_row") == F.col("_b"))
    pieces = all_rows.select("doc_id", "doc_tokens", "_sequence", "_offset", "_first", full.alias("_full"), F.posexplode("crcs").alias("_k", "ids_crc32"))
    start = F.col("_k").cast("long") * capacity
    is_full = F.col("_k") < F.col("_full")
    return pieces.select(
        "doc_id",
        start.alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - start).alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(is_full, F.col("_first") + F.col("_k")).otherwise(F.col("_sequence")).alias("sequence_id"),
        F.when(is_full, F.lit(0).cast("long")).otherwise(F.col("_offset")).alias("offset"),
    )


def op7_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from .common import ship, table

    ship(spark)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
