"""Exact removal of long repeated byte strings, by merging Burrows-Wheeler transforms of shards.

1. Every 200-byte window of a text is named by the least hash of its 32-byte substrings; windows of
   one name that follow each other form a fragment. Equal windows have equal names wherever they
   stand, so fragments of a name hold all places where its windows can repeat.
2. Names and checksums of fragments are shuffled without text. Names that stand once drop out; a name whose
   fragments are all equal is settled by their number. Of the other names one fragment of each kind is cut out.
3. Kinds are gathered by name and dealt to shards in their task. Each shard has its own Burrows-Wheeler transform
   with the depths at which neighbours part. The transforms are merged by refining their interleave:
   blocks of suffixes that agree to some depth are split by the blocks of the suffixes that follow
   them, reached through the transform itself. A round takes one entry for each block of a shard, and
   only in blocks that more than one shard still shares; no suffixes are sorted again.
4. Blocks at depth 200 with two suffixes or more are the repeated strings; their windows are
   mapped back to all owners of the kind.

A name with more bytes of different fragments than a task should merge (a passage in very many documents, with
as many different edges) is crowded: checksums of the single windows of its fragments are settled by their number.
They travel packed, a row for each name, part of the checksums and batch of texts, never a row for each window;
a name has as many parts as its bytes ask for, so no task holds it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_skewed, stored

LENGTH = 200
GRAM = 32
#: A suffix is ordered to these depths in turn; the last step may overlap the one before.
FIRST = 7
#: Bytes of fragments merged at a time, and shards they are dealt to.
BIN_BYTES = 1 << 19
SHARDS = 4
#: Bytes of different fragments from which a name is crowded.
NAME_BYTES = 1 << 17
#: Bytes of different fragments of a crowded name for each part of its window checksums.
PART_BYTES = 1 << 21

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def depths(length: int = LENGTH) -> list[int]:
    out = [min(FIRST, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


# --- windows and their names -------------------------------------------------------------------


def window_names(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one name: names, first windows, the windows after the last, and whether a
    run may repeat itself (only if the substring that names it stands in it twice)."""
    n = len(data) - length + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).astype(np.uint64)
    grams = len(data) - gram + 1
    h = words[:grams] * _MIX[0]
    for k in range(1, gram // 8):
        h ^= h >> np.uint64(31)
        h += words[8 * k : 8 * k + grams] * _MIX[k % 4]
        h *= _MIX[(k + 1) % 4]
    h ^= h >> np.uint64(29)
    own, span, width = h, length - gram + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    # Of two equal windows of a run, the first naming substring of one starts a window of the run, and the
    # last one of the other ends a window of the run.
    first, last = np.full(len(start), len(data)), np.full(len(start), -1)
    heads = np.flatnonzero(own[:n] == h)
    tails = np.flatnonzero(own[span - 1 :] == h)
    first[np.searchsorted(start, heads[::-1], "right") - 1] = heads[::-1]
    last[np.searchsorted(start, tails, "right") - 1] = tails + span - 1
    return h[start].view(np.int64), start, np.append(start[1:], n), first < last


def _print(part: bytes) -> int:
    """A signed 64-bit checksum."""
    return int.from_bytes(xxhash.xxh64_digest(part), "big", signed=True)


RUN = "name long, print long, doc_id {id}, text_hash long, first int, stop int, inner boolean"


def _named(length: int):
    """Texts -> their runs (RUN): print is the checksum of the fragment, the bytes of all windows of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, texts = (b.column(i) for i in range(3))
            out, prints, rows, held = [], [], [], 0

            def flush():
                name, start, end, inner = (np.concatenate(x) for x in zip(*out))
                at = pa.array(np.repeat([r for r, _ in rows], [n for _, n in rows]))
                columns = [pa.array(name), pa.array(prints, pa.int64()), ids.take(at), hashes.take(at), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(inner)]
                return pa.RecordBatch.from_arrays(columns, ["name", "print", "doc_id", "text_hash", "first", "stop", "inner"])

            for i in range(b.num_rows):
                data = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                runs = window_names(data, length)
                if len(runs[0]):
                    out.append(runs)
                    rows.append((i, len(runs[0])))
                    held += len(runs[0])
                    view = memoryview(data)
                    prints += [_print(view[s:e]) for s, e in zip(runs[1].tolist(), (runs[2] + length - 1).tolist())]
                if held > 100_000:
                    yield flush()
                    out, prints, rows, held = [], [], [], 0
            if out:
                yield flush()

    return run


CUT = "name long, print long, n long, part binary, slice int, windows binary, prints binary, times binary, places binary"


def _cut(length: int):
    """Texts with the kinds to cut from them -> rows (CUT): name, print, n and part for each kind; where the name is crowded
    (slices > 0), in place of them the windows of all its kinds packed by slice of their checksums: windows (checksums), and
    for each window the print and n of its kind and its place there (int64, places int32)."""

    def packed(name: int, slices: int, kinds: list[tuple]) -> Iterator[tuple]:
        windows = np.concatenate([k[2] for k in kinds])
        sizes = [len(k[2]) for k in kinds]
        prints, times = (np.repeat(np.array([k[i] for k in kinds], np.int64), sizes) for i in (0, 1))
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        to = (windows.view(np.uint64) % np.uint64(slices)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            yield (name, None, None, None, int(to[own[0]]), *(c[own].tobytes() for c in (windows, prints, times, places)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kinds, out, crowds, held = b.column(0), b.column(1), [], {}, 0

            def flush():
                rows = [*out, *(row for (name, slices), own in crowds.items() for row in packed(name, slices, own))]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in CUT.split(", ")])

            for i in range(b.num_rows):
                data = texts[i].as_buffer().to_pybytes()
                for k in kinds[i].as_py():
                    part = data[k["first"] : k["stop"] + length - 1]
                    if not k["slices"]:
                        out.append((k["name"], k["print"], k["n"], part, *[None] * 5))
                        held += len(part)
                    else:
                        windows = np.array([_print(part[at : at + length]) for at in range(len(part) - length + 1)], np.int64)
                        crowds.setdefault((k["name"], k["slices"]), []).append((k["print"], k["n"], windows))
                        held += 28 * len(windows)
                    if held > 8 << 20:
                        yield flush()
                        out, crowds, held = [], {}, 0
            if out or crowds:
                yield flush()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed windows (name, slice, windows, prints, times, places) sorted by name and slice -> (name, print, n, at): the
    places of a kind whose windows count more than once. One slice of a name is held at a time."""
    types = (np.int64, np.int64, np.int64, np.int32)
    key, rows = None, []

    def repeated() -> pa.RecordBatch:
        windows, prints, times, places = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate(types))
        _, which = np.unique(windows, return_inverse=True)
        again = np.flatnonzero(np.bincount(which, times)[which] > 1)
        again = again[np.argsort(prints[again], kind="stable")]
        prints, times, places = prints[again], times[again], places[again]
        starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.empty(0, np.int64)
        at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(prints)), pa.int32()), pa.array(places))
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(starts), pa.int64()), pa.array(prints[starts]), pa.array(times[starts]), at], ["name", "print", "n", "at"])

    for batch in batches:
        for name, part, *columns in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if rows and (name, part) != key:
                yield repeated()
                rows.clear()
            key = (name, part)
            rows.append(columns)
    if rows:
        yield repeated()


# --- transforms and their merging -------------------------------------------------------------


class ShardBwt:
    """The Burrows-Wheeler transform of fragments, each closed by an end mark (0) and read as a cycle.

    bwt: the symbol before each rotation in sorted order; parts[i]: at which of the depths rotation i
    differs from the one before it (len(depths): at none of them); at: where each starts in the shard."""

    def __init__(self, fragments: list[bytes], length: int = LENGTH):
        steps = depths(length)
        size = np.array([len(f) + 1 for f in fragments])
        start = np.cumsum(size) - size
        n = int(size.sum())
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[start + size - 1] = False
        text[body] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.int64) + 1
        home, cycle = np.repeat(start, size), np.repeat(size, size)
        offset = np.arange(n) - home

        def later(k: int) -> np.ndarray:
            at = offset + k
            if k >= size.min():
                return home + at % cycle
            at[at >= cycle] -= cycle[at >= cycle]
            return home + at

        key, symbol, following = np.zeros(n, np.int64), text, later(1)
        for _ in range(steps[0]):
            key = key * 257 + symbol
            symbol = symbol[following]
        self.parts = np.full(n, len(steps), np.int8)
        depth, level = steps[0], 0
        while True:
            order = np.argsort(key)
            ordered = key[order]
            differs = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            if level < len(steps):
                self.parts[differs & (self.parts > level)] = level
            if depth >= size.max() or level >= len(steps) - 1 and differs.all():
                break
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(differs) - 1
            level += 1
            step = (steps[level] - depth) if level < len(steps) else depth
            key = rank * n + rank[later(step)]
            depth += step
        self.at = order
        previous = order - 1
        first = offset[order] == 0
        previous[first] = (home + cycle - 1)[order[first]]
        self.bwt = text[previous].astype(np.int16)
        # For each rotation, the one that starts a symbol later: the stable order of the symbols of bwt.
        self._later = [np.argsort(self.bwt, kind="stable")]

    def leap(self, at: np.ndarray, n: int) -> np.ndarray:
        """For the rotations at, those that start n symbols later, by powers of two."""
        k = 0
        while n >> k:
            if len(self._later) <= k:
                self._later.append(self._later[-1][self._later[-1]])
            if n >> k & 1:
                at = self._later[k][at]
            k += 1
        return at

    def begins(self, n: int) -> np.ndarray:
        """The first n symbols of each rotation, packed into a number."""
        symbols, at = np.sort(self.bwt, kind="stable").astype(np.int64), np.arange(len(self.bwt))
        out = np.zeros(len(at), np.int64)
        for _ in range(n):
            out = out * 257 + symbols[at]
            at = self._later[0][at]
        return out


def merged_repeats(shards: list[ShardBwt], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard and sorted rotation: does its string of `length` start at another one too?

    A block's number is its place in the merged order. A round splits the blocks that several shards
    share by the blocks that follow; blocks of one shard alone are settled and keep their number."""
    steps = depths(length)
    firsts = [s.begins(steps[0]) for s in shards]
    merged = np.sort(np.concatenate(firsts), kind="stable")
    block = [np.searchsorted(merged, f) for f in firsts]
    shared = _shared(block, [np.ones(len(b), bool) for b in block], len(merged))
    for level in range(1, len(steps)):
        heads, sizes, here, after, who = [], [], [], [], []
        for k, s in enumerate(shards):
            head = np.flatnonzero(s.parts <= level)
            size = np.diff(np.append(head, len(s.parts)))
            live = shared[k][head]
            head, size = head[live], size[live]
            heads.append(head)
            sizes.append(size)
            here.append(block[k][head])
            after.append(block[k][s.leap(head, steps[level] - steps[level - 1])])
            who.append(np.full(len(head), k, np.int8))
        h, a, w, z = (np.concatenate(x) for x in (here, after, who, sizes))
        if not len(h):
            break
        order = np.argsort(h * len(merged) + a, kind="stable")  # entries of one shard keep their order
        ho, ao, wo, zo = h[order], a[order], w[order], z[order]
        outer = np.concatenate([[True], ho[1:] != ho[:-1]])
        inner = outer | np.concatenate([[True], (ao[1:] != ao[:-1]) | (wo[1:] == wo[:-1])])
        began = np.cumsum(zo) - zo
        number = np.empty(len(h), np.int64)
        number[order] = ho + began[inner][np.cumsum(inner) - 1] - began[outer][np.cumsum(outer) - 1]
        cut = np.cumsum([len(x) for x in heads])[:-1]
        for k, (head, size, num) in enumerate(zip(heads, sizes, np.split(number, cut))):
            block[k][np.flatnonzero(shared[k])] = np.repeat(num, size)
        shared = _shared(block, shared, len(merged))
    out = []
    for k, s in enumerate(shards):
        head = np.flatnonzero(s.parts < len(steps))
        size = np.diff(np.append(head, len(s.parts)))
        out.append(np.repeat(size > 1, size) | shared[k])
    return out


def _shared(block: list[np.ndarray], among: list[np.ndarray], total: int) -> list[np.ndarray]:
    """Which rotations, of those among, stand in a block that another shard has a part of."""
    shards = np.zeros(total, np.int16)
    for b, m in zip(block, among):
        here = np.zeros(total, bool)
        here[b[m]] = True
        shards += here
    return [m & (shards[b] > 1) for b, m in zip(block, among)]


def repeated_windows(fragments: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each fragment: which of its windows stand anywhere else in the fragments."""
    dealt = [list(range(k, len(fragments), shards)) for k in range(min(shards, len(fragments)))]
    built = [ShardBwt([fragments[i] for i in d], length) for d in dealt]
    out: list[np.ndarray] = [np.empty(0, bool)] * len(fragments)
    for d, s, again in zip(dealt, built, merged_repeats(built, length)):
        by_place = np.empty(len(again), bool)
        by_place[s.at] = again
        end = 0
        for i in d:
            out[i] = by_place[end : end + len(fragments[i]) - length + 1]
            end += len(fragments[i]) + 1
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _compared(length: int):
    """Kinds (name, print, n, part) sorted by name and print -> (name, print, n, spans): what of a kind repeats.

    Whole names are gathered up to BIN_BYTES, then merged together; the bytes of a name are bounded by NAME_BYTES."""
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[tuple[int, int, int, bytes]] = []
        held = 0

        def merge() -> pa.RecordBatch:
            nonlocal held
            found = []
            for (_, _, n, part), flags in zip(kinds, repeated_windows([k[3] for k in kinds], length)):
                spans = [(0, len(part))] if n > 1 else [(a, b + length - 1) for a, b in _runs(flags)]
                found.append([{"begin": a, "end": b} for a, b in spans])
            columns = [pa.array([k[i] for k in kinds], pa.int64()) for i in range(3)]
            kinds.clear()
            held = 0
            return pa.RecordBatch.from_arrays([*columns, pa.array(found, span)], ["name", "print", "n", "spans"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if kinds and row[:2] == kinds[-1][:2]:
                    continue  # the same kind, cut from each of several equal rows
                if held > BIN_BYTES and row[0] != kinds[-1][0]:
                    yield merge()
                kinds.append(row)
                held += len(row[3])
        if kinds:
            yield merge()

    return run


# --- documents --------------------------------------------------------------------------------


def _crowded_spans(packed: DataFrame, length: int) -> DataFrame:
    """Packed windows of crowded names -> (name, print, n, spans): windows that are counted more than once."""
    dealt = packed.repartition("name", "slice").sortWithinPartitions("name", "slice")
    hits = dealt.mapInArrow(_counted, "name long, print long, n long, at array<int>")
    by_kind = hits.groupBy("name", "print").agg(F.max("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("places"))
    # Places that follow each other make one span: a step above 1 ends it.
    ends = F.filter(F.col("places"), lambda p, i: F.coalesce(F.get("places", i + 1) > p + 1, F.lit(True)))
    begins = F.filter(F.col("places"), lambda p, i: F.coalesce(F.get("places", i - 1) < p - 1, F.lit(True)))
    spans = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.struct(x["b"].alias("begin"), (x["e"] + length).alias("end")))
    return by_kind.select("name", "print", "n", spans.alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_hash, spans): byte spans (begin, end) that repeat; they may overlap.

    A row for each pair of doc_id and text of which anything repeats. The tables between are deleted."""
    spark, tail = docs.sparkSession, length - 1
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.octet_length("text") >= length)
    runs, runs_at = stored(keyed.mapInArrow(_named(length), RUN.format(id=id_type)), "runs")
    names = runs.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.max("inner").alias("inner"), F.min("print").alias("lo"), F.max("print").alias("hi"))
    names = names.where("_n > 1 or inner").select("name", "_n", (~F.col("inner") & (F.col("lo") == F.col("hi"))).alias("settled"))
    names, names_at = stored(names, "names")
    owners = join_skewed(runs.drop("inner"), names, ["name"], runs.count())
    owners, owners_at = stored(owners, "owners")

    rest = owners.where("not settled")
    kinds = rest.groupBy("name", "print").agg(F.min(F.struct("doc_id", "text_hash", "first", "stop")).alias("one"), F.count(F.lit(1)).alias("n"))
    kinds, kinds_at = stored(kinds.select("name", "print", "n", "one.*"), "kinds")
    size = (F.col("stop") - F.col("first") + tail).cast("long")
    slices = F.when(F.sum(size) > NAME_BYTES, F.ceil(F.sum(size) / PART_BYTES)).otherwise(0).cast("int")
    crowds = kinds.groupBy("name").agg(slices.alias("slices"), F.count(F.lit(1)).alias("_n"))
    marked = join_skewed(kinds, crowds, ["name"], kinds.count())
    wanted = marked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("name", "print", "n", "first", "stop", "slices")).alias("kinds"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "kinds")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    cut = keyed.join(wanted.hint("merge"), same).select("text", "kinds").mapInArrow(_cut(length), CUT)
    parts, parts_at = stored(cut, "parts")

    dealt = parts.where("part is not null").select("name", "print", "n", "part").repartition("name").sortWithinPartitions("name", "print")
    compared = dealt.mapInArrow(_compared(length), "name long, print long, n long, spans array<struct<begin: int, end: int>>")
    found = compared.unionByName(_crowded_spans(parts.where("part is null").select("name", "slice", "windows", "prints", "times", "places"), length))
    found, found_at = stored(found.where(F.size("spans") > 0).withColumnRenamed("n", "_n"), "found")

    moved = F.transform("spans", lambda x: F.struct((x["begin"] + F.col("first")).alias("begin"), (x["end"] + F.col("first")).alias("end")))
    theirs = join_skewed(rest.drop("settled"), found, ["name", "print"], rest.count()).select("doc_id", "text_hash", F.inline(moved))
    whole = owners.where("settled").select("doc_id", "text_hash", F.col("first").alias("begin"), (F.col("stop") + tail).alias("end"))
    spans = theirs.unionByName(whole).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans, _ = stored(spans, "spans")
    for path in (runs_at, names_at, owners_at, kinds_at, parts_at, found_at):
        discard(spark, path)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with `kept` (binary, the UTF-8 bytes that stay) and `spans` (array<struct<begin,end>>, what
    went, in bytes, maximal and in order). A row for each row of docs, other columns as they are.

    A byte goes if a string of `length` bytes over it also starts anywhere else in docs, the same
    document included. Columns of docs named kept or spans are replaced, others keep their values (but for names
    that begin with _repeat_, which are not allowed). Null texts count as empty; shorter texts stay whole;
    equal rows go together."""
    docs = docs.drop("kept", "spans")
    found = repeated_spans(docs, length).select(F.col("doc_id").alias("_repeat_d"), F.col("text_hash").alias("_repeat_h"), F.col("spans").alias("_repeat_found"))

    @F.pandas_udf("struct<kept: binary, spans: array<struct<begin: int, end: int>>>")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        kept, spans = [], []
        for text, pairs in zip(texts, found):
            data = (text or "").encode()
            joined: list[list[int]] = []
            if pairs is not None and len(pairs):
                for p in sorted(((p["begin"], p["end"]) for p in pairs)):
                    if joined and p[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], p[1])
                    else:
                        joined.append([*p])
            edges = [0, *(x for p in joined for x in p), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"begin": a, "end": b} for a, b in joined])
        return pd.DataFrame({"kept": kept, "spans": spans})

    same = F.col("doc_id").eqNullSafe(F.col("_repeat_d")) & (F.xxhash64("text") == F.col("_repeat_h"))
    joined = docs.join(found.hint("merge"), same, "left")
    return joined.withColumn("_repeat_cut", cut("text", "_repeat_found")).select(*docs.columns, "_repeat_cut.kept", "_repeat_cut.spans")


def whole_characters(kept) -> F.Column:
    """Kept bytes as text, without the parts of code points that a cut went through."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([v.decode("utf-8", "ignore") for v in values], dtype=object)

    return decode(kept)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
