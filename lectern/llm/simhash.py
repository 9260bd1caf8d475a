"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

The 64 bits form a ring of five segments. If two fingerprints differ in at most four bits, the
segments' differences average at most 4/5, so some start on the ring has every chain of l
consecutive segments within its share: floor(4 l / 5) = 0, 1, 2, 3, 4 bits. Candidates are found
by the first two links of that chain (one equal segment, the next within one bit), then the longer
chains are checked, and only what is left is compared in full.

The pipeline's stage (keep_first) takes these links first and confirms each on the exact sets. Four bits miss most
pairs of a Jaccard similarity of 0.8, so bands of least shingle hashes then bring together what the fingerprints leave apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, join_skewed, materialize
from .components import components

SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
BITS = 4
#: Runs of one key up to this length are compared by shifts; longer ones by elimination.
SHORT_RUN = 24
#: Bands of least hashes that bring sets of shingles together, and hashes in a band.
BANDS, BAND_ROWS = 24, 4
#: Partners that a node of a longer run gets at first in each band; the run's order is another one in each. What
#: that leaves apart is compared in blocks of about BLOCK_HASHES hashes and BLOCK_ROWS sets at most (crowd_links).
PARTNERS, BLOCK_HASHES, BLOCK_ROWS = 48, 1 << 19, 1024
#: Links that a node far down a long run gets at most there, besides the run's first node.
LINKS = 2
#: Bytes of a set's parity sketch.
PARITY_BYTES = 64
#: Rows of a band key from which a hot one is divided.
SPLIT_ROWS = 50_000
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

#: For a hash's eight bytes: which of the eight bits a byte value sets.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the width-word shingles of text, with repeats; fewer words than width are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of width-word shingles with repeats; 0 without words."""
    return _majority(shingle_hashes(text, width))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    at = (hashes.view(np.uint8).reshape(n, 8) + _BYTE_AT).ravel()
    counts = np.bincount(at, minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (counts.ravel() * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row of docs."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select("doc_id", prints("text").alias("fp"))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(OFFSETS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _viable(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of XORs x and chain starts on the ring: whether all chains and the whole stay in budget."""
    by_segment = np.stack([np.bitwise_count(_segment(x, i)) for i in range(5)])
    total = np.zeros(len(x), np.int64)
    ok = np.ones(len(x), bool)
    for l in range(1, 6):
        total += by_segment[(start + l - 1) % 5, np.arange(len(x))]
        ok &= total <= BITS * l // 5
    return ok


def _stars(fps: np.ndarray) -> np.ndarray:
    """Links that join exactly the groups of fps reachable by steps of at most BITS bits.

    A found point leaves the list that later points are compared with, so a dense group costs
    little more than one pass; each group becomes a star around its least member."""
    left, links = np.unique(fps), []
    while len(left):
        group, todo = [left[:1]], [left[0]]
        left = left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= BITS
            if near.any():
                group.append(left[near])
                todo.extend(left[near])
                left = left[~near]
        members = np.concatenate(group)
        if len(members) > 1:
            root = members.min()
            links.append(np.stack([members[members != root], np.full(len(members) - 1, root)], axis=1))
    return np.concatenate(links) if links else np.empty((0, 2), np.uint64)


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, fp) sorted by part -> links (u, v) between fingerprints that share a part."""
    rest: list[pa.RecordBatch] = []  # the run that is being read

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        part, key, fp = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in range(3))
        fp = fp.view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(edge, len(part)))
        found = []
        short = np.repeat(size <= SHORT_RUN, size)
        for t in range(1, min(SHORT_RUN, int(size.max(initial=0)))):
            at = np.flatnonzero((part[t:] == part[:-t]) & short[t:])
            if not len(at):
                break
            x = fp[at] ^ fp[at + t]
            ok = _viable(x, ((key[at] >> 1) & 7).astype(np.int64)) & (x != 0)
            found.append(np.stack([fp[at[ok]], fp[at[ok] + t]], axis=1))
        for a, n in zip(edge[size > SHORT_RUN], size[size > SHORT_RUN]):
            found.append(_stars(fp[a : a + n]))
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
        pairs = pairs.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0)
        last = part[b.num_rows - 1].as_py()
        if part[0].as_py() == last and (not rest or rest[-1].column(0)[0].as_py() == last):
            rest.append(b)  # the whole batch belongs to the run
            continue
        cut = int(np.searchsorted(part.to_numpy(zero_copy_only=False), last))
        yield links([*rest, b.slice(0, cut)])
        rest = [b.slice(cut)]
    if rest:
        yield links(rest)


def chain_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the places where the first two links of a chain can meet, for each start on the ring.

    Key: both segments, the start and a kind. Kind 0 holds the next segment as it is. Kind 1 joins
    those one bit apart: their parities differ, so even ones stand at their value and odd ones at
    each value one bit away."""
    keys = []
    for i in range(5):
        j = (i + 1) % 5
        seg = lambda k: F.shiftrightunsigned(F.col("fp"), OFFSETS[k]).bitwiseAND((1 << WIDTHS[k]) - 1)
        base = F.shiftleft(seg(i), 17).bitwiseOR(F.lit(i << 1).cast("long"))
        key = lambda value, kind: F.shiftleft(value, 30).bitwiseOR(base).bitwiseOR(F.lit(kind).cast("long"))  # noqa: E731, B023
        flips = F.array(*[key(seg(j).bitwiseXOR(F.lit(1 << b).cast("long")), 1) for b in range(WIDTHS[j])])
        odd = F.bit_count(seg(j)) % 2 == 1
        keys.append(F.concat(F.array(key(seg(j), 0)), F.when(odd, flips).otherwise(F.array(key(seg(j), 1)))))
    return fps.select(F.explode(F.concat(*keys)).alias("key"), "fp")


#: Of fingerprints, one in SAMPLED is counted to find keys that many share; keys with more than CROWD of those are divided.
SAMPLED, CROWD = 64, 64
#: What the rest of a fingerprint is divided into for such keys. Four bits leave two of six pieces as they are.
PIECES = 6


def _divided(keys: DataFrame) -> DataFrame:
    """(key, fp) -> (part, key, fp): fingerprints of a crowded key meet where two of the PIECES of their 64 bits
    are equal too, which no two within BITS bits can miss. So no task compares a whole crowd, and the
    crowd's own dense groups stay together."""
    some = keys.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(SAMPLED)) == 0)
    counts = some.groupBy("key").count()
    # At most SAMPLED * 1000 keys by the second condition: a key that holds over a 64,000th of the sample.
    total = some.count()
    crowded = counts.where((F.col("count") > CROWD) & (F.col("count") * (SAMPLED * 1000) > total)).select(F.col("key").alias("_crowded"))
    edges = [64 * i // PIECES for i in range(PIECES + 1)]
    piece = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    pairs = [F.xxhash64("key", F.lit(i * PIECES + j), piece[i], piece[j]) for i in range(PIECES) for j in range(i)]
    marked = keys.join(F.broadcast(crowded), F.col("key") == F.col("_crowded"), "left")
    part = F.explode(F.when(F.col("_crowded").isNull(), F.array(F.col("key"))).otherwise(F.array(*pairs)))
    return marked.select(part.alias("part"), "key", "fp")


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect exactly those reachable from each other
    by steps of at most four bits. Within a large group of near copies only a star is given."""
    dealt = _divided(chain_keys(fps)).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(_link_runs, "u long, v long")


def _named(nodes: DataFrame, edges: DataFrame, node: str, total: int) -> DataFrame:
    """nodes (node, first, _n) and links between them -> (node, component, _n): the least `first` of all that are
    reachable. total: how many nodes there are."""
    joined = components(edges).select(F.col("node").alias("_node"), "root")
    placed = nodes.join(joined.hint("merge"), F.col(node) == F.col("_node"), "left").select(node, "first", "_n", F.coalesce("root", node).alias("root"))
    placed = materialize(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("_n"))
    return join_skewed(placed.withColumnRenamed("_n", "_rows"), least, ["root"], total).select(node, "component", F.col("_rows").alias("_n"))


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs (doc_id, text; other columns are left out) -> (doc_id, fp, component_id), a row for each row of docs.

    component_id is the smallest doc_id reachable over fingerprints at most four bits apart. Null and
    empty texts have fingerprint 0 and are linked like any other. Equal doc_ids keep their rows. A null
    doc_id takes part but never names a component (null only if the whole component has no id)."""
    prints = materialize(fingerprints(docs, width), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")), "nodes")
    distinct, rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    named = materialize(_named(nodes, links(nodes.select("fp")), "fp", distinct), "components")
    return join_skewed(prints, named, ["fp"], rows).select("doc_id", "fp", F.col("component").alias("component_id"))


# --- near copies by exact similarity, for the pipeline's stage -----------------------------------


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes: each joins BAND_ROWS least values under random orders."""
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[a : a + 1024, None] * _ORDERS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return key


def shingle_set(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """A name of the set of shingles of text (equal sets, equal names; 0 without words), and the set."""
    return _named_set(shingle_hashes(text, width))


def _named_set(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    hashes = np.unique(hashes)
    return (xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0), hashes


def parity(hashes: np.ndarray) -> bytes:
    """A set's parity sketch: each hash turns one of the bits. Of two sketches at most as many bits differ as hashes stand
    in only one of the sets."""
    turned = np.bincount((hashes % np.uint64(8 * PARITY_BYTES)).astype(np.int64), minlength=8 * PARITY_BYTES)
    return np.packbits(turned.astype(np.uint8) & 1).tobytes()


def _candidate_runs(batches: Iterator[pa.RecordBatch], partners: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n) sorted by key, a key's in a random order -> pairs (u, v) of nodes with a key in common whose
    sizes allow a Jaccard similarity of 0.8. Longer runs than partners give each node its next ones and the run's first.
    A fourth column, near, names groups that are linked already: within one no pair is given. With a fifth, parity,
    no pair is given whose sketches differ too much for 0.8, and of its next ones a node behind the first of a longer run gets the
    LINKS closest that may be similar.

    Of what went before, the last `partners` rows and the first row of the open run are held, so a run of any length takes no
    more memory than a batch and its pairs."""
    tail = None
    begun, head = 0, None  # rows of the open run so far; its first row

    def fitting(u: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
        """Of rows u and v (key, node, n, near, parity): whether a pair is to be given."""
        (_, a, na, ga, pa_), (_, b, nb, gb, pb) = u, v
        ok = (np.minimum(na, nb) * 5 >= np.maximum(na, nb) * 4) & (a != b) & (ga != gb)
        if pa_.shape[1]:
            maybe = np.flatnonzero(ok)
            differ = np.bitwise_count(pa_[maybe] ^ pb[maybe]).sum(axis=1, dtype=np.int64)
            ok[maybe] = differ * 9 <= na[maybe] + nb[maybe]
        return ok

    def pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(min(4, b.num_columns))]
        if b.num_columns < 4:
            new.append(new[1])  # without groups each node is its own
        sketches = b"".join(b.column(4).to_pylist()) if b.num_columns > 4 else b""
        new.append(np.frombuffer(sketches, np.uint64).reshape(b.num_rows, -1) if sketches else np.empty((b.num_rows, 0), np.uint64))
        tail = tail or [x[:0] for x in new]
        old = len(tail[0])
        key = new[0]
        start = np.append(0, 1 + np.flatnonzero(key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        first, before = [x[start].copy() for x in new], np.zeros(len(start), np.int64)
        if head is not None and head[0] == key[0]:  # the open run goes on
            before[0] = begun
            for x, y in zip(first, head):
                x[0] = y
        place = np.arange(len(key)) - np.repeat(start - before, size)  # of each row in its run
        both = [np.concatenate([r, x]) for r, x in zip(tail, new)]
        key, given = both[0], np.zeros(old + b.num_rows, np.int64)
        for t in range(1, partners + 1):
            low = max(old - t, 0)  # the later row of a pair is new
            if low + t >= len(key):
                break
            at = low + np.flatnonzero(key[low + t :] == key[low : len(key) - t])
            if not len(at):
                break
            if sketches:
                at = at[(place[at + t - old] <= partners) | (given[at + t] < LINKS)]
            at = at[fitting([x[at] for x in both], [x[at + t] for x in both])]
            given[at + t] += 1
            yield pairs(both[1][at], both[1][at + t])
        far = np.flatnonzero(place > partners)
        if len(far):
            run = np.repeat(np.arange(len(start)), size)[far]
            ok = fitting([x[run] for x in first], [x[far] for x in new])
            yield pairs(first[1][run[ok]], new[1][far[ok]])
        begun, head = int(place[-1]) + 1, [x[-1].copy() for x in first]
        tail = [x[max(0, len(x) - partners) :].copy() for x in both]


def _dealt(nodes: DataFrame) -> DataFrame:
    """(key, node, n, near, parity) dealt and sorted by band key, a key's nodes in a random order. A key with over a thousandth of the rows
    and over SPLIT_ROWS of them, of which there are fewer than a thousand, is divided into parts with keys of their own:
    what its parts leave apart is crowd_links' to join."""
    held = nodes.select(F.explode("keys").alias("key"), "node", "n", "near", "parity")
    total = nodes.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    long = held.groupBy("key").count().where((F.col("count") > SPLIT_ROWS) & (F.col("count") * 1000 > total))
    long = materialize(long.select("key", F.ceil(F.col("count") / SPLIT_ROWS).cast("int").alias("_parts")), "long-runs")
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("_parts"))
    key = F.when(part > 0, F.xxhash64("key", part)).otherwise(F.col("key"))
    rows = held.join(F.broadcast(long), "key", "left").select(key.alias("key"), "node", "n", "near", "parity")
    return rows.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "node"))


def _similar_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (node, root, own, hashes) -> links (u, v) between the roots' rows that hang together by steps of 0.8 or by
    equal roots: one link for each root, as a star. Steps between two rows that are not own are left to another block."""
    node, root, own = (rows[c].to_numpy() for c in ("node", "root", "own"))
    sizes = np.array([len(h) for h in rows["hashes"]], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    token, at, held = np.unique(np.concatenate([np.asarray(h, np.int64) for h in rows["hashes"]]), return_inverse=True, return_counts=True)
    place = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[at]  # hashes of one row only are shared with nobody
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((len(rows), len(rows)), np.float32)
    for a in range(0, int(place.max(initial=-1)) + 1, 4096):
        low, high = np.searchsorted(place, [a, a + 4096])
        has = np.zeros((len(rows), 4096), np.float32)
        has[owner[low:high], place[low:high] - a] = 1
        shared += has @ has.T
    near = (shared * 9 >= (sizes[:, None] + sizes) * 4) & (own[:, None] | own) | (root[:, None] == root)
    left, links = np.ones(len(rows), bool), []
    for start in range(len(rows)):
        if not left[start]:
            continue
        reached = np.zeros(len(rows), bool)
        edge = np.arange(len(rows)) == start
        while edge.any():
            reached |= edge
            edge = near[edge].any(axis=0) & ~reached
        left &= ~reached
        hit = np.flatnonzero(reached)
        firsts = hit[np.unique(root[hit], return_index=True)[1]]
        links += [(node[start], node[k]) for k in firsts if root[k] != root[start]]
    return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)


def _crowds(nodes: DataFrame, partners: int) -> DataFrame:
    """(key, node, n) of the band keys that more nodes hold than _candidate_runs compares with one another."""
    held = nodes.select(F.explode("keys").alias("key"), "node", "n")
    many = held.groupBy("key").count().where(F.col("count") > partners + 1).select("key")
    return held.join(many.hint("merge"), "key")


def crowd_links(crowds: DataFrame, sets: DataFrame, sure: DataFrame, block_hashes: int) -> DataFrame:
    """Links (u, v) between those nodes of crowded keys that are similar and that the links of sure leave apart.

    crowds: _crowds; sets: want, hashes. Only keys whose nodes are not yet one component go on, divided by size (two
    sets at 0.8 differ by a factor of 1.25 at most, so they stand in one class of the powers of 1.26 or in neighbouring
    ones), and then every two blocks of a key and class meet in one task. Blocks are bounded by their hashes and sets."""
    size_class = F.floor(F.log(1.26, F.greatest("n", F.lit(1)))).cast("int")
    parts = crowds.join(components(sure).hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"), size_class.alias("_c"))
    parts = parts.select("*", F.explode(F.array("_c", F.col("_c") + 1)).alias("part")).withColumn("own", F.col("_c") == F.col("part")).drop("_c")
    apart = parts.groupBy("key", "part").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.sum(F.greatest("n", F.lit(block_hashes // BLOCK_ROWS))).alias("_n"), F.max("own").alias("_any"))
    apart = apart.where("_a <> _b and _any").select("key", "part", F.ceil(F.col("_n") / block_hashes).cast("int").alias("_blocks"))
    placed = parts.join(apart.hint("merge"), ["key", "part"]).withColumn("_at", F.pmod(F.xxhash64("node", F.lit(2)), "_blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    met = placed.select("key", "part", "node", "root", "own", "_at", other.alias("_other")).select("key", "part", F.least("_at", "_other").alias("low"), F.greatest("_at", "_other").alias("high"), "node", "root", "own")
    whole = met.join(sets.withColumnRenamed("want", "node").hint("merge"), "node")
    return whole.groupBy("key", "part", "low", "high").applyInPandas(_similar_in_block, "u long, v long").distinct()


def _signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_id, node, n, keys, fp, parity) of each row: the text's MD5, its set's name, size, band keys and parity, its SimHash."""

    @F.pandas_udf("struct<node: long, n: long, keys: array<long>, fp: long, parity: binary>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingle_hashes(t, width) for t in texts]
        sets = [_named_set(h) for h in hashes]
        nodes = np.array([x for x, _ in sets], np.uint64).view(np.int64)
        keys = [band_keys(h).view(np.int64) if len(h) else np.empty(0, np.int64) for _, h in sets]
        return pd.DataFrame({"node": nodes, "n": np.array([len(h) for _, h in sets], np.int64), "keys": pd.Series(keys, dtype=object), "fp": np.array([_majority(h) for h in hashes], np.int64), "parity": [parity(h) for _, h in sets]})

    return docs.select("doc_id", _text_id(F.col("text")).alias("text_id"), signed("text").alias("s")).select("doc_id", "text_id", "s.*")


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """prints (node, fp) -> pairs (u, v) of nodes: those of one fingerprint as a star, and one for each of links."""
    held = materialize(prints.select("node", "fp").distinct(), "fingerprints")
    least = materialize(held.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("_n")), "fingerprint-nodes")
    rows = held.count()
    equal = join_skewed(held, least, ["fp"], rows).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    pairs = materialize(links(least.select("fp")).distinct(), "fingerprint-links")
    n = pairs.count()
    for end in ("u", "v"):  # the middle of a star stands in many links
        ends = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n")).join(least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_node")).hint("merge"), end)
        pairs = join_skewed(pairs, ends, [end], n)
    return pairs.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).union(equal).where("u <> v").distinct()


def similar_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs (doc_id, text; other columns are left out) -> (doc_id, text_id, component), a row for each row of docs.

    component, a struct of doc_id and text_id (the MD5 of the text, null and empty being equal), is the least
    row reachable by steps between texts whose sets of width-word shingles have a Jaccard similarity of 0.8
    or more; a null doc_id comes last. Candidates are linked by their SimHash fingerprints, as in links; those that
    this leaves apart share a band of least hashes (a pair at 0.8 shares none of
    the BANDS with a chance of 3 in a million); each is confirmed on the whole sets. A band that very many sets share
    gives each some partners first, and then compares in blocks what those leave apart. Texts without words are equal."""

    @F.pandas_udf("array<long>")
    def whole(want: pd.Series, texts: pd.Series) -> pd.Series:
        # It takes the wanted name too, so that it can't be evaluated before the join, on all texts.
        sets = [(w, *shingle_set(t, width)) for w, t in zip(want.to_numpy().view(np.uint64).tolist(), texts)]
        return pd.Series([h.view(np.int64) if w == node else None for w, node, h in sets], dtype=object)

    prints = materialize(_signed_rows(docs, width), "shingles")
    row = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_id")
    nodes = prints.groupBy("node").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("_n"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity"))
    nodes = materialize(nodes, "sets")
    distinct, rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    partners, block_hashes = PARTNERS, BLOCK_HASHES

    def sets_of(wanted: DataFrame, label: str) -> DataFrame:
        """The sets of some nodes only, made again from one text each."""
        named = wanted.distinct().join(nodes.select("node", "first").hint("merge"), "node").select(F.col("node").alias("want"), F.col("first.doc_id").alias("d"), F.col("first.text_id").alias("t"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_id") == F.col("t"))
        texts = docs.select("doc_id", "text", _text_id(F.col("text")).alias("text_id")).join(named.hint("merge"), same).select("want", whole("want", "text").alias("hashes"))
        return materialize(texts.groupBy("want").agg(F.first("hashes", ignorenulls=True).alias("hashes")), label)

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("want").alias(k), F.col("hashes").alias(f"{k}_set")).hint("merge") for k in ("u", "v"))
        shared = F.size(F.array_intersect("u_set", "v_set"))
        return pairs.join(a, "u").join(b, "v").where(shared * 9 >= (F.size("u_set") + F.size("v_set")) * 4).select("u", "v")

    both = lambda pairs: pairs.select(F.col("u").alias("node")).union(pairs.select("v"))
    with freed(docs.sparkSession):
        close = materialize(_fingerprint_pairs(prints), "close")
        sure = materialize(confirmed(close, sets_of(both(close), "close-sets")), "links")
        near = nodes.join(components(sure).hint("merge"), "node", "left").select("node", "n", "keys", "parity", F.coalesce("root", "node").alias("near"))
        near = materialize(near, "near")
    dealt = _dealt(near)
    pairs = materialize(dealt.mapInArrow(lambda batches: _candidate_runs(batches, partners), "u long, v long").distinct(), "candidates")
    crowds = materialize(_crowds(nodes, partners), "crowds")
    sets = sets_of(both(pairs).union(crowds.select("node")), "candidate-sets")
    sure = sure.union(confirmed(pairs, sets))
    if not crowds.isEmpty():
        sure = materialize(sure, "links")
        sure = sure.union(crowd_links(crowds, sets, sure, block_hashes))
    ends = materialize(_named(nodes.select("node", "first", "_n"), sure, "node", distinct), "components")
    return join_skewed(prints.select("doc_id", "text_id", "node"), ends, ["node"], rows).select("doc_id", "text_id", "component")


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """Of each group of similar_copies one row of docs: the least by doc_id, then by MD5 of the text (rows without an
    id last; of rows equal in both any one). All columns of docs stay, but for one named _text_id."""
    docs = docs.drop("_text_id")
    row = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_id")
    kept = similar_copies(docs.select("doc_id", "text"), width).where(row == F.col("component")).select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).distinct()
    # Equal rows are thinned where they lie before they are shuffled, so a hot one is no hot task.
    single = docs.withColumn("_text_id", _text_id(F.col("text"))).dropDuplicates(["doc_id", "_text_id"])
    return single.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_id") == F.col("_t")), "left_semi").select(*docs.columns)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
