"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of the word and its character 3- to 5-grams (hashed to
buckets), so a misspelling shares most of its vector with the word. A document's vector is the mean
over its words; a linear softmax gives the probability of label 1. Training data is a bounded sample
of labelled rows; every whole text is scored."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# DIM, SHARED, PRIOR and the defaults of train() were picked on a split inside the learning rows (those whose CRC-32
# divided by 5 is again a multiple of 5 judged models of the rest); rows that are held out took no part.
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
DIM = 8
#: Labelled rows that training may use, for each class; this bounds what the training task holds.
PER_CLASS = {1: 2500, 0: 7500}
#: How far class weights are undone in the bias: at 0 the classes weigh alike, at 1 as in the sample.
PRIOR = 1.0
#: Training texts that have to share a bucket before it is trained.
SHARED = 3
#: Letters of a run that count as one word.
PIECE = 64
#: Words a task remembers the value of.
CACHE = 200_000


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case. A run longer than PIECE (scripts without blanks, glued text) is taken in
    pieces of PIECE letters that share four, so that all of it counts and each of its n-grams lies in a piece."""
    runs = WORD.findall((text or "").lower())
    if max(map(len, runs), default=0) <= PIECE:
        return runs
    return [r[a : a + PIECE] for r in runs for a in range(0, max(1, len(r) - 4), PIECE - 4)]


def buckets(word: str) -> list[int]:
    """The word's own bucket and those of its 3- to 5-grams, bounds marked."""
    w = f"<{word}>"
    grams = dict.fromkeys([w, *[w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]])
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


@dataclass
class Model:
    """value[b]: what bucket b adds to the log-odds of label 1 (embedding times softmax weights)."""

    value: np.ndarray
    bias: float

    def scorer(self):
        """text -> probability of label 1; empty texts get the bias alone."""
        at, known = self.value.tolist().__getitem__, {}

        def of(word: str) -> float:
            b = buckets(word)
            v = sum(map(at, b)) / len(b)
            if len(known) < CACHE:
                known[word] = v
            return v

        def score(text: str | None) -> float:
            found, total = words(text), 0.0
            for w in found:
                v = known.get(w)
                total += of(w) if v is None else v
            z = self.bias + total / max(1, len(found))
            return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

        return score


def bagger():
    """text -> its buckets and what part of the text's mean each has: all of a text that training keeps."""
    known: dict[str, np.ndarray] = {}

    def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > CACHE // 4:
            known.clear()
        counts = Counter(words(text))
        total = max(1, sum(counts.values()))
        at, by = [np.zeros(0, np.int64)], [np.zeros(0)]
        for w, n in counts.items():
            b = known.get(w)
            if b is None:
                b = known[w] = np.array(buckets(w), np.int32)
            at.append(b)
            by.append(np.full(len(b), n / total / len(b)))
        at, by = np.concatenate(at), np.concatenate(by)
        b, where = np.unique(at, return_inverse=True)
        return b.astype(np.int32), np.bincount(where, by, minlength=len(b)).astype(np.float32)

    return bag


def train(texts: list[str], labels: np.ndarray, **how) -> Model:
    """The model of texts: train_bags over what bagger keeps of each."""
    bag = bagger()
    return train_bags([bag(t) for t in texts], labels, **how)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, updates: int = 1000, batch: int = 64, rate: float = 0.05, scale: float = 100.0, decay: float = 3e-4, seed: int = 7) -> Model:
    """Embeddings and softmax weights jointly, by Adam on the cross entropy; classes weigh the same
    in the gradient, then the bias is moved by PRIOR of the sample's log-odds.
    Samples of every size get about as many updates. bags is emptied."""
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), float(4 * (2 * labels[0] - 1)) if len(bags) else 0.0)
    rng = np.random.default_rng(seed)
    rows, weights = map(list, zip(*bags))
    bags.clear()
    # Buckets that few texts share could only learn these texts by heart: they stay at zero, as do all
    # that training never meets. The buckets of a text are distinct.
    spread = np.zeros(BUCKETS, np.int32)
    for b in rows:
        spread[b] += 1
    for i, b in enumerate(rows):
        common = spread[b] >= SHARED
        rows[i], weights[i] = b[common], weights[i][common]
    e = np.zeros((BUCKETS, DIM), np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    m_e, v_e = np.zeros_like(e), np.zeros_like(e)
    m_w, v_w = np.zeros_like(w), np.zeros_like(w)
    share = np.array([(labels == c).mean() for c in (0, 1)])
    epochs = -(-updates * batch // len(rows))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            size = np.array([len(rows[i]) for i in pick])
            at = np.concatenate([rows[i] for i in pick])
            by = np.concatenate([weights[i] for i in pick]) * np.float32(scale)
            doc = np.repeat(np.arange(len(pick)), size)
            used, inverse = np.unique(at, return_inverse=True)
            local = e[used]
            hidden = np.stack([np.bincount(doc, by * local[inverse, k], minlength=len(pick)) for k in range(DIM)], axis=1).astype(np.float32)
            logits = hidden @ w + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            g = p / share[labels[pick]][:, None] / 2 / len(pick)
            g_w = hidden.T @ g + 1e-4 * w
            back = (g @ w.T)[doc] * by[:, None]
            g_e = np.stack([np.bincount(inverse, back[:, k], minlength=len(used)) for k in range(DIM)], axis=1).astype(np.float32) + decay * local
            m_e[used] = 0.9 * m_e[used] + 0.1 * g_e
            v_e[used] = 0.98 * v_e[used] + 0.02 * g_e**2
            e[used] -= step * m_e[used] / (np.sqrt(v_e[used]) + 1e-7)
            m_w = 0.9 * m_w + 0.1 * g_w
            v_w = 0.98 * v_w + 0.02 * g_w**2
            w -= step * m_w / (np.sqrt(v_w) + 1e-7)
            bias -= step * g.sum(0)
    prior = PRIOR * float(np.log(share[1] / share[0]))
    return Model((scale * (e @ (w[:, 1] - w[:, 0]))).astype(np.float64), float(bias[1] - bias[0]) + prior)


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None) -> DataFrame:
    """The bounded sample that training uses: (doc_id, text, y), of each class the first rows by hash.

    Labels other than 0 and 1 and rows without an id are left out. An id with both labels counts as 1; of
    several texts of one id the least is used (by code points; null only if there is no other)."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    some = None
    for y, n in PER_CLASS.items():
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        some = part if some is None else some.union(part)
    # At most sum(PER_CLASS) rows of two numbers: the bound is fixed, so it may be broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def held_out(doc_id) -> F.Column:
    """Rows kept from training: the CRC-32 of doc_id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of the sample. It is trained in one task, whose input the sample's bound limits; the driver
    gets the finished weights."""
    sample = labelled(docs, labels, label, ~held_out(F.col("doc_id")))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A text becomes its bag as it comes in, so that the sample's texts are never held together.
        bag, rows = bagger(), []
        for b in batches:
            rows += [(d, y, bag(t)) for d, y, t in zip(b["doc_id"], b["y"], b["text"].fillna(""))]
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        labels, bags = np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
        rows.clear()
        model = train_bags(bags, labels)
        yield pd.DataFrame({"value": [model.value.astype("<f8").tobytes()], "bias": [model.bias]})

    fitted = sample.repartition(1).mapInPandas(learn, "value binary, bias double").first()
    return Model(np.frombuffer(bytes(fitted["value"]), "<f8"), fitted["bias"]) if fitted else Model(np.zeros(BUCKETS), 0.0)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with `name`, the probability of label 1 for the whole text; null texts count as empty. Repeated rows
    get the same score each; a column of docs called `name` is replaced, other columns keep their values."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return docs.withColumn(name, scored("text"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
