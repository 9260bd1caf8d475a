"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on a text. Expectation-maximisation over the counts of
vote patterns (at most 3 to the number of labellers) estimates each labeller's accuracy for either class
and with them the posterior of a pattern. Posteriors of a bounded sample train a hashed linear scorer
by logistic regression, and the scorer rates every whole text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
#: Texts that training may use; this bounds what the training task holds.
SAMPLE = 6000
CACHE = 200_000

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "is", "der", "die", "und", "das", "le", "la", "de", "et", "les", "el", "que", "en", "un"]


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.col("length"), F.lit(1))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, t, words, n, distinct, known, lines, n_lines). The generators of one row keep what
    several labellers use from being computed for each of them."""
    t = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(F.array(F.struct(t.alias("t"), words.alias("words"), lines.alias("lines")))))
    listed = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    sizes = F.struct(F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.size(F.array_intersect("words", listed)).alias("known"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("distinct_lines"), F.length("t").alias("length"))
    return split.select("doc_id", "text_hash", "t", F.inline(F.array(sizes)))


def votes() -> dict[str, Column]:
    """Labellers over the columns of measured(): 1 good, 0 bad, -1 no vote."""
    t, n, lines, different = F.col("t"), F.col("n"), F.col("n_lines"), F.col("distinct_lines")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    distinct, known = F.col("distinct") / F.greatest(n, F.lit(1)), F.col("known")
    width = F.col("length") / F.greatest(n, F.lit(1))
    symbols, capitals, digits = _share(t, r"[#$%&*|{}<>=_!\\]"), _share(t, r"\p{Lu}"), _share(t, r"[0-9]")
    return {
        "long_enough": vote(n >= 40, n < 12),
        "word_width": vote((width >= 3.5) & (width <= 9), (width < 2.5) | (width > 14)),
        "few_symbols": vote(symbols < 0.01, symbols > 0.04),
        "varied_words": vote(distinct > 0.35, (distinct < 0.15) & (n >= 40)),
        "varied_lines": vote((different == lines) & (lines > 1), different * 10 < lines * 7),
        "function_words": vote(known >= 4, known < 1),
        "lower_case": vote(capitals < 0.08, capitals > 0.3),
        "few_digits": vote(digits < 0.02, digits > 0.1),
        "ends_well": vote(F.rtrim(t).rlike(r"[.!?]$"), t == ""),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Vote patterns (1, 0, -1) and their counts -> posterior of good for each pattern, accuracies
    (labellers x classes bad and good: how often a vote is right), prior of good.

    Accuracies start at 0.8 with a prior of 0.8 and are kept from 0 and 1 by a small pseudo-count, so the
    classes keep their meaning and a labeller that never votes stays where it began."""
    right, prior = np.full((patterns.shape[1], 2), 0.8), 0.8
    voted = [(patterns == v).astype(float) for v in (0, 1)]
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        good = np.log(prior) + (voted[1] * np.log(right[:, 1]) + voted[0] * np.log(1 - right[:, 1])).sum(axis=1)
        bad = np.log(1 - prior) + (voted[0] * np.log(right[:, 0]) + voted[1] * np.log(1 - right[:, 0])).sum(axis=1)
        posterior = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        for cls, weight in ((1, counts * posterior), (0, counts * (1 - posterior))):
            hit = (voted[cls] * weight[:, None]).sum(axis=0)
            seen = hit + (voted[1 - cls] * weight[:, None]).sum(axis=0)
            right[:, cls] = np.clip((hit + 8) / (seen + 10), 0.02, 0.98)
        prior = float(np.clip((counts * posterior).sum() / max(counts.sum(), 1), 0.02, 0.98))
    return posterior, right, prior


# --- the hashed linear scorer -------------------------------------------------------------------

_SHAPE = [(re.compile(p), r) for p, r in ((r"[a-zß-öø-ÿ]+", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[0-9]+", "9"))]


def features(word: str) -> tuple[int, int]:
    """Buckets of a word in lower case and of its shape."""
    shape = word
    for pattern, mark in _SHAPE:
        shape = pattern.sub(mark, shape)
    return zlib.crc32(b"w" + word.lower().encode()) % BUCKETS, zlib.crc32(b"s" + shape.encode()) % BUCKETS


REPEAT = zlib.crc32(b"repeat") % BUCKETS


class Scorer:
    """text -> quality in [0, 1]: a logistic function of the mean weight of its words, shapes and repeats."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias, self.known = weight, bias, {}

    def _of(self, word: str) -> float:
        a, b = features(word)
        v = float(self.weight[a] + self.weight[b])
        if len(self.known) < CACHE and len(word) <= 64:
            self.known[word] = v
        return v

    def __call__(self, text: str | None) -> float:
        words, get, total = (text or "").split(), self.known.get, 0.0
        for w in words:
            v = get(w)
            total += self._of(w) if v is None else v
        total += self.weight[REPEAT] * sum(map(str.__eq__, words, words[1:]))
        z = self.bias + total / max(1, len(words))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str | None], targets: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad on the cross entropy with soft targets."""
    rows = []
    for t in texts:
        words, at = (t or "").split(), Counter()
        for w, n in Counter(words).items():
            for b in features(w):
                at[b] += n
        at[REPEAT] += sum(map(str.__eq__, words, words[1:]))
        rows.append((np.fromiter(at.keys(), np.int64), np.fromiter(at.values(), float) / max(1, len(words))))
    weight, seen, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            at = np.concatenate([rows[i][0] for i in pick])
            by = np.concatenate([rows[i][1] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            z = bias + np.bincount(doc, by * weight[at], minlength=len(pick))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets[pick]) / len(pick)
            g = np.bincount(at, by * error[doc], minlength=BUCKETS)
            seen += g * g
            weight -= rate * g / np.sqrt(seen)
            bias -= rate * error.sum()
    return weight, float(bias)


def score(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, posterior (of the labellers alone), score, predicted; a row for each
    row of docs, other columns are left out.

    Null texts count as empty. Votes and their counts are taken over all documents, repeated rows included; only the
    regression uses a sample: the first `sample` pairs of doc_id and text by hash, each once. It runs in one
    task, whose input that bounds; the driver gets the finished weights. Without documents there is no score."""
    from .common import materialize

    spark = docs.sparkSession
    names = list(votes())
    pattern = sum(((v + 1) * 3**i for i, v in enumerate(votes().values())), F.lit(0)).cast("int")
    voted = materialize(measured(docs).select("doc_id", "text_hash", pattern.alias("pattern")), "votes")
    table = voted.groupBy("pattern").count().toPandas()  # 3 ** 9 rows at most
    digits = (table["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(names))) % 3 - 1
    posterior, _, _ = expectation_maximisation(digits, table["count"].to_numpy(float)) if len(table) else (np.zeros(0), None, 0)
    of_pattern = spark.createDataFrame([(int(p), float(q)) for p, q in zip(table["pattern"], posterior)], "pattern int, posterior double")
    judged = voted.join(F.broadcast(of_pattern), "pattern")
    by_id = judged.groupBy("doc_id", "text_hash").agg(F.min("posterior").alias("posterior"))
    # `sample` rows of three numbers at most
    some = by_id.orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash").limit(sample)
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.text_hash"))
    picked = docs.alias("d").join(F.broadcast(some).alias("s"), same).groupBy("d.doc_id", "s.text_hash", "s.posterior").agg(F.min("d.text").alias("text"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts).sort_values(["doc_id", "text_hash"])
            weight, bias = train(rows["text"].tolist(), rows["posterior"].to_numpy())
            yield pd.DataFrame({"weight": [weight.astype("<f8").tobytes()], "bias": [bias]})

    fitted = picked.repartition(1).mapInPandas(learn, "weight binary, bias double").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(bytes(fitted["weight"]), "<f8"), fitted["bias"]) if fitted else (np.zeros(BUCKETS), 0.0))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    rated = docs.select("doc_id", scored("text").alias("score"), F.xxhash64("text").alias("text_hash"))
    by_id = by_id.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "posterior")
    joined = rated.join(by_id.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    return joined.select("doc_id", "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
