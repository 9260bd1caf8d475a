"""Phrase collocations by SETM relational mining.

The occurrences of phrases of one length are a relation (piece, pos, words), written sorted and bucketed by
piece. The next length comes from a merge join of that relation with itself at the adjacent position, its groups
are counted, and only occurrences of frequent groups are written for the length after. Equal pieces of text are
one piece with a weight, so that copies cost no rows.

A word is a 64-bit hash of lang and word, which is checked to be one to one on the vocabulary (another seed is
taken if not)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, freed, join_skewed, materialize, stored, work_dir

#: Occurrences of a candidate at least; words of a candidate at most; phrases reported for a lang.
SUPPORT, LENGTH, TOP = 10, 3, 2000
#: A candidate goes if a longer one around it has this share of its occurrences, in per cent.
ABSORB = 50
#: Words with over one of so many occurrences are hot: fewer than so many, so their pairs are a bounded table.
HOT = 1000
#: Occurrences in one bucket of a relation, on average.
BUCKET_ROWS = 4_000_000

#: Exact up to counts of fifteen digits.
SCORE = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(15,0)))) div (cast(l{at} as decimal(19,0)) * cast(r{at} as decimal(19,0)))"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ENDS = ".,;:!?\n\x0b\x0c\r"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces of each lang, words parted by one blank, and how often they stand in docs. Null
    texts have none."""
    plain = F.translate("text", _UPPER + "\t" + _ENDS, _UPPER.lower() + " " + "\n" * len(_ENDS))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    single = F.when(F.instr("piece", "  ") > 0, F.regexp_replace("piece", " +", " ")).otherwise(F.col("piece"))
    return rows.select("lang", F.trim(single).alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def vocabulary(parts: DataFrame) -> tuple[DataFrame, int]:
    """(w, lang, word, f, rows) for each word, and the seed that tells them all apart: f counts occurrences, rows
    those in distinct pieces."""
    found = parts.select("lang", "m", F.explode(F.split("piece", " ")).alias("word")).groupBy("lang", "word").agg(F.sum("m").alias("f"), F.count(F.lit(1)).alias("rows"))
    found = materialize(found, "words")
    seed = 0
    while True:
        named = found.select(_word_id(seed).alias("w"), "*")
        if not named.groupBy("w").count().where("count > 1").head(1):
            return named, seed
        seed += 1


def _word_id(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "word")


class _Relations:
    """Occurrence relations as sorted bucketed tables below the shared folder, in a session of their own: there a
    join by piece and position takes tables bucketed by piece as they lie, and shuffle files go with the write."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.session, self.buckets, self.made = spark.newSession(), buckets, {}
        for name, value in (
            ("spark.sql.requireAllClusterKeysForCoPartition", "false"),
            ("spark.sql.legacy.bucketedTableScan.outputOrdering", "true"),
            ("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"),
            ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
            ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")),
        ):
            self.session.conf.set(name, value)
        self.base = f"{work_dir(spark)}/relations-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> DataFrame:
        """rows, dealt by piece, written sorted by piece and pos, and read as a table."""
        name = f"relation_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "piece").sortBy("piece", "pos").option("compression", "zstd")
        writer.option("parquet.dictionary.page.size", 8 << 20).option("path", f"{self.base}/{name}").saveAsTable(name)
        self.made[name] = f"{self.base}/{name}"
        return self.session.table(name)

    def put(self, rows: DataFrame) -> DataFrame:
        """rows written as they lie, so that their shuffle ends before they are dealt by piece."""
        path = f"{self.base}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        self.made[path] = path
        return self.session.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        """All that was written so far goes, but for the last relation."""
        for name in list(self.made)[:-1]:
            if self.made[name] != name:
                self.session.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.session, self.made.pop(name))

    def close(self) -> None:
        self.made["none"] = "none"
        self.drop()
        discard(self.session, self.base)


def _extend(left: DataFrame, k: int) -> DataFrame:
    """Occurrences of k + 1 words: those of k words joined with those that begin one word later."""
    names = [f"w{i}" for i in range(1, k + 1)]
    later = left.select("piece", (F.col("pos") - 1).alias("pos"), *[F.col(c).alias(f"w{i}") for i, c in enumerate(names, 2)], F.col("hot").alias("later_hot"))
    if k == 1:
        return left.join(later.hint("merge"), ["piece", "pos"]).withColumn("hot", F.col("hot") & F.col("later_hot")).drop("later_hot")
    shared = names[1:]
    return left.join(later.drop(*shared, "later_hot").hint("merge"), ["piece", "pos"])


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, length: int = LENGTH, buckets: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The vocabulary (w, lang, word, f, rows), and for each number of words from 2 the phrases with f >= support
    as (w1, ..., f). Null texts are empty, a null lang is `und`; other columns are not read."""
    spark = docs.sparkSession
    with freed(spark):
        parts, parts_path = stored(pieces(docs.select("lang", "text")), "pieces")
        words, seed = vocabulary(parts)
    total = words.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = [r["w"] for r in words.where(F.col("rows") * HOT > total).select("w").collect()]  # fewer than HOT
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = _Relations(spark, buckets or max(shuffles, -(-total // BUCKET_ROWS)))
    lists: list[DataFrame] = []
    try:
        # Ids of rows in files that no longer change: the same in every attempt of a task.
        ids = store.session.read.schema(parts.schema).parquet(parts_path).withColumn("piece_id", F.monotonically_increasing_id())
        dealt = ids.select(F.col("piece_id").alias("piece"), "lang", "m", F.col("piece").alias("text")).repartition(store.buckets, "piece")
        exploded = dealt.select("piece", "lang", "m", F.posexplode(F.split("text", " ")).alias("pos", "word"))
        relation = exploded.select("piece", "pos", _word_id(seed).alias("w1"), "m")
        relation = store.write(relation.withColumn("hot", F.col("w1").isin(hot) if hot else F.lit(False)))
        discard(spark, parts_path)
        for k in range(2, length + 1):
            names = [f"w{i}" for i in range(1, k + 1)]
            longer = _extend(relation, k - 1)
            if k < length:
                often = store.put(_counted(longer, names, support))
                often = _without_rare_hot(often, names, support) if k == 2 else often
                relation = store.write(often.repartition(store.buckets, "piece"))
                store.drop()
                groups = relation.groupBy(*names).agg(F.sum("m").alias("f"))
            else:
                groups = longer.groupBy(*names).agg(F.sum("m").alias("f")).where(F.col("f") >= support)
            lists.append(spark.read.parquet(stored(groups, "phrases")[1]))
    finally:
        store.close()
    return words, lists


def _counted(rows: DataFrame, names: list[str], support: int) -> DataFrame:
    """rows, but for those of groups of words that occur too rarely; the groups are dealt, sorted and counted. Groups of
    two hot words stay as they are: no other group has more than one of HOT rows."""
    window = Window.partitionBy(*names)

    def often(df: DataFrame, hot: bool) -> DataFrame:
        found = df.drop("hot").withColumn("f", F.sum("m").over(window)).where(F.col("f") >= support).drop("f")
        return found.withColumn("hot", F.lit(hot)).select(*rows.columns)

    rare = rows.where("hot")
    return often(rows.where("not hot"), False).unionByName(rare if len(names) == 2 else often(rare, True))


def _without_rare_hot(rows: DataFrame, names: list[str], support: int) -> DataFrame:
    """rows, but for those of groups of two hot words that occur too rarely: fewer than HOT squared groups, counted by
    partial sums and broadcast."""
    often = rows.where("hot").groupBy(*names).agg(F.sum("m").alias("f")).where(F.col("f") >= support).drop("f")
    return rows.where("not hot").unionByName(rows.where("hot").join(F.broadcast(often), names, "left_semi").select(*rows.columns))


def _with(rows: DataFrame, values: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows, a stored table, with the columns of values, found by keys, where a key of many rows is divided. Written
    again, as each such join reads its rows three times."""
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(join_skewed(rows, materialize(values.join(held.hint("merge"), keys), "values"), keys, total), "found")


def collocations(docs: DataFrame, support: int = SUPPORT, length: int = LENGTH, absorb: int = ABSORB, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to `length` words of each lang.

    a, l, r: occurrences of the phrase and of both parts of its lowest-scoring cut; n: words of the lang. A phrase
    inside a longer one with `absorb` per cent of its occurrences is left out; a look at the phrases of one word
    more finds every such one, since each phrase between them occurs as often as the longest. Null texts are
    empty, a null lang is `und`, an empty table gives no rows; other columns are not read."""
    words, lists = frequent_phrases(docs, support, length, buckets)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = {1: words.where(F.col("f") >= support).select(F.col("w").alias("w1"), "f", "word", "lang")}
    for k, found in enumerate(lists, 2):
        known[k] = found
    scored = []
    for k in range(2, length + 1):
        names = [f"w{i}" for i in range(1, k + 1)]
        rows = known[k].withColumnRenamed("f", "a")
        count = known[k].count()
        for i, w in enumerate(names, 1):
            word = known[1].select(F.col("w1").alias(w), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
            rows = _with(rows, word, [w], count)
        cuts = []
        for at in range(1, k):
            for side, part in (("l", names[:at]), ("r", names[at:])):
                if len(part) > 1:
                    sub = known[len(part)].select(*[F.col(f"w{i}").alias(c) for i, c in enumerate(part, 1)], F.col("f").alias(f"{side}{at}"))
                    rows = _with(rows, sub, part, count)
                else:
                    rows = rows.withColumn(f"{side}{at}", F.col(f"f{part[0][1:]}"))
            score = F.expr(SCORE.format(at=at))
            cuts.append(F.struct(score.alias("score"), F.lit(at).alias("k"), F.col(f"l{at}").alias("l"), F.col(f"r{at}").alias("r")))
        best = cuts[0] if len(cuts) == 1 else F.least(*cuts)
        if k < length:
            whole, around = known[k + 1], []
            for part in ([f"w{i}" for i in range(1, k + 1)], [f"w{i}" for i in range(2, k + 2)]):
                around.append(whole.select(*[F.col(c).alias(n) for c, n in zip(part, names)], "f"))
            most = around[0].unionByName(around[1]).groupBy(*names).agg(F.max("f").alias("around"))
            rows = rows.join(most.hint("merge"), names, "left").where(F.coalesce("around", F.lit(0)) * 100 < F.lit(absorb) * F.col("a")).drop("around")
        phrase = F.concat_ws(" ", *[f"word{i}" for i in range(1, k + 1)])
        scored.append(rows.withColumn("_best", best).select("lang", phrase.alias("phrase"), "a", "_best.l", "_best.r", "_best.score"))
    rows = reduce(DataFrame.unionByName, scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top).drop("_r", "_salt")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = ranked.join(totals.hint("merge"), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_extract_all(piece, '[^\x20\x09]+'), lambda w: w <> '') AS ws FROM cut),
singles AS (SELECT lang, w, count(*) AS f FROM pieces, unnest(ws) t(w) GROUP BY lang, w),
grams AS (
  SELECT lang, k, ws[i:i + k - 1] AS g, count(*)::HUGEINT AS f
  FROM pieces, unnest([1, 2, 3]) n(k), unnest(range(1, (len(ws) - k + 2)::BIGINT)) p(i) GROUP BY lang, k, g),
often AS (SELECT * FROM grams WHERE f >= {SUPPORT}),
halves AS (
  SELECT lang, g, f AS a, 1 AS cut_at, g[1:1] AS g1, g[2:k] AS g2 FROM often WHERE k > 1
  UNION ALL SELECT lang, g, f AS a, 2 AS cut_at, g[1:2] AS g1, g[3:3] AS g2 FROM often WHERE k = 3),
cuts AS (
  SELECT h.lang, h.g, a, x.f AS l, y.f AS r, cut_at, (1000000::HUGEINT * a * a) // (x.f * y.f) AS score
  FROM halves h JOIN often x ON x.lang = h.lang AND x.g = h.g1 JOIN often y ON y.lang = h.lang AND y.g = h.g2),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut_at) = 1),
inner_ AS (
  SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM often WHERE k = 3),
around AS (SELECT lang, g, max(f) AS f FROM inner_ GROUP BY lang, g),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.g = b.g WHERE coalesce(o.f, 0) * 100 < {ABSORB} * b.a),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM singles GROUP BY lang),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM named d JOIN totals t ON t.lang = d.lang
QUALIFY rank <= {TOP}
"""
