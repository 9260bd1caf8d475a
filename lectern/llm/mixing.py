"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its share of the target over what it has. Each document's count is
drawn by inverting the Poisson distribution at a number hashed from seed and id; a rate above
PART is the sum of equal independent parts. Documents are exploded by their counts and ordered
globally by another hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialize

SEED = "mix-1"
#: Largest rate inverted at once: e to the minus 16 is far from underflow, and 96 terms hold all but 1e-40.
PART = 16.0
TERMS = 96
#: Target weight of a source: its number of documents to this power.
POWER = 0.5


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 13 hexadecimal digits over 16^13."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def rates(docs: DataFrame, weights: DataFrame | None = None, total: Column | None = None, power: float = POWER) -> DataFrame:
    """(source, n_docs, rate): documents of each source and the mean copies of each.

    weights (source, weight): the target; without it a source weighs n_docs ** power. total: expected
    rows of the result (default: as many as docs). A null source is a source like any other. Sources
    without a weight get none, weights of absent sources are left out before shares are taken."""
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        want = have.withColumn("_w", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("_w"))
        want = have.join(given.hint("merge"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n_docs", F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.0)).alias("_w"))
    want = materialize(want, "sources")
    weight, have_docs = want.agg(F.sum("_w"), F.sum("n_docs")).first()
    goal = F.lit(have_docs) if total is None else total
    rate = goal * (F.col("_w") / F.lit(weight)) / F.col("n_docs") if weight else F.lit(0.0)
    return want.select("source", "n_docs", rate.alias("rate"))


def _inverse() -> Column:
    """Per source: parts, and the Poisson distribution function of a part's rate at 0 .. TERMS - 1."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    one = F.col("rate") / parts
    start = F.struct(F.exp(-one).alias("p"), F.array(F.exp(-one)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * one / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.struct(parts.alias("parts"), F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["cdf"].alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: Column | None = None, power: float = POWER, seed: str = SEED) -> DataFrame:
    """docs, each row as often as drawn, in global random order, with n_copies, copy (from 0) and mix_key.

    Columns of docs with those names are replaced; names that begin with _mix_ are not allowed. Counts depend on seed, doc_id and rate alone; rows of
    one doc_id get the same count; a null doc_id hashes as the empty string. mix_key (hexadecimal)
    orders the result: a global sort by key, in as many tasks as the session shuffles to."""
    docs = docs.drop("n_copies", "copy", "mix_key").withColumn("_mix_source", _key(F.col("source")))
    plan = rates(docs, weights, total, power).select(_key(F.col("source")).alias("_mix_source"), F.col("n_docs").alias("_n"), _inverse().alias("_mix_plan"))
    plan = materialize(plan, "rates")
    # A source of many rows meets its one plan row by broadcast, the small ones by a merge.
    joined = join_skewed(docs, plan, ["_mix_source"], plan.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    numbers = F.transform(F.sequence(F.lit(1), F.col("_mix_plan.parts")), lambda part: _unit(F.lit(seed), part.cast("string"), ident))
    below = lambda u: F.size(F.filter(F.col("_mix_plan.cdf"), lambda c: c <= u))
    count = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + below(u))
    drawn = joined.withColumn("n_copies", count).where("n_copies > 0").drop("_mix_plan", "_mix_source")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("mix_key", key).orderBy("mix_key")


def _key(source: Column) -> Column:
    """source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_copies", "copy", "mix_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP8_SQL = f"""
WITH have AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
want AS (SELECT source, n_docs, pow(n_docs::DOUBLE, {POWER}) AS w FROM have),
sums AS (SELECT sum(w) AS s, sum(n_docs) AS d FROM want),
plan AS (SELECT source, d * (w / s) / n_docs AS rate FROM want, sums),
split AS (SELECT source, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS one FROM plan),
terms AS (
  SELECT source, parts, list(exp(-one) * pow(one, k) / gamma(k + 1) ORDER BY k) AS pmf
  FROM split, range(0, {TERMS}) t(k) GROUP BY source, parts),
draws AS (
  SELECT doc_id, d.source, text, part, pmf,
    ('0x' || substr(md5('{SEED}|' || part || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(16**13)} AS u
  FROM documents d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source, unnest(range(1, parts + 1)) x(part)),
counts AS (
  SELECT doc_id, source, text, sum(len(list_filter(range(1, {TERMS + 1}), lambda k: list_sum(pmf[1:k]) <= u)))::INT AS n_copies
  FROM draws GROUP BY doc_id, source, text)
SELECT doc_id, source, n_copies, copy::INT AS copy,
  md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS mix_key, md5(coalesce(text, '')) AS text_md5
FROM counts, unnest(range(0, n_copies)) y(copy)
"""
