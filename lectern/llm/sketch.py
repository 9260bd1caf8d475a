"""Document fingerprints: threshold-scaled sketches, in DataFrame operations only.

A sketch holds every distinct shingle hash below a fixed fraction of the hash range, and nothing else. So
two sketches of one fraction can be merged by union, and the share of the smaller one's hashes that the
other holds estimates containment even between very unequal documents. A text of n shingles retains none
with a chance of (1 - 1/FRACTION) ** n; what is alike to such a text is unknown (null), not nought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: One hash in FRACTION is retained. Half of them leaves one text of eight shingles in 256 without any.
FRACTION = 2
#: Documents that a part of the id order holds on average, up to PARTS parts.
PART_ROWS, PARTS = 512, 16_384


def sketch(text: Column, width: int = WIDTH, fraction: int = FRACTION) -> Column:
    """Sorted distinct retained hashes of the word shingles of text (null: empty array).

    Words are runs without white space, in lower case. Fewer words than width: the whole sequence is
    the one shingle. No words: an empty sketch."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    # The signed range is cut at its lower end: hashes below this are one in `fraction`.
    limit = F.lit(-(1 << 63) + (1 << 64) // fraction)

    def of(words: Column) -> Column:
        n = F.size(words)
        shingles = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(width)]))
        whole = F.array(F.xxhash64(F.array_join(words, " ")))
        hashes = F.when(n >= width, shingles).when(n > 0, whole).otherwise(F.array().cast("array<long>"))
        return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))

    # a let-binding: transform over an array of one keeps the words from being split again
    return F.element_at(F.transform(F.array(words), of), 1)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles in the other; null if either sketch is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """1 for texts that are the same, else their containment, 0 where it is unknown."""
    return F.when(same, F.lit(1.0)).otherwise(F.coalesce(containment(a, b), F.lit(0.0)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together (of all their shingles, none across the seam)."""
    return F.array_sort(F.array_union(a, b))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal text, sixteen digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], prepare=lambda rows: rows) -> DataFrame:
    """prepare(docs (doc_id, ...)) with next_<column>: the value in the row after by ascending doc_id,
    after the last the first. One shuffle of the rows, and no task that sees all of them.

    The order is cut into at most PARTS parts of about equal numbers of rows, at quantiles of doc_id; a part's
    last row looks at the first row of the next part, which is copied there. A row without an id has no place
    in the order: nothing comes after it (null) and it comes after nothing. Rows of one id follow each other
    in any order. Other columns keep their values; columns of docs whose names begin with _next_ are not
    allowed, and existing next_<column> are replaced."""
    docs = docs.drop(*[f"next_{c}" for c in columns])
    placed, lost = docs.where("doc_id is not null"), docs.where("doc_id is null")
    n = docs.count()
    parts = min(PARTS, max(1, n // PART_ROWS))
    # At most PARTS bounds, near the quantiles by a twentieth of a part; as one literal they are searched by halving.
    shares = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    found = placed.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(found or []))
    part = F.lit(0)
    if bounds:
        listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")
        # The number of bounds below or at doc_id, from the highest bit down.
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
        part = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at))
    # One row for each part that has documents, so it may be ordered in one task and broadcast.
    firsts = placed.select(part.alias("_next_p"), F.col("doc_id").alias("_next_d")).groupBy("_next_p").agg(F.min("_next_d").alias("_next_id"))
    order = Window.orderBy("_next_p")
    before = firsts.select("_next_id", F.coalesce(F.lag("_next_p").over(order), F.max("_next_p").over(Window.partitionBy())).alias("_next_part"))
    copies = placed.join(F.broadcast(before), F.col("doc_id") == F.col("_next_id")).drop("_next_id").withColumn("_next_copy", F.lit(True))
    rows = prepare(placed.withColumn("_next_part", part).withColumn("_next_copy", F.lit(False)).unionByName(copies))
    after = Window.partitionBy("_next_part").orderBy("_next_copy", "doc_id")
    led = rows.select("*", *[F.lead(c).over(after).alias(f"next_{c}") for c in columns])
    led = led.where(~F.col("_next_copy")).drop("_next_copy", "_next_part")
    alone = prepare(lost)
    return led.unionByName(alone.select("*", *[F.lit(None).cast(alone.schema[c].dataType).alias(f"next_{c}") for c in columns]))


def fingerprints(docs: DataFrame, width: int = WIDTH, fraction: int = FRACTION) -> DataFrame:
    """docs with text (null: empty) and sketch (array<long>); a column of that name is replaced."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("sketch", sketch(F.col("text"), width, fraction))


def edited(docs: DataFrame) -> DataFrame:
    """Rows of with_next over text with n_chars and `edited`: the last floor(n_chars / 2) code points
    replaced by as many first ones of the next text (or all it has). Columns of those names are replaced."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    made = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    return docs.withColumn("edited", made).withColumn("n_chars", n.cast("long"))


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = edited(with_next(docs, ["text", "sketch"], fingerprints))
    # A generator of one row keeps the edited text's sketch from being computed for each column that uses it.
    made = F.array(F.struct(F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch")))
    same = [(F.col("text") == F.col("edited")).alias("as_edited"), (F.col("text") == F.coalesce("next_text", F.lit(""))).alias("as_next")]
    rows = rows.select("doc_id", "n_chars", "sketch", F.coalesce("next_sketch", F.array().cast("array<long>")).alias("next_sketch"), *same, F.inline(made))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("as_edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("as_next")).alias("near_next"),
    )
