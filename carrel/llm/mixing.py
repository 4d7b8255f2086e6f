"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1]. Its integral over the whole
run is the source's target in words; its integral up to t, divided by the target, is
``G(t) = (1 + a) t - a t^2``, where the tilt a in [-1, 1] says whether the source is heavy early (a > 0)
or late. A document that stands at share u of its source's demand is trained on at G^-1(u), and the
rows are range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrel.llm.common import word_count

#: Weights of the sources in code point order, null last, repeating; and the tilts of their schedules.
WEIGHTS = (5, 2, 1)
TILTS = (0.5, 0.0, -0.5)
MOST = 3


def targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, most: int = MOST) -> DataFrame:
    """Source, source_size, target and tilt from one row per source with its size.

    The sources share the total of all sizes by weight. No target exceeds ``most`` times its source's
    size; what is over is shared again by weight until none is above. That ends where a common
    level L gives each source min(most * size, L * weight), so L is found in one pass over the sources
    in the order of the level at which each is full.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.col("rank") % len(values) + 1).cast("int"))
    s = sizes.withColumn("rank", rank).withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts))
    s = s.withColumn("cap", (most * F.col("source_size")).cast("double"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_from", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    # The level if all sources before this one are full and none from it on; it holds at the first source that it does not fill.
    s = s.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_from"))
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("final", F.min(F.when(F.col("fits"), F.struct("caps_before", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least("cap", F.col("final.level") * F.col("weight")), "cap")
    return s.select("source", "source_size", F.round(target, 6).alias("target"), "tilt")


def _digits(rows: int) -> int:
    """Hex digits of a bucket's name: about 2^18 rows a bucket, whatever the input."""
    return max(3, -(-((max(rows, 1) - 1) >> 18).bit_length() // 4))


def mixed(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position, copies, parts.

    ``size`` counts words, 0 for a null text. A source's documents stand in the order of the md5 of their id (without one: of their text);
    the mix reads that order again and again until floor(target) words are taken, so the source's sum of
    ``taken`` is floor(target), at most one document per source is taken in part, and none exceeds
    ``most`` times its size. ``copies`` is the number of times that the document occurs, the last of them perhaps
    in part; ``position`` is the training time of its first occurrence, null if it is not taken; ``parts`` has words and position of each.

    The running sum over a source is taken in buckets of that order, 4096 or more by the number of rows: sums of buckets first, then a window inside
    each bucket, so a source that holds a third of all rows is not one task. Null sources are one source, the last.
    Rows that share a doc_id are separate documents, in the order of their size and text. An empty table gives no rows. With ``keep``, names
    of input columns, the result has these columns and parts alone.
    """
    keep = keep or []
    # Equal where the sources are, never null: the join with the buckets then finds the rows where the window has dealt them, and doesn't shuffle texts again.
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("named")
    d = docs.select("doc_id", "source", named, word_count(F.col("text")).alias("size"), "text", F.xxhash64("text").alias("tie"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    unnamed = F.concat(F.lit("null"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    d = d.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), unnamed).cast("binary"))).withColumn("bucket", F.substring("order", 1, _digits(docs.count()))).drop("text")
    buckets = d.groupBy("source", "named", "bucket").agg(F.sum("size").alias("bucket_size"))
    aim = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, tilts, most)
    starts = buckets.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    starts = starts.alias("b").join(aim.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source"))).select("named", "bucket", "before", "source_size", "target", "tilt")
    inside = Window.partitionBy("named", "bucket").orderBy("order", "doc_id", "size", "tie")
    d = d.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.join(starts, ["named", "bucket"])
    at, quota = F.col("before") + F.col("within"), F.floor("target")
    a = F.col("tilt")

    def time(share):
        root = F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * share, F.lit(0.0)))
        return F.round(F.when(a == 0, share).otherwise(((1 + a) - root) / (2 * F.when(a == 0, 1.0).otherwise(a))), 9)

    def part(p):
        start = p * F.col("source_size") + at
        words = F.greatest(F.lit(0), F.least(F.col("size"), quota - start)).cast("long")
        return F.struct(words.alias("words"), time(start / F.greatest(F.col("target"), F.lit(1e-9))).alias("position"))

    d = d.withColumn("parts", F.filter(F.array(*(part(p) for p in range(most))), lambda x: x["words"] > 0))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda t, x: t + x["words"])
    kept = [F.col(f"_keep_{c}").alias(c) for c in keep]
    return d.select("doc_id", *kept, F.col("size").alias("size"), "source_size", "target", taken.alias("taken"), F.get("parts", F.lit(0))["position"].alias("position"), F.size("parts").alias("copies"), "parts") if not keep else d.select(*kept, "parts")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``mixed`` in training order: range-sorted by position, documents that are not taken last."""
    return mixed(docs, **options).drop("parts").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order, a row for each time that one occurs, with the columns of ``docs``.

    A document that the mix takes in part is cut after its last word taken.
    """
    size = word_count(F.col("text"))
    rows = mixed(docs, keep=docs.columns, **options).select("*", F.explode("parts").alias("part"))
    chunks = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    text = F.when(F.col("part.words") < size, F.array_join(F.slice(chunks, 1, F.col("part.words").cast("int")), "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).orderBy(F.col("part.position"), "doc_id").select(docs.columns)


#: The same rows in SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null' || coalesce(md5(text), ''))) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + rank % 3]::DOUBLE AS weight, [0.5, 0.0, -0.5][1 + rank % 3]::DOUBLE AS tilt, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before, sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM w),
v AS (SELECT *, (total - caps_before) / weight_from AS level FROM l),
f AS (SELECT min_by(level, caps_before) AS level FROM v WHERE level * weight <= cap),
a AS (SELECT source, source_size, tilt, round(coalesce(least(cap, f.level * weight), cap), 6) AS target FROM v LEFT JOIN f ON TRUE),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
p AS (SELECT doc_id, size, source_size, target, tilt, start, floor(target)::BIGINT AS q, greatest(0, least(size, floor(target)::BIGINT - start)) AS p0, greatest(0, least(size, floor(target)::BIGINT - source_size - start)) AS p1, greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - start)) AS p2 FROM c JOIN a ON c.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (p0 + p1 + p2)::BIGINT AS taken,
  CASE WHEN p0 > 0 THEN 0.0 + round(CASE WHEN tilt = 0 THEN start / greatest(target, 1e-9) ELSE ((1 + tilt) - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * (start / greatest(target, 1e-9)), 0))) / (2 * tilt) END, 9) END AS position,
  ((p0 > 0)::INT + (p1 > 0)::INT + (p2 > 0)::INT)::INT AS copies
FROM p
"""
