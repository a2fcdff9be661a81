"""Operator 9: mixing sources to target weights along a time-varying curriculum.

Each source's weight is a piecewise linear function of training time in [0, 1]. Its
integral gives the source's share of the demand; the cumulative demand, inverted at a
document's place among its source's words, gives the document's training position, and
a range sort by position gives the training order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import basic, packed, staged, unpacked

WORDS = r"[^\x20\x09-\x0D]+"
#: Knots (time, weights of the repeating classes of sources). This one holds 5, 2, 1 throughout.
CONSTANT = ((0.0, (5.0, 2.0, 1.0)), (1.0, (5.0, 2.0, 1.0)))
#: A curriculum with the same totals: the first class fades from 8 to 2, the third comes in from 0 to 2.
CURRICULUM = ((0.0, (8.0, 2.0, 0.0)), (1.0, (2.0, 2.0, 2.0)))
MOST = 3
BUCKET_DIGITS = 3


def integrals(schedule, k: int) -> list[float]:
    """The integral of class k's weight up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append(out[-1] + (t1 - t0) * (w0[k] + w1[k]) / 2)
    return out


def _by_class(values: list[float], cls: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), cls)


def targets(sizes: DataFrame, schedule=CONSTANT, most: int = MOST) -> DataFrame:
    """Per source of `sizes` (source, source_size): class, weight and target.

    Sources by code point, null last, take the classes in turn. Targets share out the sum of
    all sizes by weight, stop at `most` times the source's size, and the excess is shared
    again until none is above: the level at which that ends is the largest, over the number
    of stopped sources in order of size to weight, of what remains by remaining weight.
    The windows run over one row per source, already aggregated."""
    n_classes = len(schedule[0][1])
    weights = [integrals(schedule, k)[-1] for k in range(n_classes)]
    ranked = sizes.withColumn("class", ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % n_classes + 1).cast("int"))
    ranked = ranked.withColumn("weight", _by_class(weights, F.col("class")))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("_level", level)
    levelled = levelled.withColumn("_level", F.max("_level").over(every))
    return levelled.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.col("_level"))).drop("_level")


def position(schedule, cls: Column, share: Column) -> Column:
    """The training time at which a source of that class has met this share of its demand."""
    out = None
    for k in range(len(schedule[0][1])):
        area, total = integrals(schedule, k), integrals(schedule, k)[-1]
        if total <= 0:
            continue
        need, at = share * F.lit(total), F.lit(1.0)
        for i in range(len(schedule) - 2, -1, -1):
            (t0, w0), (t1, w1) = schedule[i], schedule[i + 1]
            if area[i + 1] <= area[i]:
                continue
            rest, slope = need - F.lit(area[i]), (w1[k] - w0[k]) / (t1 - t0)
            step = rest / F.lit(w0[k]) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0[k] ** 2) + F.lit(2 * slope) * rest)) - F.lit(w0[k])) / F.lit(slope)
            at = F.when(need < F.lit(area[i + 1]), F.lit(t0) + step) if i == len(schedule) - 2 else F.when(need < F.lit(area[i + 1]), F.lit(t0) + step).otherwise(at)
            if i == len(schedule) - 2:
                at = at.otherwise(F.lit(1.0))
        out = F.when(cls == k + 1, at) if out is None else out.when(cls == k + 1, at)
    return out if out is not None else F.lit(None).cast("double")


def placed(docs: DataFrame, schedule=CONSTANT, most: int = MOST, seed: int = 0, keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, class, weight, target, and `before`: its source's words ahead of it.

    A source's documents go in the order of the md5 of seed, doc_id and text, so any rerun and any
    partitioning gives the same order, and many rows of one id, or of none, are spread like others. A hot
    source is split by the first digits of that hash; only sums of the parts are added up across them. A
    null text has size 0; null sources are one source; rows of equal id and text are interchangeable.
    Without `keep_text` the texts are read once, and only ids, sources, sizes and hashes move."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
    # A source's name that is never null: the window and the join share one partitioning, so that rows move once.
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    sized = sized.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, BUCKET_DIGITS)).withColumn("_src", name)
    if not keep_text:
        sized = staged(sized.drop("text"), "mix-sizes")
    # A line for each part of a source; written, so that the texts are read for it once only.
    parts = staged(sized.groupBy("_src", "source", "_part").agg(F.sum("size").alias("_part_size")), "mix-parts")
    sources = targets(parts.groupBy("source").agg(F.sum("_part_size").alias("source_size")), schedule, most)
    earlier = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_part_size").over(earlier), F.lit(0)))
    parts = parts.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("_src", "_part", "_ahead", "source_size", "class", "weight", "target")
    within = Window.partitionBy("_src", "_part").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("_in_part", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = sized.join(parts, ["_src", "_part"])
    return joined.withColumn("before", F.col("_ahead") + F.col("_in_part")).drop("_ahead", "_in_part", "_part", "_src", "_key")


def mix(docs: DataFrame, schedule=CONSTANT, most: int = MOST, seed: int = 0) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, readings, position, last_position; range-sorted by position.

    A source is read from its first word on, again from the front after its last, until its demand is met. Each
    reading of a document starts at a place in that stream; the cumulative demand, inverted there, is its
    training time, and of its words those count that the demand at the end of training still reaches. `taken`
    adds them up, so the sum over a source is its rounded target. position and last_position are the times of
    the first and the last reading; documents that aren't read (size 0, null or empty texts; beyond the demand)
    have none and come last.

    Repeated rows are documents of their own; equal positions go by doc_id. A text of any length has its words
    counted whole. An empty table gives no rows; other columns, whatever their names, are ignored."""
    rows = placed(basic(docs, "doc_id", "text", "source"), schedule, most, seed, keep_text=False)
    goal, size, S = F.round("target").cast("long"), F.col("size"), F.col("source_size")
    # target is at most `most` times the source's size: there are no more readings than that.
    words = [F.greatest(F.lit(0), F.least(size, goal - (F.col("before") + S * k))).cast("long") for k in range(most)]
    rows = rows.withColumn("taken", sum(words[1:], words[0])).withColumn("readings", sum([(w > 0).cast("int") for w in words[1:]], (words[0] > 0).cast("int")))
    at = lambda k: F.when(F.col("taken") > 0, position(schedule, F.col("class"), (F.col("before") + S * k) / F.col("target")))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "taken", "readings", at(F.lit(0)).alias("position"), at(F.col("readings") - 1).alias("last_position"))
    order = [F.asc_nulls_last("position"), F.asc_nulls_last("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, schedule=CONSTANT, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mix itself: whole documents, each as often as it is read, range-sorted by training position.

    A document is read once more in its source's last, partial pass if at least half of its words
    lie ahead of the target. Columns as in docs, whatever other columns there are. A null or empty text has no
    words and goes with its place among the others; repeated rows are documents of their own; equal positions
    go by doc_id. An empty table stays empty."""
    kept = ("doc_id", "text", "source")
    rows = placed(packed(docs, *kept), schedule, most, seed)
    size, S, goal = F.col("size"), F.col("source_size"), F.round("target").cast("long")
    rows = rows.withColumn("_goal", goal).withColumn("_passes", F.when(S > 0, F.floor(F.col("_goal") / S)).otherwise(F.lit(0)).cast("int"))
    last = F.when(2 * F.col("before") + size < 2 * (F.col("_goal") - F.col("_passes") * S), 1).otherwise(0)
    rows = rows.withColumn("_copies", F.col("_passes") + last).filter("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    share = (F.col("before") + F.col("_copy") * S) / F.col("target")
    rows = rows.withColumn("_position", position(schedule, F.col("class"), share))
    return rows.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id", "_copy").transform(unpacked, docs.columns, kept)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT) AS class,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size) OVER before, 0) * 3 AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM s WINDOW before AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, class, least(source_size * 3.0::DOUBLE, weight * (SELECT max(level) FROM l)) AS target FROM l),
c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.class, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, goal - ahead)) AS a, greatest(0, least(size, goal - ahead - source_size)) AS b,
         greatest(0, least(size, goal - ahead - 2 * source_size)) AS c
  FROM c),
r AS (
  SELECT *, CAST(a + b + c AS BIGINT) AS taken, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS INTEGER) AS readings FROM q),
p AS (
  SELECT *, ahead / target AS x, (ahead + source_size * (readings - 1)) / target AS y FROM r)
SELECT doc_id, source, size, source_size, target, taken, readings,
       CASE WHEN taken > 0 THEN round(CASE class WHEN 1 THEN (sqrt(64 - 12 * (x * 5)) - 8) / -6 WHEN 2 THEN x * 2 / 2 ELSE sqrt(4 * x) / 2 END, 9) + 0.0 END AS position,
       CASE WHEN taken > 0 THEN round(CASE class WHEN 1 THEN (sqrt(64 - 12 * (y * 5)) - 8) / -6 WHEN 2 THEN y * 2 / 2 ELSE sqrt(4 * y) / 2 END, 9) + 0.0 END AS last_position
FROM p
"""
