"""Mixing sources to target weights by capped water-filling.

Sources get targets in proportion to their weights; a source whose target would exceed
``max_epochs`` times its size is clamped there, and the excess goes to the others in proportion to
their weights until none is above. The fixed point has a closed form: with sources in order of
cap over weight, source k is clamped as long as its ratio is not above the level that the
remaining budget and weight give.

A document is taken ``floor(target / size)`` times whole, and the remaining fraction of its source
is filled by whole documents in an order that a seeded hash of the id and the text fixes, up to the
document that would pass the target (it is taken if that comes closer). Reruns agree, also on
rows without an id.

Work at scale: one row per source is all that meets in one place. The cumulative size inside a
source is never one window: hash values fall into ``buckets`` equal ranges per source, bucket totals
are summed on the map side, and only the bucket in which the target falls is walked document
by document. So a source with a third of all rows is spread over its buckets.

Defined results: NULL or empty texts have size 0 and are taken as their source is, at size 0. A
NULL source is a source of its own, last in the order of code points. Sources of total size 0
get target 0. Repeated rows are documents of their own (which of several equal ones is taken cannot be told).
The input may have columns of any names but those that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewatch.llm.common import word_count, written

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) to these and ``target``. Weights repeat over the sources in order of
    code points, NULL last; the targets add up to ``share`` times all sizes where the caps allow."""
    # one row per source: these windows see the table of sources, never documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", max_epochs * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.when(F.col("cap") / F.col("w") > F.col("left") / F.col("w_left"), F.col("left") / F.col("w_left")))
    # the first source that is not clamped fixes the level of all from there on
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("w") * F.col("level"))).alias("target"))


def unit_hash(id_col: str, text_col: str, seed: int):
    """A number below 2 ** 48 from a seeded hash of the id and the text (the same in any SQL engine): rows that share
    an id, or have none, are told apart by their texts and spread like any others."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _small(plan: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """The table of sources, to be broadcast if its measured size allows; else an ordinary join."""
    size = plan.agg(F.sum(F.coalesce(F.octet_length("_p_source"), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(plan) if size <= most_bytes else plan


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7,
        weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, buckets: int = 4096) -> DataFrame:
    """``docs`` with size, source_size, target (of the source), times and taken (words taken)."""
    added = ["size", "source_size", "target", "times", "taken"]
    # the input's columns travel as one struct, so none of their names can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("_row")
    sized = docs.select(row, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size"),
                        unit_hash(id_col, text_col, seed).alias("_u")).withColumn("_bucket", F.floor(F.col("_u") * buckets / 2**48))
    per_bucket = (sized.groupBy(F.col("_source").alias("source"), F.col("_bucket").alias("bucket"))
                  .agg(F.sum("_size").alias("words")))
    plan = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = plan.withColumn("part", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # at most `buckets` rows per source
    filled = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("words").over(filled), F.lit(0)))
    starts = starts.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cut = starts.filter((F.col("start") <= F.col("part")) & (F.col("part") < F.col("start") + F.col("words")))
    cut = cut.select("source", "bucket", F.col("start").alias("cut_start"))
    plan = plan.join(cut.select(F.col("source").alias("s"), F.col("bucket").alias("cut"), "cut_start"),
                     F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.select(*[F.col(c).alias(f"_p_{c}") for c in plan.columns])
    rows = sized.join(_small(written(plan, "mix-plan")), F.col("_source").eqNullSafe(F.col("_p_source")))
    whole_bucket = F.col("_p_part") > 0
    # no cut bucket: the fraction covers all buckets (or is zero)
    in_cut = F.col("_bucket") == F.col("_p_cut")
    sure = whole_bucket & F.when(F.col("_p_cut").isNull(), True).otherwise(F.col("_bucket") < F.col("_p_cut"))
    edge = rows.filter(in_cut)
    walk = Window.partitionBy("_source").orderBy("_u", "_id", "_size")
    edge = edge.withColumn("_upto", F.col("_p_cut_start") + F.sum("_size").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    closer = F.col("_upto") - F.col("_p_part") < F.col("_p_part") - (F.col("_upto") - F.col("_size"))
    edge = edge.withColumn("_extra", ((F.col("_upto") <= F.col("_p_part")) | closer) & whole_bucket).drop("_upto")
    out = rows.filter(~F.coalesce(in_cut, F.lit(False))).withColumn("_extra", sure).unionByName(edge)
    times = (F.col("_p_whole") + F.col("_extra").cast("long")).cast("long")
    return out.select("_row.*", F.col("_size").alias("size"), F.col("_p_source_size").alias("source_size"),
                      F.col("_p_target").alias("target"), times.alias("times"), (times * F.col("_size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixture itself: every document as often as it is taken."""
    return mixed.filter("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_copy")


#: The same in SQL for the query on documents.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
        1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER f, 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS w_rest FROM s
      WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT min(CASE WHEN cap / w > rest / w_rest THEN cap / w END) AS first_free FROM o),
lev AS (SELECT max(rest / w_rest) AS level FROM o, lv WHERE cap / w = first_free),
t AS (SELECT source, source_size, CASE WHEN first_free IS NULL OR cap / w < first_free THEN cap ELSE least(cap, w * level) END AS target
      FROM o, lv LEFT JOIN lev ON true),
c AS (SELECT d.doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole,
        sum(size) OVER (PARTITION BY d.source ORDER BY u, d.doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(target - whole * source_size, 0) AS part FROM c)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN part > 0 AND (upto <= part OR upto - part < part - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
