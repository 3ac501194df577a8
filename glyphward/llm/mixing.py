"""Operator 7: mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size. They
are prefix-summed within the source, one random offset per source is added, and the
document is emitted once for each integer boundary that its interval crosses. Rows
run by size within a source, so that the sample is spread evenly over long and short
documents and the words taken come near the target.

No source is summed in one task: ranks come from counts by (source, size) and by
(source, size, first two digits of the hash), so a hot source, or thousands of
copies of one text, are split 256 ways.

Cases: null or empty texts have size 0 (they are sampled like others, taken 0);
a null source is a source of its own, last; an empty table gives no rows; repeated
rows are sampled independently; extra columns are ignored or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphward.llm.common import WORD, table, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"
#: Offsets have 20 bits, so that offset + ratio * rank stays exact enough in a double.
OFFSET_BITS = 20


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (__gw_source, source_size) -> target: water-filling under the cap, over the per-source table."""
    by_name = Window.orderBy(F.col("__gw_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("__gw_w", weight).withColumn("__gw_cap", MAX_COPIES * F.col("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("__gw_limit", F.col("__gw_cap") / F.col("__gw_w"))
    order = Window.orderBy("__gw_limit", F.col("__gw_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level that holds if all sources before this one, by cap over weight, stop at their caps.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__gw_cap").over(before), F.lit(0))) / F.sum("__gw_w").over(onward)
    s = s.withColumns({"__gw_level": level, "__gw_at": F.row_number().over(order)})
    first = F.min(F.when(F.col("__gw_level") <= F.col("__gw_limit"), F.struct("__gw_at", "__gw_level"))).over(everything)
    s = s.withColumn("__gw_water", F.coalesce(first["__gw_level"], F.lit(0.0)))
    target = F.least(F.col("__gw_cap").cast("double"), F.col("__gw_w") * F.col("__gw_water"))
    return s.select("__gw_source", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with __gw_size, __gw_source_size, __gw_target and __gw_copies."""
    null_key = F.col("source").isNull()
    d = docs.withColumns(
        {
            "__gw_size": word_count(text_or_empty()),
            "__gw_source": F.col("source"),
            "__gw_null": null_key,
            "__gw_key": F.coalesce(F.col("source"), F.lit("")),
            "__gw_hash": F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        }
    ).withColumn("__gw_bucket", F.substring("__gw_hash", 1, 2))
    src = ["__gw_null", "__gw_key"]
    cell = [*src, "__gw_size", "__gw_bucket"]
    cells = d.groupBy(*cell).agg(F.count("*").alias("__gw_n"))
    by_size = cells.groupBy(*src, "__gw_size").agg(F.sum("__gw_n").alias("__gw_n"))
    sizes = by_size.groupBy(*src).agg(F.sum(F.col("__gw_n") * F.col("__gw_size")).alias("source_size"))
    sizes = sizes.withColumn("__gw_source", F.when(~F.col("__gw_null"), F.col("__gw_key")))
    targets = source_targets(sizes).select(
        F.col("__gw_source").isNull().alias("__gw_null"), F.coalesce("__gw_source", F.lit("")).alias("__gw_key"), F.col("source_size").alias("__gw_source_size"), F.col("target").alias("__gw_target")
    )
    before = Window.partitionBy(*src).orderBy("__gw_size").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.withColumn("__gw_start", F.coalesce(F.sum("__gw_n").over(before), F.lit(0))).drop("__gw_n").join(targets, src)
    inner = Window.partitionBy(*src, "__gw_size").orderBy("__gw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__gw_inner", F.coalesce(F.sum("__gw_n").over(inner), F.lit(0))).drop("__gw_n").join(starts, [*src, "__gw_size"])
    ranked = d.withColumn("__gw_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("__gw_hash", "doc_id"))).join(cells, cell)
    rank = F.col("__gw_start") + F.col("__gw_inner") + F.col("__gw_rank")
    ratio = F.when(F.col("__gw_source_size") > 0, F.col("__gw_target") / F.col("__gw_source_size")).otherwise(F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":offset:"), F.col("__gw_key"))), 1, OFFSET_BITS // 4)
    offset = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << OFFSET_BITS))
    ranked = ranked.withColumns({"__gw_ratio": ratio, "__gw_offset": offset, "__gw_at": rank})
    crossed = F.floor(F.col("__gw_offset") + F.col("__gw_ratio") * F.col("__gw_at")) - F.floor(F.col("__gw_offset") + F.col("__gw_ratio") * (F.col("__gw_at") - 1))
    return ranked.withColumn("__gw_copies", crossed.cast("long"))


def op7_mix_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix takes from each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("__gw_size").alias("size"), F.col("__gw_source_size").alias("source_size"), F.col("__gw_target").alias("target"), (F.col("__gw_copies") * F.col("__gw_size")).alias("taken")
    )


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    kept = mix(docs).filter(F.col("__gw_copies") > 0)
    return kept.withColumn("__gw_copy", F.explode(F.sequence(F.lit(1), F.col("__gw_copies")))).select(*docs.columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, {MAX_COPIES} * source_size AS cap FROM s),
l AS (
  SELECT *, cap / w AS lim, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS o,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM w),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), w * coalesce((SELECT arg_min(lvl, o) FROM l WHERE lvl <= lim), 0.0::DOUBLE)) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS ratio,
    CAST('0x' || left(md5('{SEED}:offset:' || coalesce(d.source, '')), 5) AS INTEGER)::DOUBLE / 1048576.0::DOUBLE AS off,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(off + ratio * k) - floor(off + ratio * (k - 1)) AS BIGINT) * size AS taken
FROM r
"""
