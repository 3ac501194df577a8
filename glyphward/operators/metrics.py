"""Evaluation operators as aggregates: confusion, accuracy, P/R/F1, latency statistics, rates, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphward.functions import columns as C


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """label, tp, support, predicted, precision, recall, f1 (4 decimals; 0 on empty denominators)."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    t = conf.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = conf.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    d = t.join(p, "label", "full").na.fill(0, ["support", "tp", "predicted"])
    pr, rc = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return d.select("label", "tp", "support", "predicted", F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"), F.round(_ratio(2 * pr * rc, pr + rc), 4).alias("f1"))


def overall(classes: DataFrame) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 from rounded per-class F1."""
    n = F.sum("support")
    return classes.agg(F.round(_ratio(F.sum("tp"), n), 4).alias("accuracy"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1"), F.round(_ratio(F.sum(F.col("f1") * F.col("support")), n), 4).alias("weighted_f1"))


def latency_stats(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, stdev (n-1), p50/p95/p99 by linear interpolation, min, max; 2 decimals, 0 on empty.

    Percentiles are exact, but no task holds the values of a group: they are counted by value, the counts
    by range, and only the values next to a percentile are picked, by rank.
    """
    some = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), some(F.avg(value)).alias("mean"), some(F.stddev_samp(value)).alias("stdev"), some(F.min(value)).alias("min"), some(F.max(value)).alias("max"))
    own = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    # Ranges by binary exponent and leading bits, which keep the order of the values.
    exponent = F.floor(F.log2(F.abs("_v")) * 64)
    own = own.withColumn("_range", F.when(F.col("_v") > 0, exponent + (1 << 20)).when(F.col("_v") < 0, -exponent - (1 << 20)).otherwise(F.lit(0)))
    ranges = own.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*by)
    ranges = ranges.withColumns({"_before": F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_s").over(w)})
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    met = own.alias("x").join(ranges.alias("y"), [*same, F.col("x._range") == F.col("y._range")]).select(*(F.col(f"x.{c}").alias(c) for c in by), "x._range", "_v", "_c", "_before", "_n")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_v"))
    met = met.withColumn("_upto", upto)

    def at(p):
        place = (F.col("_n") - 1) * p  # from 0; between the value there and the next one
        pick = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k), F.col("_v")))
        low, high = pick(F.floor(place)), pick(F.ceil(place))
        return (low + (high - low) * F.max(place - F.floor(place))).alias(f"p{round(p * 100)}")

    points = met.groupBy(*by).agg(*(at(p) for p in (0.5, 0.95, 0.99)))
    if not by:
        return stats.crossJoin(points).select("n", "mean", "stdev", *(some(F.col(f"p{p}")).alias(f"p{p}") for p in (50, 95, 99)), "min", "max")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    both = stats.alias("x").join(points.alias("y"), same, "left")
    return both.select(*(F.col(f"x.{c}").alias(c) for c in by), "n", "mean", "stdev", *(some(F.col(f"p{p}")).alias(f"p{p}") for p in (50, 95, 99)), "min", "max")


def entity_prf(df: DataFrame, expected: str, detected: str) -> DataFrame:
    """Per type, from arrays of (etype, value): TP/FN per expected entity, FP per distinct detected type not expected."""
    types = F.transform(detected, lambda d: d["etype"])
    values = F.transform(detected, lambda d: F.lower(d["value"]))
    e = C.exploded(df, F.col(expected), "e", types.alias("t"), values.alias("v")).select(F.col("e.etype").alias("etype"), (F.array_contains("t", F.col("e.etype")) | F.array_contains("v", F.lower("e.value"))).alias("hit"))
    pos = e.groupBy("etype").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    fp = df.select(F.explode(F.array_except(F.array_distinct(types), F.transform(expected, lambda x: x["etype"]))).alias("etype")).groupBy("etype").agg(F.count("*").alias("fp"))
    d = pos.join(fp, "etype", "full").na.fill(0, ["tp", "fn", "fp"])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return d.select("etype", "tp", "fn", "fp", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_ratio(2 * p * r, p + r), 4).alias("f1"))


def rail_rates(df: DataFrame, expected: str, fired: str) -> DataFrame:
    """Per rail, from arrays of names: tp, fn, fp, tpr and fpr, where fpr's denominator is fp + (total - tp - fn)."""
    total = df.count()
    e = df.select(F.explode(F.array_distinct(F.concat(expected, fired))).alias("rail"), F.col(expected).alias("e"), F.col(fired).alias("f"))
    both = e.groupBy("rail").agg(F.count_if(F.array_contains("e", F.col("rail")) & F.array_contains("f", F.col("rail"))).alias("tp"), F.count_if(~F.array_contains("f", F.col("rail"))).alias("fn"), F.count_if(~F.array_contains("e", F.col("rail"))).alias("fp"))
    return both.select("rail", "tp", "fn", "fp", F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("tpr"), F.round(_ratio(F.col("fp"), F.col("fp") + (F.lit(total) - F.col("tp") - F.col("fn"))), 4).alias("fpr"))


def model_delta(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Difference of per-class F1; a missing class counts 0."""
    b, t = base.select("label", F.col("f1").alias("base_f1")), tuned.select("label", F.col("f1").alias("tuned_f1"))
    d = b.join(t, "label", "full").na.fill(0.0, ["base_f1", "tuned_f1"])
    return d.withColumn("delta", F.round(F.col("tuned_f1") - F.col("base_f1"), 4))


def throughput(df: DataFrame, millis: str) -> DataFrame:
    """Requests a second, as if served one after another."""
    return df.agg(F.count(millis).alias("n"), F.round(_ratio(F.count(millis), F.sum(millis) / 1000), 4).alias("per_second"))


def source_accuracy(df: DataFrame, source: str, truth: str, pred: str) -> DataFrame:
    """Of each source of a decision: how many, how many right, and their share."""
    hit = F.count_if(F.col(truth) == F.col(pred))
    return df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), hit.alias("correct"), F.round(_ratio(hit, F.count("*")), 4).alias("accuracy"))


def strict_recall(df: DataFrame, expected: str, detected: str) -> DataFrame:
    """Expected entities (etype, value) of which a detected one of the same type holds the value or is held by it."""
    met = F.transform(expected, lambda e: F.exists(detected, lambda d: (d["etype"] == e["etype"]) & (F.contains(d["value"], e["value"]) | F.contains(e["value"], d["value"]))).cast("int"))
    n = F.coalesce(F.sum(F.size(expected)), F.lit(0))
    hit = F.coalesce(F.sum(F.aggregate(met, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return df.agg(n.alias("expected"), hit.alias("found"), F.round(_ratio(hit, n), 4).alias("recall"))


def corpus_recall(known: DataFrame, detected: DataFrame) -> DataFrame:
    """Share of the known values (column value) that were detected anywhere, whatever their type."""
    found = known.select("value").distinct().join(detected.select("value").distinct().withColumn("_found", F.lit(True)), "value", "left")
    return found.agg(F.count("*").alias("known"), F.count("_found").alias("found"), F.round(_ratio(F.count("_found"), F.count("*")), 4).alias("recall"))


def roundtrip_fidelity(df: DataFrame, text: str, restored: str, applied: str) -> DataFrame:
    """Share of the redacted rows whose restored text is the original."""
    own = df.filter(F.col(applied))
    return own.agg(F.count("*").alias("n"), F.count_if(F.col(text) == F.col(restored)).alias("same"), F.round(_ratio(F.count_if(F.col(text) == F.col(restored)), F.count("*")), 4).alias("fidelity"))


def egress_rates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From expected_approved, approved, expected_rail and rail: accuracy and false-positive rate (of all rows), and per rail tp, fn and detection_rate.

    fn counts an approved row that should have been stopped twice, as published; missed counts it once.
    """
    n, e, a = F.count("*"), F.col("expected_approved"), F.col("approved")
    fp = F.count_if(~a & e)
    whole = df.agg(n.alias("n"), F.round(_ratio(F.count_if(e == a), n), 4).alias("accuracy"), fp.alias("false_positives"), F.round(_ratio(fp, n), 4).alias("fpr"))
    hit = F.coalesce(F.col("rail") == F.col("expected_rail"), F.lit(False))
    missed = F.count_if(a & ~hit)
    twice = missed + F.count_if(a & ~e)
    rails = df.filter("expected_rail IS NOT NULL").groupBy(F.col("expected_rail").alias("rail")).agg(F.count_if(hit).alias("tp"), twice.alias("fn"), missed.alias("missed"))
    return whole, rails.withColumn("detection_rate", F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4))


def rollup(df: DataFrame, passed: str, by: tuple[str, ...] = ()) -> DataFrame:
    """passed, total and all_passed; null is skipped and in neither count, so nothing but skips passes."""
    d = df.groupBy(*by).agg(F.count_if(F.col(passed)).alias("passed"), F.count(passed).alias("total"))
    return d.withColumn("all_passed", F.col("passed") == F.col("total"))


def preview(text: Column, n: int = 80) -> Column:
    return F.left(text, F.lit(n))


def report_lines(name: str, df: DataFrame) -> DataFrame:
    """A metric table as rows of a report: section, JSON, and a line of a Markdown table."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("markdown"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as path/json (one object a line, by section) and path/markdown (one file a section)."""
    for name, df in tables.items():
        lines = report_lines(name, df)
        lines.select("section", "json").write.mode("overwrite").json(f"{path}/json/{name}")
        head = [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        body = lines.select(F.col("markdown").alias("value"))
        top = df.sparkSession.createDataFrame([("\n".join(head),)], "value string")
        top.union(body).coalesce(1).write.mode("overwrite").text(f"{path}/markdown/{name}")
