"""Requests and their context: classification with route, mapping reads, compression, cost, egress rules, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphward.functions import rules
from glyphward.operators import privacy

TTL_SECONDS, COMPRESS_BYTES, DEFAULT_TIER = 300, 184_320, "MEDIUM"

# Price of a million input and output tokens of each model.
PRICES = (("qwen3.6-35b-a3b", 0.0, 0.0), ("gemini-3-flash-preview", 0.15, 0.60), ("gemini-3.1-pro-preview", 1.25, 10.0))
FALLBACK_MODEL = "gemini-3-flash-preview"
# Networks that egress may not reach (first address, bits), and the one port that it may use.
PRIVATE_NETWORKS, EGRESS_PORT = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16)), 443


def classify(df: DataFrame, tier: str = "tier") -> DataFrame:
    """Adds level, confidence, origin and routing_action from fast_level, fast_confidence, emb_level and emb_score; a null tier is MEDIUM."""
    level, conf, origin = privacy.combine(F.col("fast_level"), F.col("fast_confidence"), F.col("emb_level"), F.col("emb_score"))
    d = df.withColumns({"level": level, "confidence": conf, "origin": origin})
    return d.withColumn("routing_action", privacy.routing_action(F.coalesce(F.col(tier), F.lit(DEFAULT_TIER)), F.col("level")))


def mapping_reads(ops: DataFrame, ttl: int = TTL_SECONDS, ties: str = "seq") -> DataFrame:
    """Of a mapping store's log (mapping_id, op put or get, payload, at in seconds, ties): each get with found and payload.

    A get takes what was put last, if nothing took it since and it is not older than the TTL.
    """
    w = Window.partitionBy("mapping_id").orderBy("at", ties)
    d = ops.withColumn("_last", F.lag(F.struct("op", "payload", "at")).over(w))
    found = F.coalesce((F.col("_last.op") == "put") & (F.col("at") - F.col("_last.at") <= ttl), F.lit(False))
    return d.filter("op = 'get'").select("mapping_id", ties, found.alias("found"), F.when(found, F.col("_last.payload")).alias("payload"))


def active_mappings(ops: DataFrame, now: Column, ttl: int = TTL_SECONDS, ties: str = "seq") -> DataFrame:
    """The mappings that a get would find at `now` (a look that takes nothing); count them for the size of the store."""
    last = ops.groupBy("mapping_id").agg(F.max(F.struct("at", ties, "op", "payload")).alias("m"))
    return last.filter((F.col("m.op") == "put") & (now - F.col("m.at") <= ttl)).select("mapping_id", "m.payload", "m.at")


def compressed(text: Column, least: int = COMPRESS_BYTES) -> Column:
    """Texts of `least` bytes or more: JSON without blanks, or else each line once, runs of blanks as one."""
    lines = F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " ")))
    compact = F.when(F.ltrim(text).rlike(r"^[\[{]"), F.get_json_object(text, "$"))
    return F.when(F.octet_length(text) >= least, F.coalesce(compact, F.array_join(lines, "\n"))).otherwise(text)


def cost(df: DataFrame, model: str = "model", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """Adds cost; unknown models cost null."""
    prices = df.sparkSession.createDataFrame([(m, float(a), float(b)) for m, a, b in PRICES], "_model string, _in double, _out double")
    met = df.join(F.broadcast(prices), F.col(model) == F.col("_model"), "left")
    return met.withColumn("cost", (F.col(tokens_in) * F.col("_in") + F.col(tokens_out) * F.col("_out")) / 1e6).drop("_model", "_in", "_out")


def with_fallback(model: Column, failed: Column) -> Column:
    return F.when(F.coalesce(failed, F.lit(False)) | model.isNull(), F.lit(FALLBACK_MODEL)).otherwise(model)


def _address(ip: Column) -> Column:
    """An IPv4 address as a number; null where it is none."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    number = sum((F.get(parts, k).try_cast("long") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    return F.when(ok & F.forall(parts, lambda p: p.try_cast("int") <= 255), number)


def egress_allowed(ip: Column, port: Column) -> Column:
    """Whether a connection leaves the private networks on the one open port; what is no address may not pass."""
    n = _address(ip)
    outside = F.lit(True)
    for first, bits in PRIVATE_NETWORKS:
        outside = outside & (F.shiftright(n, 32 - bits) != F.shiftright(_address(F.lit(first)), 32 - bits))
    return F.coalesce(outside & (port == EGRESS_PORT), F.lit(False))


def inventory(spark: SparkSession, site: rules.Site = rules.Site()) -> DataFrame:
    """How many rules of each kind and level or type are loaded."""
    rows = [("keyword", v, k) for v, ks in rules.level_keywords(site).items() for k in ks]
    rows += [("pattern", v, n) for v, ps in rules.level_patterns(site).items() for n, _ in ps]
    rows += [("recognizer", t, p) for t, p, _ in rules.recognizers(site)]
    rows += [("secret", "", p) for p in rules.SECRET_PATTERNS] + [("pii", n, p) for n, p in rules.PII_PATTERNS]
    return spark.createDataFrame(rows, "kind string, of string, name string").groupBy("kind", "of").agg(F.count("*").alias("n"))
