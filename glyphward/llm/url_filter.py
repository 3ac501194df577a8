"""Operator 5: URL verdicts by a blocked Bloom filter and an exact hash join.

Each listed entry has a host and a path; it fits its host with all subdomains, for
paths that start with its own. A page's lookup keys are its host's suffixes times
its path's prefixes, for just the label counts and path lengths that occur in the
list. A split-block Bloom filter of the listed keys (blocks of 8 words of 64 bits,
one bit in each) drops most keys; what passes is joined exactly with the list, so
false positives end there, and the longest entry wins. Pages without an entry are
allowed.

The filter is summed in Spark and bounded by MAX_BLOCKS (64 MB); a fuller one only
passes more keys on. A list of up to LOCAL entries is a hash table in each task, where
the keys that pass are joined with it and no page is shuffled; beyond it the join is
Spark's, with the list broadcast up to BROADCAST_ROWS entries and shuffled beyond,
salted SALTS ways so that a hot host spreads. Lists are made canonical as pages are
(canonical()): host lower-cased, path up to ? or #.

Cases: a null url, or one without `://`, has empty host and path and no rule; an
empty list allows everything; repeated pages and null ids keep their rows; of equal
keys in the list, block wins; very long hosts and paths cost only as many keys as
the list has lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.llm.common import BROADCAST_ROWS, ship, table, wider

ship(__name__)

#: The query's fixed rules: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BITS_PER_KEY, MAX_BLOCKS, SALTS, LOCAL = 16, 1 << 20, 16, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(urls: DataFrame, verdict: str) -> DataFrame:
    """A list (host, path, verdict) from a column url; urls without `://` are left out, an empty path fits every path."""
    host, path = host_and_path(F.col("url"))
    return urls.filter(F.contains("url", F.lit("://"))).select(host.alias("host"), path.alias("path"), F.lit(verdict).alias("verdict")).filter("host <> ''").distinct()


def bloom(keys: DataFrame) -> np.ndarray:
    """(blocks, 8) words of 64 bits; keys: one column, key."""
    n = keys.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // 512))))
    h = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.xxhash64("key", F.lit("bits")).alias("h"))
    bits = h.select("block", F.explode(F.array(*(F.struct(F.lit(k).alias("word"), F.shiftright("h", 6 * k).bitwiseAND(63).cast("int").alias("bit")) for k in range(8)))).alias("b"))
    words = bits.groupBy("block", "b.word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b.bit"))).alias("bits")).toArrow()
    out = np.zeros((blocks, 8), np.int64)
    out[words.column("block").to_numpy(), words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def probe(words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    row = words[np.mod(h1, len(words))]
    bit = (h2[:, None] >> (6 * np.arange(8))) & 63
    return ((row >> bit) & 1).all(1)


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """pages (with url) plus __gw_host, __gw_path, __gw_rule and __gw_verdict; listed: host, path, verdict."""
    spark = pages.sparkSession
    rules = listed.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), "verdict")
    rules = rules.filter("key IS NOT NULL").groupBy("key", "labels", "chars").agg(F.max("verdict").alias("verdict"))
    n = rules.count()
    shapes = sorted(tuple(r) for r in rules.select("labels", "chars").distinct().collect())
    sc = spark.sparkContext
    shared = sc.broadcast(bloom(rules.select("key")))
    host, path = host_and_path(F.col("url"))
    d = pages.withColumns({"__gw_host": host, "__gw_path": path}).withColumn("__gw_labels", F.split("__gw_host", r"\."))

    def key(labels: int, chars: int):
        fits = (F.size("__gw_labels") >= labels) & (F.length("__gw_path") >= chars)
        suffix = F.array_join(F.slice("__gw_labels", F.size("__gw_labels") - labels + 1, F.lit(labels)), ".")
        return F.when(fits, F.concat(suffix, F.substring("__gw_path", 1, chars)))

    keys = F.array_compact(F.array(*(key(*s) for s in shapes))) if shapes else F.array().cast("array<string>")
    d = d.withColumn("__gw_keys", keys).drop("__gw_labels")
    d = d.withColumns({"__gw_h1": F.transform("__gw_keys", lambda k: F.xxhash64(k)), "__gw_h2": F.transform("__gw_keys", lambda k: F.xxhash64(k, F.lit("bits"))), "__gw_uid": F.monotonically_increasing_id()})
    at = {c: d.columns.index(c) for c in ("__gw_keys", "__gw_h1", "__gw_h2")}
    local = sc.broadcast({r.key: r.verdict for r in rules.select("key", "verdict").collect()}) if n <= LOCAL else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            keys = b.column(at["__gw_keys"])
            n_keys = np.asarray(keys.value_lengths().fill_null(0))
            h1, h2 = (np.asarray(b.column(at[c]).flatten()).astype(np.int64) for c in ("__gw_h1", "__gw_h2"))
            passed = probe(words, h1, h2) if len(h1) else np.array([], bool)
            if local is not None:
                page = np.repeat(np.arange(b.num_rows), n_keys)[passed]
                rule, verdict = [None] * b.num_rows, [None] * b.num_rows
                for p, key in zip(page.tolist(), keys.flatten().filter(pa.array(passed, pa.bool_())).to_pylist(), strict=True):
                    if (found := local.value.get(key)) is not None and (rule[p] is None or len(key) > len(rule[p])):
                        rule[p], verdict[p] = key, found
                more = [pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "__gw_rule", "__gw_verdict"])
                continue
            counts = np.bincount(np.repeat(np.arange(b.num_rows), n_keys), passed, b.num_rows).astype(np.int32) if b.num_rows else np.array([], np.int32)
            hits = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), keys.flatten().filter(pa.array(passed, pa.bool_())))
            yield pa.RecordBatch.from_arrays([*b.columns, hits], names=[*b.schema.names, "__gw_hits"])

    own = [*(F.col(f"`{c}`") for c in pages.columns), "__gw_host", "__gw_path"]
    if local is not None:
        d = d.mapInArrow(run, wider(d, __gw_rule="string", __gw_verdict="string"))
        return d.select(*own, "__gw_rule", F.coalesce("__gw_verdict", F.lit("allow")).alias("__gw_verdict"))
    d = d.mapInArrow(run, wider(d, __gw_hits="array<string>")).drop("__gw_keys", "__gw_h1", "__gw_h2")
    d = d.withColumn("__gw_key", F.explode_outer("__gw_hits")).drop("__gw_hits")
    rules = rules.select(F.col("key").alias("__gw_key"), F.col("verdict").alias("__gw_found"))
    if n <= BROADCAST_ROWS:
        met = d.join(F.broadcast(rules), "__gw_key", "left")
    else:
        salted = rules.withColumn("__gw_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = d.withColumn("__gw_salt", F.pmod("__gw_uid", F.lit(SALTS))).join(salted, ["__gw_key", "__gw_salt"], "left")
    best = F.max(F.when(F.col("__gw_found").isNotNull(), F.struct(F.length("__gw_key").alias("n"), F.col("__gw_key").alias("rule"), F.col("__gw_found").alias("verdict"))))
    out = met.groupBy("__gw_uid").agg(best.alias("__gw_best"), *(F.first(f"`{c}`").alias(c) for c in [*pages.columns, "__gw_host", "__gw_path"]))
    return out.select(*own, F.col("__gw_best.rule").alias("__gw_rule"), F.coalesce("__gw_best.verdict", F.lit("allow")).alias("__gw_verdict"))


def op5_url_bloom_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under RULES."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    return out.select("page_id", F.col("__gw_host").alias("host"), F.col("__gw_path").alias("path"), F.col("__gw_rule").alias("rule"), F.col("__gw_verdict").alias("verdict"))


SQL = f"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (
  SELECT page_id, row_number() OVER () AS k,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
d AS (
  SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT d.k, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM d JOIN r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p) GROUP BY d.k)
SELECT d.page_id, coalesce(d.host, '') AS host, coalesce(d.path, '') AS path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM d LEFT JOIN m ON d.k = m.k
"""
