"""Operator 9: secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three patterns. Every candidate value (of a base span, or a
bare credential-shaped token) is hashed; hashes are counted over distinct documents
(repositories) and distinct sources (owners). A value of two or more owners is a
widely copied example; one that a single owner has, and that looks live (DISTINCT
different characters or more, letters and digits), is that owner's credential. The
method adds spans where such a credential, assigned to a key somewhere, stands bare
elsewhere with the same owner.

Offsets are code points: Spark's length() counts them, and a match starts where the
pieces between matches and the matches before it end.

Cases: null and empty texts have no span and the hash of the empty string; very long
texts are searched whole, in time linear in their hits; null
owners are one owner; repeated rows keep their own result (and count as documents of
their own); spans that start together are in the order of the kinds; matches that are too
short are dropped and not retried; extra columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphward.functions.columns import placed
from glyphward.llm.common import materialize, table, text_or_empty

#: Fixed patterns of the three kinds; the flag group holds the key only.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A maximal run of credential characters, as long as an assigned value has to be, with a digit among them.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{6,}+"
KINDS = ("assign", "access", "hex")
MIN_ASSIGNED, DISTINCT = 6, 5


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def find(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value); value is the group, of `least` characters or more."""
    spans = F.transform(placed(text, pattern, group), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("end"), m["value"].alias("value")))
    if least:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, owner, base spans and bare tokens; in the shared folder."""
    t = docs.select("doc_id", F.col("source").alias("owner"), text_or_empty().alias("text"))
    t = t.select("doc_id", "owner", find(F.col("text"), 0, ASSIGN, 2, MIN_ASSIGNED).alias("a"), find(F.col("text"), 1, ACCESS).alias("k"), find(F.col("text"), 2, HEX).alias("h"), find(F.col("text"), 0, BARE).alias("bare"))
    base = F.array_sort(F.concat("a", "k", "h"))
    loose = F.filter("bare", lambda b: ~b["value"].rlike(HEX) & ~b["value"].rlike(ACCESS))
    t = t.withColumn("base", base).withColumn("bare", loose)
    n = [F.size(c).cast("long").alias(f"n_{k}") for c, k in zip("akh", KINDS, strict=True)]
    return materialize(t.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "owner", *n, "base", "bare"))


def ownership(found: DataFrame) -> DataFrame:
    """uid, and of its candidates: hash, bare, the span, owners, repositories, and whether a key was assigned the value."""
    both = F.concat(
        F.transform("base", lambda s: F.struct(F.lit(False).alias("bare"), F.sha2(s["value"], 256).alias("hash"), (s["kind"] == 0).alias("assigned"), s.alias("span"))),
        F.transform("bare", lambda s: F.struct(F.lit(True).alias("bare"), F.sha2(s["value"], 256).alias("hash"), F.lit(False).alias("assigned"), s.alias("span"))),
    )
    c = found.filter((F.size("base") > 0) | (F.size("bare") > 0)).select("uid", F.struct("owner").alias("own"), F.explode(both).alias("c")).select("uid", "own", "c.*")
    # Bare tokens that a base span reaches into, or that one starts in, are no candidates of their own.
    before, own = (Window.unboundedPreceding, -1), Window.partitionBy("uid")
    left = F.max(F.when(~F.col("bare"), F.col("span.end"))).over(own.orderBy("span.start", "bare").rowsBetween(*before))
    # From the end, as a frame that runs to the end would be summed anew for each row.
    right = F.min(F.when(~F.col("bare"), F.col("span.start"))).over(own.orderBy(F.col("span.start").desc(), F.col("bare").desc()).rowsBetween(*before))
    c = c.withColumns({"left": left, "right": right})
    met = (F.col("left") > F.col("span.start")) | (F.col("right") < F.col("span.end"))
    c = c.filter(~F.col("bare") | ~F.coalesce(met, F.lit(False))).drop("left", "right")
    by_doc = c.groupBy("hash", "own", "uid").agg(F.max("assigned").alias("assigned"))
    by_owner = by_doc.groupBy("hash", "own").agg(F.count("*").alias("docs"), F.max("assigned").alias("assigned"))
    freq = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("docs").alias("repositories"), F.max("assigned").alias("ever_assigned"))
    return c.join(freq, "hash")


def live_looking(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base and added spans, and how many candidates are shared or owner-specific."""
    found = scan(docs)
    c = ownership(found)
    own = (F.col("owners") == 1) & live_looking(F.col("span.value"))
    add = F.collect_list(F.when(F.col("bare") & own & F.col("ever_assigned"), F.col("span")))
    per_doc = c.groupBy("uid").agg(F.count_if(~F.col("bare") & (F.col("owners") > 1)).alias("n_shared"), F.count_if(~F.col("bare") & own).alias("n_owner_specific"), add.alias("added"))
    return found.join(per_doc, "uid", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN)))))


def op9_secrets_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secret spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = secrets(docs)
    return out.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_shared", "n_owner_specific"))
    )
