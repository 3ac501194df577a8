"""Operator 6: personal data by bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are the seeds. The two words before a seed are
a lexical pattern of its kind; patterns with enough distinct seeds are induced, and
a second pass finds every place where one occurs, followed by an identifier-like
token (one with a digit or @) or by anything else. On the graph of patterns and
instances Spark iterates

    r(instance) = mean of r(pattern) over its places,   seeds fixed at 1,
    r(pattern)  = sum over its places of r(instance) / all its places,

and patterns with a final score of CONFIDENT or more turn the unseen identifiers
after them into spans of their kind. Base spans always stay.

A pattern needs MIN_SEEDS distinct seeds, however large the input is. Up to MAX_PATTERNS
patterns are broadcast at once; of more, groups by hash are searched one after another,
each group by a pass of its own over the texts.

The patterns of the base are rewritten so that a failing start is not rescanned
(possessive digits after a non-digit; the local part of an address is read backwards
from its @); the matches are the same and the time is linear in the text.

Cases: null and empty texts have no span and the hash of the empty string; repeated
rows get the same spans; texts of any length are scanned whole; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.llm.common import maybe_broadcast, materialize, ship, table

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MAX_PATTERNS, ROUNDS, CONFIDENT = 5, 10_000, 4, 0.75

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK, _SPACE = re.compile(r"[0-9@]"), re.compile(r"\s")
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if text.count(".") > 2:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_WORD = re.compile(r"\S+")


class Contexts:
    """The two lower-cased words before any place of a text, whatever their length; its words are looked for once."""

    def __init__(self, text: str):
        self.text, self.words = text, None

    def of(self, start: int) -> str | None:
        if self.words is None:
            self.words = [m.span() for m in _WORD.finditer(self.text)]
            self.starts = [s for s, _ in self.words]
        k = bisect.bisect_left(self.starts, start)
        if k < 2:
            return None
        (s, e), (t, f) = self.words[k - 2], self.words[k - 1]
        return f"{self.text[s:e]} {self.text[t : min(f, start)]}".lower()


def marked(text: str) -> Iterator[tuple[int, int]]:
    """Where the blank-separated tokens with a digit or @ are; other tokens are not looked at one by one."""
    at = 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _SPACE.search(text, m.end())
        at = end.start() if end else len(text)
        yield start, at


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, counts, sha, edges = [], [], [], []
        for text in b.column(2).to_pylist():
            found = base_spans(text)
            spans.append(joined(found))
            counts.append(Counter(k for _, k, _ in found))
            sha.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            before = Contexts(text or "")
            edges.append([{"kind": k, "pattern": c, "instance": text[s:e]} for s, k, e in found if (c := before.of(s))])
        n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *n, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(edges, _EDGES)], names=["doc_id", "th", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "edges"])


_EDGES = pa.list_(pa.struct([("kind", pa.int32()), ("pattern", pa.string()), ("instance", pa.string())]))


def scan(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = "doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, edges array<struct<kind:int,pattern:string,instance:string>>"
    return materialize(d.mapInArrow(_base, kind))


def induce(found: DataFrame) -> DataFrame:
    """(kind, pattern) of the patterns with enough seeds."""
    e = found.filter(F.size("edges") > 0).select(F.explode("edges").alias("e")).select("e.*")
    p = e.groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n")).groupBy("kind", "pattern").agg(F.count("*").alias("seeds"))
    return materialize(p.filter(F.col("seeds") >= MIN_SEEDS).select("kind", "pattern"))


def places(docs: DataFrame, patterns: DataFrame, n: int, most: int = MAX_PATTERNS) -> DataFrame:
    """Where the n patterns (kind, pattern) occur before identifier-like tokens (instance set), and how often before others (instance null)."""
    groups, found = -(-n // most), None
    for g in range(groups):
        own = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g)
        part = _places_of(docs, sorted((r.kind, r.pattern) for r in own.collect()))
        found = part if found is None else found.unionByName(part)
    return found


def _places_of(docs: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, list[int]] = {}
        for kind, p in shared.value:
            kinds.setdefault(p, []).append(kind)
        pairs = {tuple(p.split(" ")) for p in kinds}
        firsts = {x for x, _ in pairs}
        for b in batches:
            rows, seen = [], Counter()
            for doc, th, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not text:
                    continue
                w = text.lower().split()
                seen.update(x for k, v in enumerate(w) if v in firsts and (x := (v, w[k + 1] if k + 1 < len(w) else "")) in pairs)
                base, before = None, Contexts(text)
                for s, e in marked(text):
                    c = before.of(s)
                    if c not in kinds:
                        continue
                    seen[tuple(c.split(" "))] -= 1
                    while s < e and text[s] in _EDGE:
                        s += 1
                    while e > s and text[e - 1] in _EDGE:
                        e -= 1
                    if s == e:
                        continue
                    base = base_spans(text) if base is None else base
                    met = next((x for x in base if x[0] < e and s < x[2]), None)
                    for kind in kinds[c]:
                        seed = met is not None and met[1] == kind
                        rows.append((doc, th, kind, c, text[met[0] : met[2]] if seed else text[s:e], seed, met is None, s, e, 1))
            for x, n in seen.items():
                if n > 0:
                    rows += [(None, None, kind, " ".join(x), None, False, False, 0, 0, n) for kind in kinds[" ".join(x)]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "th", "kind", "pattern", "instance", "seed", "free", "start", "end", "n"])

    kind = "doc_id long, th long, kind int, pattern string, instance string, seed boolean, free boolean, start int, end int, n long"
    return materialize(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, kind))


def confident(found: DataFrame) -> DataFrame:
    """(kind, pattern, score) of the patterns that stay at CONFIDENT or more after ROUNDS rounds."""
    key = ["kind", "pattern"]
    total = found.groupBy(*key).agg(F.sum("n").alias("total"))
    edges = materialize(found.filter("instance IS NOT NULL").groupBy(*key, "instance").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")))
    score = edges.groupBy(*key).agg(F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)).alias("s")).join(total, key).select(*key, (F.col("s") / F.col("total")).alias("score"))
    for _ in range(ROUNDS):
        score = materialize(score)
        mean = edges.join(score, key).groupBy("kind", "instance").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("r"), F.max("seed").alias("is_seed"))
        r = F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.col("r"))
        score = edges.join(mean, ["kind", "instance"]).groupBy(*key).agg(F.sum(F.col("n") * r).alias("s")).join(total, key).select(*key, (F.col("s") / F.col("total")).alias("score"))
    return score.filter(F.col("score") >= CONFIDENT)


def _merge(spans: F.Column, added: F.Column) -> F.Column:
    """Base and added spans, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.filter(F.split(spans, ","), lambda x: x != "")
    old = F.transform(parts, lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), (F.array_position(names, F.split(x, ":")[0]).cast("int") - 1).alias("kind"), F.split(x, ":")[2].cast("int").alias("end")))
    every = F.array_sort(F.concat(old, added))
    return F.array_join(F.transform(every, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame, most: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, counts and hash of the base spans, and all spans."""
    found = scan(docs)
    own = ["doc_id", "th"]
    kept = [*own, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    patterns = induce(found)
    n = patterns.count()
    if not n:
        return found.select(*kept)
    at = places(docs, patterns, n, most)
    new = at.filter("free").join(maybe_broadcast(materialize(confident(at).select("kind", "pattern"))), ["kind", "pattern"])
    added = new.select(*own, F.struct("start", "kind", "end").alias("s")).groupBy(*own).agg(F.array_sort(F.collect_set("s")).alias("added"))
    added = materialize(added.withColumnsRenamed({"doc_id": "own_id", "th": "own_th"}))
    met = found.select(*kept).join(maybe_broadcast(added), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")), "left")
    spans = F.when(F.col("added").isNull(), F.col("spans")).otherwise(_merge(F.col("spans"), F.col("added")))
    return met.select(*kept[:-1], spans.alias("spans"))


def op6_pii_bootstrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data."""
    found = extract(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("th")
    return found.withColumn("n_spans", F.when(F.col("spans") == "", F.lit(0)).otherwise(F.size(F.split("spans", ","))).cast("long"))
