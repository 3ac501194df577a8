"""Operator 8: SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a nonzero vector m(i) of {0,1}^(r+1); for each of the
2^(r+1)-1 nonzero vectors v, the mask of table v keeps the bits with <m(i), v> odd.
If two fingerprints differ in at most r bits, the r equations <m(i), v> = 0 of the
differing bits have a nonzero solution v, and in that table the two collide: no
pair within the radius is lost (Pagh 2016). Here r = 3, 64 bits, 15 tables.

Only distinct fingerprints are hashed, so thousands of copies cost one row. In each
bucket links are checked exactly and a spanning forest is emitted, never all pairs;
a bucket over BLOCK members is split into blocks whose pairs are separate cells, so
no task holds more than two blocks of it and still every pair is compared.
Components come from alternating large-star and small-star rounds, each written to
the shared folder, until ONE_TASK edges or fewer are left; one task finishes those. A
round is some ten shuffles, each with its partitions to be kept in mind by the driver.

Near copies (near_copies, the pipeline's stage) are texts whose sets of five-word
shingles have a Jaccard similarity of SIMILAR or more. At that similarity fingerprints
of shingles differ in about ten bits, too many to cover, so there the fingerprint is of
single words, which a few edits hardly move (counts are capped, so that the frequent
words of a language do not draw its texts together). It is cut in two halves: of
NEAR_RADIUS differing bits one half has at most half, so the masks of that radius over
each half cover the pair. Candidate groups are the components of these
links; in them the whole shingle sets, of 64-bit hashes, are compared and only similar
texts are linked, whatever their length.

Similar texts may still have fingerprints further apart (a copy with a footer, or cut
short), so between the groups so found every other similar pair is found exactly, by
prefix filtering. First the texts are left out that share too few of their first shingles
(by hash) with any other text. The shingles of the others are counted, ordered from rare
to common, and a pair similar enough shares one of the first shingles of both. Texts of
one shingle are linked in a star, not in pairs; the groups of these links are compared in
blocks of whole shingle sets.

Cases: null and empty texts have fingerprint zero and are linked like any other;
fewer than three words make one shingle; repeated rows and null ids stay (a
component id is null only if all its ids are); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphward.llm.common import materialize, maybe_broadcast, ship, table, text_or_empty, wider

ship(__name__)

RADIUS, BITS, SHINGLE, SEED = 3, 64, 3, 42
BLOCK = 2048
NEAR_SHINGLE, NEAR_RADIUS, SIMILAR, NEAR_BLOCK, WEIGHT_COUNT = 5, 7, 0.8, 1 << 19, 4
#: Of the prefix filter: texts sampled for common shingles, how many of them make one common, and one more shared shingle for so many.
#: NEAR_BLOCK: shingles of a block of a candidate group.
LATE_TEXTS, COMMON, PREFIX_SHARE = 8000, 3, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
#: Up to so many fingerprints, half of them makes a selective enough key; the links are the same either way.
HALVES = 1 << 27
#: Up to so many edges (2 MB of them), one task finds the components without rounds; they are the same either way.
ONE_TASK = 1 << 17


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the XXH64 of all word shingles, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    xx = xxhash.xxh64_intdigest
    if len(w) <= SHINGLE:
        return xx(joined, SEED)
    ends = [e + k for k, e in enumerate(accumulate(map(len, w)))]
    starts = [0, *(e + 1 for e in ends[: -SHINGLE])]
    h = np.array([xx(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=True)], dtype=">u8")
    ones = np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (with text) plus the signed long __gw_fp."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, "__gw_fp"])

    return docs.mapInArrow(run, wider(docs, __gw_fp="long"))


def masks(radius: int = RADIUS, bits: int = BITS, parts: int = 1) -> list[int]:
    """One mask for each part of the bits and each nonzero v of {0,1}^(radius//parts + 1)."""
    n = (1 << (radius // parts + 1)) - 1
    m = [1 + (7 * i + 3) % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if i * parts // bits == k and (m[i] & v).bit_count() & 1) for k in range(parts) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(x: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph whose links are pairs within the radius."""
    left, right = [], []
    rest = np.unique(x)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            a = todo.pop()
            near = np.bitwise_count(rest ^ a) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left += [int(a)] * len(found)
                right += found.tolist()
                todo += list(found)
    return left, right


def close(x: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Which cells (runs of x of these sizes) have a pair within the radius."""
    cell = np.repeat(np.arange(len(sizes)), sizes)
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(x)) - 1  # members behind each one in its cell
    found = np.zeros(len(sizes), bool)
    at = np.flatnonzero(after > 0)
    shift = 1
    while len(at):
        found[cell[at[np.bitwise_count(x[at] ^ x[at + shift]) <= radius]]] = True
        shift += 1
        at = at[(after[at] >= shift) & ~found[cell[at]]]
    return found


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, parts: int = 1) -> DataFrame:
    """Edges (a, b), a < b, over the distinct values of fps.__gw_fp, with the same components as all links."""
    spread = F.array(*(F.struct(F.lit(k).alias("t"), F.col("__gw_fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius, parts=parts))))
    rows = fps.select("__gw_fp", F.explode(spread).alias("c")).select("__gw_fp", "c.t", "c.key")
    many = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(many, ["t", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("__gw_fp"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "__gw_fp")
    cell = ["t", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            n = len(cols[0])
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1 if n > 1 else np.array([], int)
            last = int(change[-1]) if len(change) else 0
            held = [c[last:] for c in cols]
            yield edges(cols[4][:last], change[:-1])
        if held is not None:
            yield edges(held[4], np.array([], int))

    def edges(x: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        if len(x):
            x = x.astype(np.int64).view(np.uint64)
            sizes = np.diff(np.r_[0, cuts, len(x)])
            starts = np.cumsum(sizes) - sizes
            for k in np.flatnonzero(close(x, sizes, radius)):
                more = forest(x[starts[k] : starts[k] + sizes[k]], radius)
                left += np.array(more[0], np.uint64).view(np.int64).tolist()
                right += np.array(more[1], np.uint64).view(np.int64).tolist()
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long").distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), ascending, and for each the least node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        i, j = root[i], root[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while np.any((up := root[root]) != root):
            root = up
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node reachable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*np.concatenate(held, axis=1))], names=["node", "root"])

    e = materialize(edges)
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] <= ONE_TASK:
            return e.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")
        if now == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("b"), F.col("m").alias("a"))
        e = materialize(small.filter("a <> b").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """docs' columns but the text, with __gw_fp, __gw_th (hash of the text) and __gw_component."""
    rows = fingerprints(docs.withColumn("__gw_th", F.xxhash64(text_or_empty())))
    narrow = materialize(rows.drop("text"))
    fps = narrow.groupBy("__gw_fp").agg(F.min("doc_id").alias("__gw_id"))
    roots = components(links(fps.select("__gw_fp")))
    known = fps.join(roots.withColumnRenamed("node", "__gw_fp"), "__gw_fp")
    named = known.groupBy("root").agg(F.min("__gw_id").alias("__gw_component"))
    linked = known.join(named, "root").select("__gw_fp", "__gw_component", F.lit(True).alias("__gw_linked"))
    fps = fps.join(linked, "__gw_fp", "left")
    fps = fps.select("__gw_fp", F.when(F.col("__gw_linked"), F.col("__gw_component")).otherwise(F.col("__gw_id")).alias("__gw_component"))
    return narrow.join(fps, "__gw_fp")


def op8_simhash_covering_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("__gw_fp"), 16, "0")).alias("fingerprint"), F.col("__gw_component").alias("component_id"))


def near_features(w: list[bytes]) -> tuple[int, np.ndarray]:
    """Of the words of a text: their unsigned 64-bit SimHash, and the hashes of all its five-word shingles, ascending.

    A distinct word weighs the root of its count, of WEIGHT_COUNT at most. Fewer words make
    one shingle, no words the hash 0.
    """
    if not w:
        return 0, np.zeros(1, np.uint64)
    count = Counter(w)
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in count), np.uint64, len(count))
    weight = np.sqrt(np.minimum(np.fromiter(count.values(), float, len(count)), WEIGHT_COUNT))
    ones = np.zeros(BITS)
    for k in range(0, len(h), 1 << 14):
        ones += weight[k : k + (1 << 14)] @ np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, BITS)
    return int.from_bytes(np.packbits(2 * ones > weight.sum()).tobytes(), "big"), _shingles(w, {x: k for k, x in enumerate(count)}, h)


def _shingles(w: list[bytes], place: dict[bytes, int], h: np.ndarray) -> np.ndarray:
    at = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
    size = min(len(w), NEAR_SHINGLE)
    n = len(w) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = mixed * _ODD + h[at[k : k + n]]
    mixed = (mixed ^ (mixed >> np.uint64(33))) * _ODD
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], similar: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph whose links are sets of that Jaccard similarity or more."""
    left, right = [], []
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    mine = np.split(flat.astype(np.int32), np.cumsum(size)[:-1])
    own = np.zeros(len(values), np.int32)
    waiting = np.ones(len(ids), bool)
    rest = np.arange(len(ids))  # those looked at; thinned out as few of them still wait
    flat, start = np.concatenate(mine), np.cumsum(size) - size
    for first in range(len(ids)):
        if not waiting[first]:
            continue
        waiting[first] = False
        todo = [first]
        while todo:
            waits = waiting[rest]
            n = np.count_nonzero(waits)
            if not n:
                break
            if 2 * n < len(rest):
                rest = rest[waits]
                flat, start = np.concatenate([mine[k] for k in rest]), np.cumsum(size[rest]) - size[rest]
            a = todo.pop()
            own[mine[a]] = 1
            both = np.add.reduceat(own[flat], start)
            own[mine[a]] = 0
            found = rest[(both >= similar * (size[a] + size[rest] - both) - 1e-9) & waiting[rest]]
            waiting[found] = False
            left += [int(ids[a])] * len(found)
            right += ids[found].tolist()
            todo += found.tolist()
    return left, right


def near_links(members: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Edges (a, b), a < b, over members' texts (g, nb blocks of the group, __gw_th, sketch: the whole set) with the same components as all links."""
    rows = members.withColumn("own", F.pmod(F.xxhash64("__gw_th"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "__gw_th", "sketch")

    cell = ["g", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            found = []
            for first, end in zip(cuts, cuts[1:]):
                if first < end:
                    if key != (now := tuple(keys[first].tolist())):
                        found.append(edges(held))
                        held, key = [], now
                    held.append(batch.slice(first, end - first))
            yield from found
        yield edges(held)

    def edges(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sets = {i: np.frombuffer(x, np.uint64) for p in parts for i, x in zip(p.column(3).to_pylist(), p.column(4).to_pylist(), strict=True)}
        a, b = similar_forest(np.array(list(sets), np.int64), list(sets.values()), similar) if len(sets) > 1 else ([], [])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, block: int = NEAR_BLOCK) -> DataFrame:
    """doc_id, __gw_th (hash of the text), and __gw_root, equal for equal texts and for linked near copies."""
    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("__gw_th"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, size = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64)
            for k, t in enumerate(b.column(2).cast(pa.binary())):
                fp[k], found = near_features((t.as_py() or b"").lower().split())
                size[k] = len(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64)), pa.array(size)], names=["doc_id", "__gw_th", "__gw_fp", "size"])

    kind = T.StructType([*d.schema.fields[:2], T.StructField("__gw_fp", T.LongType()), T.StructField("size", T.LongType())])
    narrow = materialize(d.mapInArrow(run, kind))
    texts = materialize(narrow.groupBy("__gw_th").agg(F.min("__gw_fp").alias("__gw_fp"), F.min("doc_id").alias("__gw_id"), F.min("size").alias("size")))
    fps = texts.select("__gw_fp").distinct()
    roots = components(links(fps, NEAR_RADIUS, parts=2 if fps.count() <= HALVES else 1))
    first = F.coalesce("root", "__gw_fp").alias("g")
    near = materialize(compared(d, texts.join(roots.withColumnRenamed("node", "__gw_fp"), "__gw_fp", "left").select("__gw_th", "__gw_id", "size", first), block))
    known = components(near)
    rest = materialize(texts.join(known.withColumnRenamed("node", "__gw_th"), "__gw_th", "left").select("__gw_th", "__gw_id", "size", F.coalesce("root", "__gw_th").alias("root")))
    more = compared(d, candidates(d, rest), block)
    similar = components(near.union(more).distinct())
    return narrow.select("doc_id", "__gw_th").join(similar.withColumnRenamed("node", "__gw_th"), "__gw_th", "left").select("doc_id", "__gw_th", F.coalesce("root", "__gw_th").alias("__gw_root"))


def one_each(d: DataFrame, texts: DataFrame) -> DataFrame:
    """The columns of texts (__gw_th, __gw_id and others) with the text, from the row of d that has that id and hash."""
    own = texts.withColumnRenamed("__gw_th", "__gw_own")
    met = d.join(maybe_broadcast(own), (F.col("__gw_th") == F.col("__gw_own")) & F.col("doc_id").eqNullSafe(F.col("__gw_id")))
    return met.select("__gw_th", *(c for c in texts.columns if c not in ("__gw_th", "__gw_id")), "text")


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text, one text at a time."""
    return (near_features((t.as_py() or b"").lower().split())[1] for t in texts.cast(pa.binary()))


def common_shingles(d: DataFrame, texts: DataFrame) -> np.ndarray:
    """Hashes, ascending, of shingles that COMMON or more of about LATE_TEXTS sampled texts hold.

    That other texts hold them too is thus known; they last in the order of shingles. Any such set is right.
    """
    share = min(1.0, LATE_TEXTS / max(1, texts.count()))
    few = texts.select("__gw_th", "__gw_id").filter(F.pmod(F.xxhash64("__gw_th"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in shingle_sets(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["key"])

    common = one_each(d, few).mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= COMMON).select("key").toArrow()
    return np.sort(common.column("key").to_numpy().astype(np.int64).view(np.uint64))


def is_common(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(s), bool)
    return common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s


def partly_shared(d: DataFrame, shared) -> DataFrame:
    """(__gw_th) of the texts that can have a similar one, by the first shingles of each set in ascending order.

    A set similar to this one shares SIMILAR * n or more of its n shingles. The l-th of the shared ones
    has all other shared ones behind it, so it is among the first n - SIMILAR * n + l: of these
    shingles, l must be in other texts too. One more is taken, as l grows with n: the l of the larger
    of two sets can be one more than that of the smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                new = [k for k, th in enumerate(part.column(1).to_pylist()) if not (th in seen or seen.add(th))]
                part = part.take(pa.array(new, pa.int64()))
                keys, ths, needs = [], [], []
                for th, s in zip(part.column(1).to_pylist(), shingle_sets(part.column(2)), strict=True):
                    l = 1 + len(s) // PREFIX_SHARE
                    head = s[: len(s) - math.ceil(SIMILAR * len(s) - 1e-9) + l + 1]
                    known = is_common(head, shared.value)
                    need = max(0, l - int(known.sum()))
                    head = head[~known].view(np.int64)
                    head = head if need else np.append(head, np.int64(th))  # one row at least
                    keys.append(head)
                    ths.append(np.full(len(head), th, np.int64))
                    needs.append(np.full(len(head), need, np.int32))
                none = np.array([], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *keys])), pa.array(np.concatenate([none, *ths])), pa.array(np.concatenate([none, *needs]).astype(np.int32))], names=["key", "__gw_th", "need"])

    # Equal texts of several tasks repeat their rows, which only lets more texts through.
    own = Window.partitionBy("key")
    rows = d.mapInArrow(run, "key long, __gw_th long, need int").withColumns({"least": F.min("__gw_th").over(own), "most": F.max("__gw_th").over(own)})
    return rows.filter("least < most OR need = 0").groupBy("__gw_th").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("__gw_th")


def prefixes(d: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """(__gw_th, key): the first shingles of each text, in the order by how many of the texts hold them.

    Similar texts share one of them. Texts of whose shingles under SIMILAR are in other texts have none:
    shingles of one text come first in the order, and are left out as no other text can share them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for th, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                known = is_common(s, shared.value)
                key = s.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(known, th, key)), pa.array(key), pa.array(np.full(len(s), th, np.int64)), pa.array(np.full(len(s), len(s), np.int32)), pa.array(known)], names=["at", "key", "__gw_th", "size", "common"])

    rows = one_each(d, texts).mapInArrow(run, "at long, key long, __gw_th long, size int, common boolean").repartition("at").distinct()  # rows may repeat
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("at"))).filter("common OR df > 1")
    mine = Window.partitionBy("__gw_th")
    order = F.when(F.col("common"), F.lit(1 << 62)).otherwise(F.col("df"))
    rows = rows.withColumns({"held": F.count("*").over(mine), "rank": F.row_number().over(mine.orderBy(order, "key"))})
    return rows.filter(F.col("rank") <= F.col("held") - F.ceil(SIMILAR * F.col("size") - 1e-9) + 1).select("__gw_th", "key")


def candidates(d: DataFrame, texts: DataFrame) -> DataFrame:
    """(__gw_th, __gw_id, size, g) of the texts (with root) that may be similar to one of another root: all such pairs have one g.

    In place of the pairs that share a shingle, each root with it is linked to the least such root.
    """
    shared = d.sparkSession.sparkContext.broadcast(common_shingles(d, texts))
    some = materialize(texts.join(partly_shared(d, shared), "__gw_th"))
    held = materialize(prefixes(d, some.select("__gw_th", "__gw_id"), shared).join(some, "__gw_th"))
    keys = held.select("key", "root").distinct()
    least = keys.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a < z")
    edges = keys.join(least, "key").filter("root <> a").select("a", F.col("root").alias("b")).distinct()
    return held.select("__gw_th", "__gw_id", "size", "root").distinct().join(components(edges).select(F.col("node").alias("root"), F.col("root").alias("g")), "root").select("__gw_th", "__gw_id", "size", "g")


def compared(d: DataFrame, grouped: DataFrame, block: int = NEAR_BLOCK) -> DataFrame:
    """near_links within the candidate groups g of the texts (__gw_th, __gw_id, size, g), in blocks of about `block` shingles."""
    many = grouped.groupBy("g").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / block).cast("long").alias("nb")).filter("n > 1")
    asked = materialize(grouped.join(many, "g").select("__gw_th", "__gw_id", "g", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                sets = [s.tobytes() for s in shingle_sets(part.column(3))]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(0), pa.array(sets, pa.binary())], names=["g", "nb", "__gw_th", "sketch"])

    return near_links(one_each(d, asked).mapInArrow(run, "g long, nb long, __gw_th long, sketch binary"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id (null last); of rows that share it, one of the least text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__gw_th").alias("th")))
    keep = near_copies(docs).groupBy("__gw_root").agg(first.alias("k")).select("__gw_root", F.col("k.id").alias("__gw_id"), F.col("k.th").alias("__gw_th"))
    d = docs.withColumn("__gw_h", F.xxhash64(text_or_empty()))
    met = d.join(keep, (F.col("__gw_h") == F.col("__gw_th")) & F.col("doc_id").eqNullSafe(F.col("__gw_id")))
    return met.dropDuplicates(["__gw_root"]).select(*docs.columns)
