"""Operator 10: benchmark decontamination by a BM25 index with block-max WAND.

Test items are indexed once: normalised BM25 impacts (a passage that holds all words
of an item scores 1 for it), posting lists, and each list's highest impact in every
block of BLOCK items. Every training passage is a query: twice `stride` words, a new one
every `stride` words, so that any run of up to `stride` words lies in one passage whole;
`stride` is STRIDE, or the length of the longest item if that is more.

Retrieval is exact. Terms are made non-essential from the longest list down, as long as
no item gets more than SLACK from them: alone they cannot lift an item over the
threshold, so (as the non-essential lists of WAND) they open no candidate. The block
maxima of the other terms, plus the most that an item of the block can get from
non-essential ones, bound each (passage, block); only blocks whose bound reaches the
threshold are scored item by item.

Hits are verified on the text around the passage: at least MIN_OVERLAP of the
item's five-word shingles, and as large shares of the words of its question and of
its answer, must be there. The question is all but the last sentence, the answer the
last; an item of one sentence is split after two thirds of its words.

Items are indexed in groups of at most MAX_ITEMS, each a pass over the documents, so
that what is broadcast is bounded.

Cases: null and empty texts hit nothing; items without words are skipped; items under
five words are compared as one shingle; repeated items and documents each give their
rows; empty tables give no rows; extra columns are ignored or carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.llm.common import materialize, ship, table

ship(__name__)

K1, B = 1.2, 0.75
STRIDE = 64
THRESHOLD, SLACK, MIN_OVERLAP = 0.7, 0.45, 0.8
SHINGLE, BLOCK, MAX_ITEMS = 5, 8, 20_000

#: A-Z to a-z, ASCII punctuation to blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    cut = [m.end() for m in re.finditer(r"[.?!:]\s+", text.strip())]
    if cut:
        q, a = words(text.strip()[: cut[-1]].encode()), words(text.strip()[cut[-1] :].encode())
        if q and a:
            return q, a
    w = words(text.encode())
    at = max(1, math.ceil(len(w) * 2 / 3))
    return w[:at], w[at:]


def shingles(w: list[bytes]) -> set[bytes]:
    return {b" ".join(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()


@dataclass
class Index:
    ids: list[int | None]
    parts: list[tuple[list[bytes], list[bytes]]]
    terms: dict[bytes, int] = field(default_factory=dict)
    essential: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    slack: np.ndarray = field(default_factory=lambda: np.zeros(1))  # by block
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # item postings by term
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    impacts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # block maxima by term
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    maxima: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shingles: list[set[bytes]] = field(default_factory=list)


def build(items: list[tuple[int | None, str | None]], whole: tuple[int, float, dict[bytes, int]] | None = None) -> Index:
    """The index of items; whole: count, mean length and document frequencies of all items, where these are a part of them."""
    known = [(i, p) for i, t in items if (p := split_item(t or "")) and p[0]]
    ix = Index([i for i, _ in known], [p for _, p in known])
    bags = [Counter(q + a) for q, a in ix.parts]
    own = Counter(t for b in bags for t in b)
    count, mean, df = whole or (len(bags), sum(map(sum, (b.values() for b in bags))) / max(1, len(bags)), own)
    ix.terms = {t: k for k, t in enumerate(sorted(own))}
    postings: list[list[tuple[int, float]]] = [[] for _ in ix.terms]
    for n, bag in enumerate(bags):
        length = sum(bag.values())
        raw = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in bag.items()}
        whole = sum(raw.values())
        for t, v in raw.items():
            postings[ix.terms[t]].append((n, v / whole))
    best = np.array([max(v for _, v in p) for p in postings])
    ix.essential = np.ones(len(best), bool)
    spent = [0.0] * len(bags)
    for t in sorted(range(len(postings)), key=lambda t: (-len(postings[t]), best[t])):
        if all(spent[n] + v <= SLACK for n, v in postings[t]):
            ix.essential[t] = False
            for n, v in postings[t]:
                spent[n] += v
    ix.slack = np.array([max(spent[k : k + BLOCK]) for k in range(0, len(spent), BLOCK)] or [0.0])
    ix.starts = np.cumsum([0, *map(len, postings)])
    ix.items = np.array([n for p in postings for n, _ in p], np.int64)
    ix.impacts = np.array([v for p in postings for _, v in p])
    tops = [{} for _ in postings]
    for top, p in zip(tops, postings, strict=True):
        for n, v in p:
            top[n // BLOCK] = max(v, top.get(n // BLOCK, 0.0))
    ix.block_starts = np.cumsum([0, *map(len, tops)])
    ix.blocks = np.array([n for t in tops for n in t], np.int64)
    ix.maxima = np.array([v for t in tops for v in t.values()])
    ix.shingles = [shingles(q + a) for q, a in ix.parts]
    return ix


def _expand(term: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term, its postings: positions in the posting arrays, and which term each belongs to."""
    n = starts[term + 1] - starts[term]
    own = np.repeat(np.arange(len(term)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term], n), own


def _distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], int)
    return key[first], np.add.reduceat(value, first) if len(first) else value


def retrieve(ix: Index, ids: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item, score) with score >= THRESHOLD; ids and passage: the index's terms in each passage."""
    n_terms, n_items, n_blocks = len(ix.terms), len(ix.ids), len(ix.slack)
    main = ix.essential[ids]
    pairs = _distinct(passage[main] * n_terms + ids[main])
    at, own = _expand(pairs % n_terms, ix.block_starts)
    key, bound = _sums((pairs // n_terms)[own] * n_blocks + ix.blocks[at], ix.maxima[at])
    open_ = key[bound + ix.slack[key % n_blocks] >= THRESHOLD - 1e-9]
    if not len(open_):
        return (np.array([], np.int64),) * 2 + (np.array([]),)
    asked = np.zeros(int(passage.max()) + 1, bool)
    asked[open_ // n_blocks] = True
    asked = asked[passage]
    pairs = _distinct(passage[asked] * n_terms + ids[asked])
    at, own = _expand(pairs % n_terms, ix.starts)
    p, item = (pairs // n_terms)[own], ix.items[at]
    keep = np.isin(p * n_blocks + item // BLOCK, open_)
    key, score = _sums(p[keep] * n_items + item[keep], ix.impacts[at][keep])
    hit = score >= THRESHOLD - 1e-9
    return key[hit] // n_items, key[hit] % n_items, score[hit]


def verify(ix: Index, item: int, around: list[bytes]) -> tuple[float, float, float]:
    """Shares of the item's shingles, question words and answer words in the words around the passage."""
    want, have, bag = ix.shingles[item], shingles(around), Counter(around)
    q, a = (Counter(x) for x in ix.parts[item])
    share = lambda c: sum(min(n, bag[t]) for t, n in c.items()) / max(1, sum(c.values())) if c else 1.0
    if len(ix.parts[item][0]) + len(ix.parts[item][1]) < SHINGLE:
        k = len(ix.parts[item][0]) + len(ix.parts[item][1])
        have = {b" ".join(around[x : x + k]) for x in range(len(around) - k + 1)}
    return len(want & have) / len(want), share(q), share(a)


#: Words looked up at once, so that memory stays bounded.
CHUNK = 400_000


def search(ix: Index, texts: list[bytes]) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(text, item, score, shingle share, question share, answer share) of the verified hits, the best passage of each."""
    lookup, longest = ix.terms.get, max((len(q) + len(a) for q, a in ix.parts), default=0)
    stride = max(STRIDE, longest)
    k = 0
    while k < len(texts):
        first, found, lengths, kept = k, [], [], []
        while k < len(texts) and sum(lengths) < CHUNK:
            w = words(texts[k])
            found.append(np.fromiter(map(lookup, w, repeat(-1)), np.int32, len(w)))
            lengths.append(len(w))
            kept.append(k)
            k += 1
        ids = np.concatenate(found).astype(np.int64)
        n_pass = np.maximum(1, -(-np.array(lengths) // stride))  # passage p of a text starts at word p * stride
        base = np.cumsum(n_pass) - n_pass
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        in_text = np.repeat(np.arange(len(lengths)), lengths)
        known = ids >= 0
        ids, pos, in_text = ids[known], pos[known], in_text[known]
        p = base[in_text] + pos // stride
        early = pos >= stride  # each word is also in the passage before
        ps, items, scores = retrieve(ix, np.r_[ids, ids[early]], np.r_[p, p[early] - 1])
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        text_of = np.searchsorted(base, ps, side="right") - 1
        split: dict[int, list[bytes]] = {}
        for x, t, item, s in zip(ps.tolist(), text_of.tolist(), items.tolist(), scores.tolist(), strict=True):
            if t not in split:
                split = {t: words(texts[first + t])}
            at = (x - int(base[t])) * stride
            shares = verify(ix, item, split[t][max(0, at - longest) : at + 2 * stride + longest])
            if min(shares) >= MIN_OVERLAP and (s, *shares) > best.get((t, item), (0.0,)):
                best[t, item] = (s, *shares)
        for (t, item), v in sorted(best.items()):
            yield first + t, item, *v


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item, and for each item its length with a null term."""
    for b in batches:
        for text in b.column(0).to_pylist():
            q, a = split_item(text or "")
            if q:
                terms = [None, *set(q + a)]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([len(q) + len(a)] + [0] * (len(terms) - 1), pa.int64())], names=["term", "length"])


def frequencies(items: DataFrame) -> DataFrame:
    """term, df: items with each term; for the null term, all items and their length."""
    terms = items.select("text").mapInArrow(_terms, "term binary, length long")
    return materialize(terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length")))


def part_of(counted: DataFrame, own: DataFrame) -> tuple[int, float, dict[bytes, int]]:
    """Count and mean length of all items, and the document frequencies of own's terms among all."""
    every = counted.filter("term IS NULL").first()
    mine = own.select("text").mapInArrow(_terms, "term binary, length long").select("term").distinct()
    df = {bytes(r.term): r.df for r in counted.join(mine, "term").select("term", "df").collect()}
    return (every.df, every.length / every.df, df) if every else (0, 0.0, df)


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, __gw_th, item_id, score, shingle_overlap, question_overlap, answer_overlap) for every verified hit."""
    n = items.count()
    groups = max(1, -(-n // MAX_ITEMS))
    found, counted = None, frequencies(items) if groups > 1 else None
    for g in range(groups):
        own = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        rows = sorted(((r.item_id, r.text) for r in own.select("item_id", "text").collect()), key=repr)
        ix = build(rows, part_of(counted, own) if counted is not None else None)
        part = _hits_of(docs, ix)
        found = part if found is None else found.unionByName(part)
    return found


def _hits_of(docs: DataFrame, ix: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(ix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**shared.value)
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            rows = list(search(index, texts)) if index.ids else []
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([index.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(2, 6))],
                names=["doc_id", "__gw_th", "item_id", "score", "shingle_overlap", "question_overlap", "answer_overlap"],
            )

    d = docs.select("doc_id", F.xxhash64("text").alias("__gw_th"), "text")
    return d.mapInArrow(run, "doc_id long, __gw_th long, item_id long, score double, shingle_overlap double, question_overlap double, answer_overlap double")


def op10_decontaminate_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    return hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("__gw_th")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a verified hit."""
    ix = table(spark, sf_dir, "benchmark").select("item_id", "text")
    at, kinds = docs.columns.index("text"), docs.schema
    if ix.count() > MAX_ITEMS:
        bad = hits(docs, ix).select(F.col("doc_id").alias("__gw_id"), F.col("__gw_th").alias("__gw_bad")).distinct()
        return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__gw_id")) & (F.xxhash64("text") == F.col("__gw_bad")), "left_anti")
    shared = spark.sparkContext.broadcast(vars(build(sorted(((r.item_id, r.text) for r in ix.collect()), key=repr))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**shared.value)
        for b in batches:
            bad = {r[0] for r in search(index, [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])} if index.ids else set()
            yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_())) if bad else b

    return docs.mapInArrow(run, kinds)
