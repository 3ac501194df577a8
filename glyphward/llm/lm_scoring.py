"""Operator 3: cross-entropy difference (Moore and Lewis 2010) with matched n-gram models.

Two bigram models, of the target texts and of the background (all texts), share one
vocabulary (every word of the corpus), order and smoothing. With counts c and tokens N of a
model, and p(w) the share of w among all tokens of the corpus,

    P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU),   P(w) = (c(w) + LAMBDA * p(w)) / (N + LAMBDA),

where the start of a text counts as a word before it. A document's score is its mean loss per
token under the target model less that under the background model; lower is closer to the
target. Every word and every bigram has its own count, however rare: nothing is cut, and the
tables grow with the corpus.

They are never gathered. The loss of w after v is -log(c(v w) + MU P(w)) + log(c(v) + MU); the
first part needs the bigrams that end in w, the second the count of v alone. So each word's rows
(word, word before, document, count) meet once, in a bucket of the word: there c(w), and so P(w),
and all c(v w) are known, and each document gets the first part of its tokens w and the second
part of the tokens after w. What documents get is summed in each bucket, then over the buckets.
Rows of a task are summed by document first and go as packed blocks, one for each bucket.

Words and bigrams that hold more than 1/HOT of a sample's rows (a bounded number) are counted in
a pass of their own and broadcast: hot words are spread over all buckets by the word before,
and hot bigrams need no row at all. The sample only decides where rows go, never a count.

Words and documents (id and text) are known by 64-bit hashes, the words before one word by 48 bits.

Cases: null and empty texts have no token, score 0 and null losses; a target without texts leaves
P(w) = p(w) to the target model; null ids are scored and are no target; repeated target ids count
once; repeated rows get equal scores; texts of any length are read whole; extra columns are carried
along; an empty corpus gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphward.llm.common import maybe_broadcast, ship, table

ship(__name__)

MU, LAMBDA = 100.0, 50.0
#: Texts sampled for hot words and bigrams; a hot one has over 1/HOT of the sample's rows.
SAMPLE_TEXTS, HOT = 4000, 4096
#: Tokens of a task that are summed by document at once, rows of a bucket, and texts whose sums go together.
CHUNK, BUCKET_ROWS, GROUP_TEXTS = 400_000, 1_500_000, 20_000
#: Stand for the start of a text, and for "no word follows", in the place of the word before.
START, LAST = np.uint64(1), np.uint64(2)
_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in w), np.uint64, len(w))


@dataclass
class Hot:
    """Hot words and bigrams (by hash, ascending) with counts of the target and of all texts, and the totals."""

    words: np.ndarray
    pairs: np.ndarray
    word_counts: np.ndarray  # (2, words)
    pair_counts: np.ndarray  # (2, pairs)
    tokens: np.ndarray  # (2,)
    texts: np.ndarray  # (2,)

    def word(self, h: np.ndarray) -> np.ndarray:
        return _place(self.words, h)

    def pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _place(self.pairs, pair_hash(v, w))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v ^ (v >> np.uint64(29))) * _ODD + w
    return (x ^ (x >> np.uint64(32))) * _ODD


def _place(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of h is among known, -1 elsewhere."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From batches of uid, target, text: uids, flags and lengths of non-empty texts, word hashes, and ids into them, token by token."""
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    uids, flags, parts, size = [], [], [], 0

    def done():
        h = word_hashes(list(place))
        place.clear()
        return np.array(uids, np.int64), np.array(flags, bool), np.array([len(x) for x in parts], np.int64), h, np.concatenate(parts)

    for b in batches:
        for uid, flag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            w = words(text.as_py())
            if not w:
                continue
            uids.append(uid)
            flags.append(flag)
            parts.append(np.fromiter(map(place.__getitem__, w), np.int64, len(w)))
            size += len(w)
            if size >= CHUNK:
                yield done()
                uids, flags, parts, size = [], [], [], 0
    if size:
        yield done()


def _before(w: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.cumsum(lengths) - lengths] = start
    return v


def hot(d: DataFrame) -> Hot:
    """d: __gw_uid, __gw_target, text."""
    share = min(1.0, SAMPLE_TEXTS / max(1, d.count()))
    few = d.filter(F.pmod(F.col("__gw_uid"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, _, lengths, h, w in _chunks(batches):
            v = np.append(h, START)[_before(w, lengths, len(h))]
            doc = np.repeat(np.arange(len(uids), dtype=np.uint64), lengths)
            once = np.unique(np.stack([doc, v, h[w]]), axis=1)
            for pair, key in ((False, once[2]), (True, pair_hash(once[1], once[2]))):
                k, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([pair] * len(k), pa.bool_()), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "key", "n"])

    found = few.mapInArrow(candidates, "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
    rows = found.withColumn("total", F.sum(F.when(~F.col("pair"), F.col("n"))).over(Window.partitionBy())).filter(F.col("n") * HOT > F.col("total")).collect()
    chosen = [np.sort(np.array([r.key for r in rows if r.pair == p], np.int64).view(np.uint64)) for p in (False, True)]
    shared = d.sparkSession.sparkContext.broadcast(chosen)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_pairs = shared.value
        out = np.zeros((2, 2 + len(hot_words) + len(hot_pairs)), np.int64)
        for uids, flags, lengths, h, w in _chunks(batches):
            of_word = _place(hot_words, h)
            t = np.repeat(flags, lengths)
            v = _before(w, lengths, len(h))
            p = _place(hot_pairs, pair_hash(np.append(h, START)[v], h[w]))
            for side, own, n_texts in ((0, t, flags.sum()), (1, np.ones(len(w), bool), len(uids))):
                out[side, 0] += own.sum()
                out[side, 1] += n_texts
                for first, at in ((2, of_word[w]), (2 + len(hot_words), p)):
                    n = np.bincount(at[own & (at >= 0)])
                    out[side, first : first + len(n)] += n
        some = np.flatnonzero(out[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[0, some]), pa.array(out[1, some])], names=["k", "c_target", "c_all"])

    c = np.zeros((2, 2 + len(chosen[0]) + len(chosen[1])), np.int64)
    for r in d.mapInArrow(counts, "k long, c_target long, c_all long").groupBy("k").agg(F.sum("c_target"), F.sum("c_all")).collect():
        c[:, r[0]] = r[1:]
    n = 2 + len(chosen[0])
    return Hot(*chosen, c[:, 2:n], c[:, n:], c[:, 0], c[:, 1])


_BLOCK = "bucket int, xs binary, runs binary, low binary, high binary, docs binary, ns binary, uids binary, flags binary, sums binary"
_NAMES = [x.split(" ")[0] for x in _BLOCK.split(", ")]


def _log_first(c_pair: np.ndarray, c_word: np.ndarray, c_all: np.ndarray, tokens: int, tokens_all: int) -> np.ndarray:
    """-log(c(v w) + MU P(w)) of one model."""
    p = c_all / tokens_all
    return -np.log(c_pair + MU * (c_word + LAMBDA * p) / (tokens + LAMBDA))


def _spread(shared, buckets: int):
    """Tokens of each chunk to blocks (_BLOCK): rows for buckets, and what is known of each document already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Hot(**shared.value)
        for uids, flags, lengths, h, w in _chunks(batches):
            n_docs, n_words = len(uids), len(h) + 2
            doc = np.repeat(np.arange(n_docs), lengths)
            last = np.cumsum(lengths) - 1
            key = np.concatenate([(w * n_words + _before(w, lengths, len(h))) * n_docs + doc, (w[last] * n_words + len(h) + 1) * n_docs + np.arange(n_docs)])
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n, key = np.diff(np.r_[first, len(key)]), key[first]
            pair, doc = key // n_docs, (key % n_docs).astype(np.int32)
            x, v = pair // n_words, pair % n_words
            hv = np.concatenate([h, [START, LAST]])
            is_last, of_word = v == len(h) + 1, hot.word(h)[x]
            at = hot.pair(hv[v], h[x])
            known = (at >= 0) & ~is_last
            sums = np.zeros((3, n_docs))  # losses of the target and of all, tokens
            sums[2] = lengths
            for side in (0, 1):
                sums[side] = np.log(hot.texts[side] + MU)
                k = np.flatnonzero(known)
                c, c_all = hot.word_counts[side][of_word[k]], hot.word_counts[1][of_word[k]]
                loss = _log_first(hot.pair_counts[side][at[k]], c, c_all, hot.tokens[side], hot.tokens[1]) + np.log(c + MU)
                sums[side] += np.bincount(doc[k], n[k] * loss, n_docs)
            keep = ~known
            x, v, doc, n, of_word = x[keep], v[keep], doc[keep], n[keep], of_word[keep]
            hx, hv = h[x], hv[v]
            bucket = (np.where(of_word >= 0, pair_hash(hv, hx), hx * _ODD) >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order].astype(np.int64)
            hx, hv, doc, n = hx[order], hv[order], doc[order], n[order].astype(np.uint32)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.array([], np.int64)
            rows = [[int(uids[0]) % buckets, *[b""] * 6, uids.tobytes(), flags.tobytes(), sums.tobytes()]]
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                run = np.flatnonzero(np.r_[True, hx[s + 1 : e] != hx[s : e - 1]])
                mine, local = np.unique(doc[s:e], return_inverse=True)
                narrow = np.uint16 if len(mine) < 1 << 16 else np.uint32
                rows.append([int(bucket[s]), hx[s:e][run].tobytes(), np.diff(np.r_[run, e - s]).astype(np.uint32).tobytes(), hv[s:e].astype(np.uint32).tobytes(), (hv[s:e] >> np.uint64(32)).astype(np.uint16).tobytes(), local.astype(narrow).tobytes(), n[s:e].tobytes(), uids[mine].tobytes(), flags[mine].tobytes(), None])
                if len(rows) >= 256:
                    yield _blocks(rows)
                    rows = []
            if rows:
                yield _blocks(rows)

    return run


def _blocks(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_NAMES)


def _meet(shared, groups: int):
    """Blocks of one bucket to what each of their documents gets: sums of losses, tokens, copies; packed by group of documents."""

    def run(blocks: pa.Table) -> pa.Table:
        hot = Hot(**shared.value)
        each = [np.frombuffer(x.as_py(), np.int64) for x in blocks.column("uids")]
        each = np.unique(np.concatenate(each))
        total, copies = np.zeros((3, len(each))), np.zeros(len(each), np.int32)
        hx, hv, doc, n = [], [], [], []
        target = np.zeros(len(each), bool)
        for k in range(blocks.num_rows):
            _, xs, runs, low, high, docs, ns, uids, flags, sums = (c[k].as_py() for c in blocks.columns)
            at = np.searchsorted(each, np.frombuffer(uids, np.int64)).astype(np.int32)
            target[at] = np.frombuffer(flags, bool)
            if sums is not None:
                np.add.at(total, (slice(None), at), np.frombuffer(sums, float).reshape(3, -1))
                np.add.at(copies, at, 1)
                continue
            hx.append(np.repeat(np.frombuffer(xs, np.uint64), np.frombuffer(runs, np.uint32)))
            hv.append(np.frombuffer(low, np.uint32) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32))
            doc.append(at[np.frombuffer(docs, np.uint16 if len(at) < 1 << 16 else np.uint32)])
            n.append(np.frombuffer(ns, np.uint32))
        del blocks
        if hx:
            hx, hv, doc, n = map(np.concatenate, (hx, hv, doc, n))
            order = np.lexsort((hv, hx))
            hx, hv, doc, n = hx[order], hv[order], doc[order], n[order]
            del order
            new = np.r_[True, hx[1:] != hx[:-1]]
            heads = hx[new]
            of_x = (np.cumsum(new) - 1).astype(np.int32)
            new[1:] |= hv[1:] != hv[:-1]
            of_p = (np.cumsum(new) - 1).astype(np.int32)
            token = hv != LAST
            del hx, hv, new
            at = hot.word(heads)
            known = np.flatnonzero(at >= 0)
            words = []
            for counted in (token & target[doc], token):
                words.append(np.bincount(of_x, np.where(counted, n, 0), len(heads)))
                words[-1][known] = hot.word_counts[len(words) - 1][at[known]]
            for side, counted in enumerate((token & target[doc], token)):
                loss = np.bincount(of_p, np.where(counted, n, 0))[of_p]
                loss = _log_first(loss, words[side][of_x], np.maximum(words[1], 1)[of_x], hot.tokens[side], hot.tokens[1])
                after = np.log(words[side] + MU)[of_x]
                total[side] += np.bincount(doc, np.where(token, n * (loss + after), -after), len(each))
        group = each.view(np.uint64) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        rows = [[int(group[k[0]]), each[k].tobytes(), total[:, k].tobytes(), copies[k].tobytes()] for k in np.split(order, cuts) if len(k)]
        cols = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["group", "uids", "sums", "copies"])

    return run


def _total(parts: pa.Table) -> pa.Table:
    """Packed sums of one group of documents, from all buckets, to one row a document."""
    uids = [np.frombuffer(x.as_py(), np.int64) for x in parts.column("uids")]
    each = np.unique(np.concatenate(uids))
    total, copies = np.zeros((3, len(each))), np.zeros(len(each), np.int64)
    for own, sums, n in zip(uids, parts.column("sums"), parts.column("copies"), strict=True):
        at = np.searchsorted(each, own)
        total[:, at] += np.frombuffer(sums.as_py(), float).reshape(3, -1)  # each document once a block
        copies[at] += np.frombuffer(n.as_py(), np.int32)
    t, g, tokens = total
    return pa.Table.from_arrays([pa.array(each), pa.array(t), pa.array(g), pa.array(tokens.astype(np.int64)), pa.array(copies)], names=["__gw_own", "__gw_t", "__gw_g", "__gw_n", "__gw_copies"])


def cross_entropy(docs: DataFrame, target: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (with doc_id, text) and __gw_tokens, __gw_target_loss, __gw_background_loss (nats per token), __gw_score, their difference.

    target: the doc_ids of the target texts.
    """
    sc = docs.sparkSession.sparkContext
    mine = target.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("__gw_id"), F.lit(True).alias("__gw_target")).distinct()
    uid = F.xxhash64("doc_id", "text")
    d = docs.select("doc_id", uid.alias("__gw_uid"), "text").join(maybe_broadcast(mine), F.col("doc_id") == F.col("__gw_id"), "left")
    d = d.select("__gw_uid", F.coalesce("__gw_target", F.lit(False)).alias("__gw_target"), "text")
    found = hot(d)
    shared = sc.broadcast(vars(found))
    buckets = max(1, -(-int(found.tokens[1]) // bucket_rows))
    blocks = d.mapInArrow(_spread(shared, buckets), _BLOCK)
    groups = max(1, -(-int(found.texts[1]) // GROUP_TEXTS))
    parts = blocks.groupBy("bucket").applyInArrow(_meet(shared, groups), "group int, uids binary, sums binary, copies binary")
    sums = parts.groupBy("group").applyInArrow(_total, "__gw_own long, __gw_t double, __gw_g double, __gw_n long, __gw_copies long")
    met = docs.withColumn("__gw_uid", uid).join(sums, F.col("__gw_uid") == F.col("__gw_own"), "left")
    t, g = F.col("__gw_t") / F.col("__gw_n"), F.col("__gw_g") / F.col("__gw_n")
    tokens = F.coalesce((F.col("__gw_n") / F.col("__gw_copies")).cast("long"), F.lit(0))
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), tokens.alias("__gw_tokens"), t.alias("__gw_target_loss"), g.alias("__gw_background_loss"), F.coalesce(t - g, F.lit(0.0)).alias("__gw_score"))


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by its loss difference between texts labelled good (target) and all texts (background)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    out = cross_entropy(docs, good.select("doc_id"))
    return out.select("doc_id", F.col("__gw_tokens").alias("tokens"), F.col("__gw_target_loss").alias("target_loss"), F.col("__gw_background_loss").alias("background_loss"), F.col("__gw_score").alias("score"))
