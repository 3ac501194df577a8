"""Each operator against a plain version, and on nulls, empties, ties, repeats and odd columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphward.llm import decontamination, lm_scoring, mixing, pii, secrets, sharding, simhash, topk, toxicity, url_filter

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def documents(spark, n=200, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(3, 60))), "en", f"s{rnd.choice('aaab')}", 0, 1, 2) for i in range(n)]
    rows += [(n + i, rows[0][1], "en", "sa", 0, 1, 2) for i in range(n // 2)]  # a hot group of copies
    rows += [rows[1], rows[1], (None, None, None, None, None, None, None), (5000, "", "en", None, 0, 0, 0), (5001, "x " * 20_000, "en", "sa", 0, 0, 0)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_flow_moves_least():
    cost, room = [[0, 1, 5], [1, 0, 1]], [4, 4, 4]
    flow = sharding.min_cost_flow([10, 2], room, cost)
    best = min(
        sum(f * c for f, c in zip((a, b, 10 - a - b, d, e, 2 - d - e), (*cost[0], *cost[1]), strict=True))
        for a in range(5) for b in range(5) for d in range(3) for e in range(3 - d)
        if a + d <= 4 and b + e <= 4 and 12 - a - b - d - e <= 4
    )
    assert [sum(r) for r in flow] == [10, 2] and sum(f * c for r, k in zip(flow, cost, strict=True) for f, c in zip(r, k, strict=True)) == best
    assert sharding.min_cost_flow([], [1], []) == []


def test_sharding(docs, empty):
    placed, plan = sharding.reshard(docs)
    rows = placed.collect()
    assert len(rows) == docs.count() and sum(plan.loads) == plan.total
    for j in range(8):
        assert sorted(r["__gw_slot"] for r in rows if r["__gw_shard"] == j) == list(range(sum(r["__gw_shard"] == j for r in rows)))
    assert all(r["__gw_size"] == len((r.text or "").encode()) + 1 and r["__gw_crc"] == zlib.crc32((r.text or "").encode()) for r in rows)
    small, _ = sharding.reshard(docs.filter("doc_id < 5000"))
    loads = Counter()
    for r in small.collect():
        loads[r["__gw_shard"]] += r["__gw_size"]
    assert max(loads.values()) - min(loads.values()) < 100
    assert sharding.reshard(empty)[0].count() == 0


def test_sharding_spreads_repeated_rows(spark, monkeypatch):
    """Thousands of equal rows (and rows without id) are dealt one by one; slots stay gapless with many parts to a block."""
    rows = [(7, "same text of a group", "s")] * 4000 + [(None, "no id", "s")] * 500 + [(100 + i, "x" * (i % 90), "t") for i in range(300)]
    monkeypatch.setattr(sharding, "PART_ROWS", 1)
    placed, plan = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = placed.collect()
    by = {j: [r for r in found if r["__gw_shard"] == j] for j in range(8)}
    loads = [sum(r["__gw_size"] for r in x) for x in by.values()]
    assert len(found) == len(rows) and sum(loads) == plan.total and max(loads) - min(loads) < 100
    assert all(sorted(r["__gw_slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert plan.moved == sum(r["__gw_size"] for r in found if r["__gw_old"] != r["__gw_shard"])


def test_rewrite_writes_affected_shards_alone(spark, tmp_path):
    rows = [(i, "t" * 20, i % 4, "old") for i in range(400)] + [(1000 + i, "t" * 20, 3, "old") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, at int, shard string")
    _, plan = sharding.rewrite(d, str(tmp_path / "even"), n_new=4, old_shard="at", n_old=4)
    assert plan.affected and plan.moved <= 21 * 40
    out = spark.read.parquet(str(tmp_path / "even"))
    assert {r.shard for r in out.select("shard").distinct().collect()} == set(plan.affected)
    rest = {r[0] for r in rows if r[2] not in plan.affected}
    assert {r.doc_id for r in out.collect()} | rest == {r[0] for r in rows} and out.count() + len(rest) == len(rows)
    _, same = sharding.rewrite(d.filter("doc_id < 400"), str(tmp_path / "same"), n_new=4, old_shard="at", n_old=4)
    assert same.moved == 0 and same.affected == []


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    total = sum(r["__gw_size"] for r in rows)
    by = {}
    for r in rows:
        assert r["__gw_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r["__gw_copies"] <= 3
        by.setdefault(r.source, []).append(r)
    assert abs(sum(v[0]["__gw_target"] for v in by.values()) - total) < 1e-6 or all(v[0]["__gw_target"] == 3 * v[0]["__gw_source_size"] for v in by.values())
    assert sorted((r.doc_id or -1, r["__gw_copies"]) for r in rows) == sorted((r.doc_id or -1, r["__gw_copies"]) for r in mixing.mix(docs.repartition(7)).collect())


def test_water_filling(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "__gw_source string, source_size long")
    got = {r["__gw_source"]: r.target for r in mixing.source_targets(s).collect()}
    # Weights 5, 2, 1, 5: a stops at 30, the rest goes 2 to 1.
    assert got == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(1980 / 3), None: 0.0}


def test_toxicity(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(rnd.choices(WORDS, k=30) + (["moron"] if bad else []))))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score(d, toxicity.train(d, lab)).collect()
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all((r["__gw_score"] >= 0.3) == (r.doc_id % 5 == 0) for r in held)
    none = toxicity.train(d, lab.limit(0))
    assert toxicity.score(d, none).count() == len(rows) + 2


def plain_losses(rows, target, mu=lm_scoring.MU, lam=lm_scoring.LAMBDA):
    """Both losses of each (id, text), counted and summed word by word."""
    models = []
    for own in (lambda i: i in target, lambda i: True):
        words, pairs, starts = Counter(), Counter(), 0
        for i, t in rows:
            w = (t or "").lower().split()
            if own(i) and w:
                words.update(w)
                pairs.update(zip([None, *w], w))
                starts += 1
        models.append((words, pairs, starts))
    every, n_all = models[1][0], sum(models[1][0].values())
    out = []
    for i, t in rows:
        w, losses = (t or "").lower().split(), []
        for words, pairs, starts in models:
            n = sum(words.values())
            p = lambda x: (words[x] + lam * every[x] / n_all) / (n + lam)  # noqa: B023, E731
            losses.append(np.mean([-np.log((pairs[v, x] + mu * p(x)) / ((starts if v is None else words[v]) + mu)) for v, x in zip([None, *w], w)]) if w else None)
        out.append((i, len(w), *losses))
    return out


def test_lm(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(WORDS[:10] if i % 2 else WORDS[8:], k=40))) for i in range(300)]
    rows += [(400 + i, " ".join(["rare", *rnd.choices(WORDS, k=3), "once%d" % i])) for i in range(5)] + [(500, "Hot " * 5000), (501, "alpha"), (None, "alpha beta"), (None, None), (901, ""), rows[4], rows[4], (902, "\t ")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    target = d.filter("doc_id % 2 = 1 AND doc_id < 200").select("doc_id")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(plain_losses(rows, set(range(1, 200, 2))), key=key)
    for hot, bucket_rows in ((lm_scoring.HOT, lm_scoring.BUCKET_ROWS), (20, 300), (1, 97)):
        monkeypatch.setattr(lm_scoring, "HOT", hot)
        monkeypatch.setattr(lm_scoring, "GROUP_TEXTS", bucket_rows)
        found = lm_scoring.cross_entropy(d, target.union(target), bucket_rows).collect()
        got = sorted(((r.doc_id, r["__gw_tokens"], r["__gw_target_loss"], r["__gw_background_loss"]) for r in found), key=key)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for g, w in zip(got, want, strict=True):
            assert (g[2:] == (None, None)) if w[2] is None else g[2:] == pytest.approx(w[2:])
        assert all(r["__gw_score"] == pytest.approx((r["__gw_target_loss"] or 0) - (r["__gw_background_loss"] or 0)) and r.score == "x" for r in found)
    out = {r.doc_id: r["__gw_score"] for r in found}
    assert max(out[i] for i in range(201, 300, 2)) < min(out[i] for i in range(200, 300, 2))
    assert lm_scoring.cross_entropy(d.limit(0), target).count() == 0


def test_lm_scores_stay_with_a_rare_term_whatever_the_background(spark):
    """A term of the target marks its texts as background is added; nothing is cut by the size of the input."""
    rnd = random.Random(16)
    rows = [(i, " ".join([*rnd.choices(WORDS, k=20), *(["rare", "term"] if i < 4 else ["once%d" % i])])) for i in range(60)]
    more = [(1000 + i, " ".join(rnd.choices(WORDS, k=2000))) for i in range(600)]
    for x in (rows, rows + more):
        d = spark.createDataFrame(x, "doc_id long, text string")
        out = {r.doc_id: r["__gw_score"] for r in lm_scoring.cross_entropy(d, d.filter("doc_id < 4").select("doc_id"), 5000).collect()}
        assert max(out[i] for i in range(4)) < min(v for i, v in out.items() if i >= 4)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12)) * rng.lognormal(size=(700, 1))
    x[100:300] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (None, [1.0] * 12), (2150, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(d, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = np.floor(256 * x).astype(int)
    for q in range(0, 700, 50):
        s = v @ v[q]
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(want)]
    assert set(got) == set(range(0, 700, 50))
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_vectors(spark):
    """Finite components of any size keep exact scores; what no long can hold is an error."""
    x = [[200000.0, 1.0], [1.0e6, -3.5], [1.0, 1.0], [3.0e7, 2.0], [3.0e6, 1.0e6], [0.0, 0.0], [-2.0e5, 5.0]]
    rows = [(50 * i, v) for i, v in enumerate(x)] + [(7, [1.0, float("inf")]), (8, [2.0, 0.5])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    v = {i: [int(np.floor(256 * c)) for c in y] for i, y in rows if i != 7}
    want = {q: sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q))[:5] for q in v if q % 50 == 0}
    got = {}
    for r in topk.top_k(d, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert {q: [x[1:] for x in sorted(r)] for q, r in got.items()} == want
    with pytest.raises(Exception, match="2.62"):
        topk.top_k(spark.createDataFrame([(50, [1e30]), (51, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()


def test_urls(spark):
    urls = [None, "nothing", "http://A.Example.ORG/es/x?y", "x://example.org/en/12", "http://fr.com/fr/", "http://b.com/de/1#z", "http://notexample.org", "http://com/de/", "http://evilexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id int, url string, host string")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    out = sorted((r.page_id, r["__gw_host"], r["__gw_path"], r["__gw_rule"], r["__gw_verdict"]) for r in url_filter.judge(pages, listed).select("page_id", "__gw_host", "__gw_path", F.coalesce("__gw_rule", F.lit("-")).alias("__gw_rule"), "__gw_verdict").collect())
    assert [(r[0], r[3], r[4]) for r in out] == [(0, "-", "allow"), (1, "-", "allow"), (2, "example.org/es/", "block"), (3, "example.org/en/1", "block"), (3, "example.org/en/1", "block"), (4, "com/fr/", "allow"), (5, "com/de/", "block"), (6, "-", "allow"), (7, "com/de/", "block"), (8, "org/", "allow")]
    assert {r["__gw_verdict"] for r in url_filter.judge(pages, listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("local,most,blocks", [(10**6, 10**6, 1 << 20), (0, 10**6, 1), (0, 0, 1)])
def test_long_url_lists(spark, monkeypatch, local, most, blocks):
    """Each way of the join, with a Bloom filter so full that it passes false positives, against a plain search."""
    monkeypatch.setattr(url_filter, "LOCAL", local)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
    rnd = random.Random(21)
    host = lambda: rnd.choice(["a", "b", "c"]) + "." + rnd.choice(["d", "e"]) + rnd.choice([".org", ".net"])
    path = lambda: "".join(rnd.choice(["/x", "/y", "/zz"]) for _ in range(rnd.randrange(4)))
    listed = spark.createDataFrame([(f"HTTP://{host().upper()}{path()}?q#f",) for _ in range(80)] + [(None,), ("no url",)], "url string")
    rules = url_filter.canonical(listed, "block").union(url_filter.canonical(listed.limit(5), "allow"))
    known = {}
    for r in rules.collect():
        known[r.host + r.path] = max(r.verdict, known.get(r.host + r.path, ""))
    entries = {(r.host, r.path) for r in rules.collect()}
    pages = [(i, f"http://{rnd.choice(['', 'www.', 'w.w.'])}{host()}{path()}") for i in range(300)]
    for r in url_filter.judge(spark.createDataFrame(pages, "page_id int, url string"), rules).collect():
        h, p = r["__gw_host"], r["__gw_path"]
        fits = [k for k, q in entries if (h == k or h.endswith("." + k)) and p.startswith(q)]
        keys = sorted({k + q for k, q in entries if (h == k or h.endswith("." + k)) and p.startswith(q)}, key=len)
        assert r["__gw_rule"] is None if not fits else len(r["__gw_rule"]) == len(keys[-1])
        assert r["__gw_verdict"] == known.get(r["__gw_rule"], "allow")


def plain_pii(t):
    ok = lambda d: sum([int(c) for c in d[::-1]][::2] + [sum(divmod(2 * int(c), 10)) for c in d[::-1][1::2]]) % 10 == 0
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    o += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and ok(d)]
    o += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(o)


def test_pii(spark):
    rnd = random.Random(5)
    for _ in range(2000):
        t = "".join(rnd.choice("+1 .9-@ab(é🙂) 2.3") for _ in range(rnd.randrange(60)))
        assert pii.base_spans(t) == plain_pii(t)
    rows = [(i, f"x reach me: +1 (212) 555-{1000 + i} now") for i in range(40)] + [(100, "reach me: 555-2001, please"), (101, "reach me: tomorrow"), (200, None), (201, ""), (7, "x reach me: +1 (212) 555-1007 now")]
    out = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans == "phone:10:18" and out[101].spans == "" and out[0].spans == "phone:12:29"
    assert out[200].base_sha256 == hashlib.sha256(b"").hexdigest() == out[100].base_sha256


@pytest.mark.parametrize("most", [pii.MAX_PATTERNS, 1])
def test_pii_patterns_do_not_depend_on_other_seeds(spark, most):
    """Five seeds make a pattern beside very many seed places of another kind, and in several passes too."""
    rows = [(i, f"x reach me: +1 (212) 555-{1000 + i} now") for i in range(5)] + [(100, "reach me: 555-2001, please")]
    rows += [(1000 + i, " ".join(f"send it u{i}x{k}@mail.example.org" for k in range(100))) for i in range(600)] + [(101, "send it 77-abc")]
    out = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string"), most).collect()}
    assert out[100] == "phone:10:18" and out[101] == "email:8:14"


def test_secrets(spark):
    rows = [(1, "é🙂 api_key: Ab9xYz12QrStUv34Wx! ", "a"), (2, "bare Ab9xYz12QrStUv34Wx here", "a"), (3, "token: abc token=abcdef1234567890ABCDEF", "a"), (4, "token=abcdef1234567890ABCDEF", "b"), (5, "abcdef1234567890ABCDEF", "b"), (6, None, None), (7, "AKIA" + "A" * 16 + " " + "0f" * 12, "c"), (7, "AKIA" + "A" * 16 + " " + "0f" * 12, "c")]
    out = [(r.doc_id, r.s) for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()]
    assert sorted(out) == [(1, "assign:3:30"), (2, "assign:5:23"), (3, "assign:11:39"), (4, "assign:0:28"), (5, ""), (6, ""), (7, "access:0:20,hex:21:45"), (7, "access:0:20,hex:21:45")]


def plain_secrets(t):
    """Base spans, and bare tokens that none of them meets."""
    found = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
    found += [(m.start(), k, m.end(), m[0]) for k, p in ((1, r"AKIA[A-Z0-9]{16,}"), (2, r"[0-9a-f]{24,}")) for m in re.finditer(p, t)]
    bare = [m for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", t) if re.search("[0-9]", m[0]) and not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", m[0])]
    return sorted(found), [(m.start(), 0, m.end(), m[0]) for m in bare if not any(s < m.end() and m.start() < e for s, _, e, _ in found)]


def test_secrets_against_a_plain_version(spark):
    rnd = random.Random(22)
    values = ["k%dXy%d" % (i * 7919, i) for i in range(12)] + ["AKIA" + "Q7" * 9, "0a1b2c3d" * 4, "short", "z9"]
    piece = lambda: rnd.choice(["token=", "api-key: ", 'Secret = "', "PASSWD:", "", "", "é "]) + rnd.choice(values) + rnd.choice(['"', "", " ", "\n", "+x", "."])
    rows = [(i, rnd.choice([" ", ", "]).join(piece() for _ in range(rnd.randrange(9))), rnd.choice(["a", "b", "c", None])) for i in range(200)]
    rows += [rows[0], (None, rows[1][1], "a"), (900, None, "a"), (901, "", "b")]
    docs, owners, repositories, assigned = [], {}, Counter(), set()
    for i, t, own in rows:
        base, bare = plain_secrets(t or "")
        docs.append((i, base, bare, own))
        for s, k, e, v in base + bare:
            owners.setdefault(v, set()).add(own)
        assigned |= {v for _, k, _, v in base if k == 0}
    live = lambda v: bool(len(owners[v]) == 1 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= secrets.DISTINCT)
    want = []
    for i, base, bare, own in docs:
        spans = sorted(base + [b for b in bare if live(b[3]) and b[3] in assigned])
        want.append((i, [sum(k == x for _, x, _, _ in base) for k in range(3)], ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in spans), sum(len(owners[b[3]]) > 1 for b in base), sum(live(b[3]) for b in base)))
    out = secrets.secrets(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, spans string"))
    got = [(r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.s, r.a, r.b) for r in out.select("doc_id", "n_assign", "n_access", "n_hex", secrets.joined(F.col("spans")).alias("s"), F.coalesce("n_shared", F.lit(0)).alias("a"), F.coalesce("n_owner_specific", F.lit(0)).alias("b")).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert secrets.secrets(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_secrets_in_a_very_long_text(spark):
    text = " ".join("token=a%dbcdef q%dwErty" % (k, k) for k in range(10_000))
    start = time.time()
    r = secrets.secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert len(r.base) == 10_000 and time.time() - start < 15


def test_masks_cover():
    rng = np.random.default_rng(6)
    for radius, parts, tables in ((3, 1, 15), (7, 2, 30), (7, 1, 255)):
        masks = simhash.masks(radius, parts=parts)
        assert len(masks) == tables
        for _ in range(2000):
            d = sum(1 << int(i) for i in rng.choice(64, rng.integers(1, radius + 1), replace=False))
            assert any(d & m == 0 for m in masks)


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_simhash_components(spark, block):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 30)
    x = np.unique(np.concatenate([base, *(base ^ (1 << rng.integers(0, 62, 30)) ^ (1 << rng.integers(0, 62, 30)) for _ in range(6)), base[0] ^ (1 << np.arange(40))]))
    parent = {int(v): int(v) for v in x}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in x:
        for b in x[np.bitwise_count(x ^ a) <= 3]:
            r, s = find(int(a)), find(int(b))
            parent[max(r, s)] = min(r, s)
    fps = spark.createDataFrame([(int(v),) for v in x], "__gw_fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(fps, block=block)).collect()}
    assert all(got.get(int(v), int(v)) == find(int(v)) for v in x)


@pytest.mark.parametrize("most", [simhash.ONE_TASK, 60, 0])
def test_components_of_chains(spark, most, monkeypatch):
    """Long chains, rings, stars around their largest node and repeated edges; few edges take no round of shuffles, which the driver would have to keep in mind."""
    monkeypatch.setattr(simhash, "ONE_TASK", most)
    rng = np.random.default_rng(8)
    want, edges = {}, []
    for first, kind in ((-500, "chain"), (1000, "ring"), (2000, "star"), (3000, "pair")):
        x = first + rng.permutation(2 if kind == "pair" else 40)
        pairs = [(max(x), v) for v in x if v < max(x)] if kind == "star" else [*zip(x, x[1:]), *([(x[-1], x[0])] if kind == "ring" else [])]
        edges += [(int(min(p)), int(max(p))) for p in pairs] * (2 if kind == "ring" else 1)
        want |= {int(v): first for v in x}
    written = []
    monkeypatch.setattr(simhash, "materialize", lambda df, real=simhash.materialize: written.append(1) or real(df))
    rows = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
    assert len(written) == 1 if most > len(edges) else len(written) > 1
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_documents(docs, empty):
    rows = simhash.classes(docs.select("doc_id", "text")).collect()
    assert len(rows) == docs.count() and simhash.classes(empty.select("doc_id", "text")).count() == 0
    assert {r["__gw_component"] for r in rows if r.doc_id is not None and 200 <= r.doc_id < 300} == {0}
    kept = simhash.dedup_stage(docs.sparkSession, docs, "").collect()
    assert len(kept) == len({r.text or "" for r in docs.collect()}) and kept[0].__fields__ == docs.columns
    assert simhash.dedup_stage(docs.sparkSession, empty, "").count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("blocks", [1, 27])
def test_near_links(spark, blocks):
    rnd = random.Random(11)
    vocabulary = ["w%d" % int(rnd.paretovariate(0.7)) for i in range(3000)]
    texts = []
    for _ in range(12):
        w = rnd.choices(vocabulary, k=150)
        for edits in range(9):
            v = list(w)
            for k in rnd.sample(range(150), edits):
                v[k] = rnd.choice(vocabulary)
            texts.append(" ".join(v))
    sketches = [simhash.near_features(t.encode().split())[1] for t in texts]
    members = spark.createDataFrame([(5, blocks, i, bytearray(s.tobytes())) for i, s in enumerate(sketches)], "g long, nb long, __gw_th long, sketch binary")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                x, y = max(root[i], root[j]), min(root[i], root[j])
                root = [y if r == x else r for r in root]
    got = {r.node: r.root for r in simhash.components(simhash.near_links(members)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == root and len(set(root)) > 12


def test_sketch_of_large_sets():
    rnd = random.Random(12)
    a = ["w%d" % rnd.randrange(5000) for _ in range(9000)]
    b, c = a[:8500] + a[:20], a[:5000] + ["v%d" % k for k in range(4000)]
    s = [simhash.near_features(" ".join(x).encode().split())[1] for x in (a, b, c, a[:30])]
    assert simhash.similar_forest(np.arange(4), s, 0.8) == ([0], [1])


def test_long_texts_are_compared_whole():
    """Pairs of long texts close to 0.8, on either side."""
    for cut, similar in ((398, True), (402, False)):
        for seed in range(20):
            w = [b"w%d_%d" % (seed, k) for k in range(2004)]
            s = [simhash.near_features(x)[1] for x in (w, w[: 2004 - cut])]
            n, m = 2000, 2000 - cut
            assert (m / n >= 0.8) == similar and [len(x) for x in s] == [n, m]
            assert simhash.similar_forest(np.arange(2), s, 0.8) == (([0], [1]) if similar else ([], []))


def test_dedup_stage_takes_near_copies(spark):
    rnd = random.Random(13)
    base = [[rnd.choice(WORDS) + str(rnd.randrange(60)) for _ in range(200)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join([*w[:90], "edited", *w[91:160], "twice", *w[161:]])) for i, w in enumerate(base)]
    rows += [(200 + i, " ".join(w[:120] + base[(i + 1) % 20][:80])) for i, w in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \t"), (None, "alone"), (None, "alone")]
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in simhash.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert kept == [-1, *range(20), *range(200, 220), 300]


def planted_copies(seed=14, n=40):
    """Pairs of texts just over a similarity of 0.8: words added at the end, cut off, scattered edits, a block changed."""
    rnd = random.Random(seed)
    vocabulary = ["w%d" % int(rnd.paretovariate(0.7)) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = rnd.choices(vocabulary, k=rnd.choice((60, 120, 400, 900)))
        k = len(w)
        more, less, block = w + rnd.choices(vocabulary, k=int(0.23 * k)), w[: int(0.82 * k)], w[: k // 2] + rnd.choices(vocabulary, k=k // 11) + w[k // 2 + k // 11 :]
        edits = list(w)
        for at in range(k // 100, k, 50):
            edits[at] = "edited"
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join((more, less, edits, block)[i % 4]))]
    return [x for a, b in zip(rows[::2], rows[1::2]) if jaccard(a[1], b[1]) >= 0.8 for x in (a, b)]


@pytest.mark.parametrize("common", [simhash.COMMON, 1 << 30])
def test_candidates_miss_no_pair(spark, common, monkeypatch):
    """Each similar pair of different roots is in one group; texts that only share a passage are in none."""
    monkeypatch.setattr(simhash, "COMMON", common)
    rows = planted_copies()
    shared = " ".join("c%d" % k for k in range(12))
    rows = [(i, shared + " " + t) for i, t in rows] + [(5000 + i, " ".join([shared, *("u%d_%d" % (i, k) for k in range(60))])) for i in range(30)]
    d = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string").withColumn("__gw_th", F.xxhash64("text"))
    size = lambda t: len(simhash.near_features(t.encode().split())[1])
    texts = spark.createDataFrame([(i, size(t), t) for i, t in rows], "__gw_id long, size long, text string").withColumn("__gw_th", F.xxhash64("text")).select("__gw_th", "__gw_id", "size", F.col("__gw_th").alias("root"))
    got = {r["__gw_id"]: r.g for r in simhash.candidates(d.select("doc_id", "__gw_th", "text"), texts).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jaccard(a[1], b[1]) >= 0.8}
    assert all(got.get(a, "none") == got.get(b) for a, b in want) and len(want) > 30 and len({a // 10 % 4 for a, _ in want}) == 4
    assert max(got) < 5000 and len(set(got.values())) > 20


def test_dedup_stage_takes_appended_and_cut_copies(spark):
    rows = planted_copies(15)
    kept = sorted(r.doc_id for r in simhash.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert kept == [i for i, _ in rows[::2]]


def test_decontamination(spark, docs):
    rnd = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=40)) + ". " + " ".join(rnd.choices(vocabulary, k=8)) + ".") for i in range(30)] + [(99, None), (98, "")]
    filler = lambda k: " ".join(rnd.choices(vocabulary, k=k))
    rows = [(i, filler(rnd.randrange(500)) + " " + items[i][1] + " " + filler(rnd.randrange(500))) for i in range(30)] + [(100 + i, filler(300)) for i in range(50)] + [(200, None), (201, ""), (202, items[3][1].rsplit(". ", 1)[0])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.hits(d, b).collect())
    assert got == [(i, i) for i in range(30)]
    assert decontamination.hits(d, b.limit(0)).count() == 0 and decontamination.hits(d.limit(0), b).count() == 0


def test_items_longer_than_a_stride(spark):
    rnd = random.Random(10)
    long = " ".join(rnd.choices(["w%d" % i for i in range(400)], k=300))
    filler = lambda k: " ".join(rnd.choices(["v%d" % i for i in range(400)], k=k))
    d = spark.createDataFrame([(i, f"{filler(37 * i)} {long} {filler(90)}") for i in range(12)] + [(50, filler(900))], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, filler(12))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.hits(d, items).filter("item_id = 1").collect()) == list(range(12))


def test_scores_do_not_depend_on_groups_of_items(spark, monkeypatch):
    rnd = random.Random(17)
    vocabulary = ["w%d" % int(rnd.paretovariate(0.5)) for _ in range(2000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(12, 40)))) for i in range(40)] + [(99, None)]
    rows = [(i, " ".join([*rnd.choices(vocabulary, k=50), *t.split()[: -1 - i % 2], *rnd.choices(vocabulary, k=50)])) for i, t in items[:40]]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most in (20_000, 7):
        monkeypatch.setattr(decontamination, "MAX_ITEMS", most)
        found.append({(r.doc_id, r.item_id): r.score for r in decontamination.hits(d, b).collect()})
    assert len(found[0]) > 20 and found[1] == pytest.approx(found[0])


def test_wand_loses_nothing():
    rnd = random.Random(9)
    vocabulary = ["w%d" % int(rnd.paretovariate(0.7)) for i in range(2000)]
    ix = decontamination.build([(i, " ".join(rnd.choices(vocabulary, k=20))) for i in range(60)])
    ids, passage, want = [], [], set()
    terms = list(ix.terms)
    for p in range(300):
        own = {ix.terms[t] for t in rnd.sample(terms, 30)} | {ix.terms[w] for q in ix.parts[p % 60] for w in q if rnd.random() < 0.8}
        ids += own
        passage += [p] * len(own)
        score = Counter()
        for t in own:
            for k in range(ix.starts[t], ix.starts[t + 1]):
                score[int(ix.items[k])] += ix.impacts[k]
        want |= {(p, i) for i, s in score.items() if s >= decontamination.THRESHOLD}
    ps, items, _ = decontamination.retrieve(ix, np.array(ids), np.array(passage))
    assert set(zip(ps.tolist(), items.tolist())) == want and want


def test_pipeline(spark, tmp_path):
    d = documents(spark, 120).select("doc_id", "text", "lang", "source", "n_chars")
    item = "one two three four five six seven eight nine ten eleven twelve. thirteen fourteen fifteen sixteen."
    d = d.union(spark.createDataFrame([(9000, "alpha beta " + item + " gamma delta", "en", "sa", 0)], d.schema))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert 9000 not in ids and not set(range(120, 180)) & set(ids) and ids
    for j in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == j) == list(range(sum(r.shard == j for r in out)))
