"""Named queries over the test tables, with the SQL that should give the same rows.

The test texts hold few sensitive terms, so most queries add a fixed phrase chosen by
doc_id (INJECTED); the expression is plain SQL that Spark and the oracle share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphward.functions import columns as C
from glyphward.functions import rules
from glyphward.operators import corpus, metrics, privacy, routing
from glyphward.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PHRASES = (
    "salary and revenue on Monday", "ssn 123-45-6789 of EMP-00123", "call 212-555-0187 now", "key sk_live_abcdefghij0123456789AB", "card 4111 1111 1111 1111 paid",
    "<PERSON_1> met <PERSON_3> and <EMAIL_ADDRESS_1>", "password = hunter2hunter2", "see api.platform.svc.cluster.local and a zero-day", "mail user7@corp.example and user7@corp.example again",
    "Project Meridian uses voice in its invoice at https://x.internal/a", "host 10.1.2.3 in our cluster",
)
_MOD = 13
INJECTED = "concat(coalesce(text, ''), CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN ' {p}'" for k, p in enumerate(_PHRASES)) + " ELSE '' END)"
TIER = "CASE doc_id % 4 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'COMPLEX' ELSE 'REASONING' END"
LEVEL = "CASE doc_id % 6 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'internal' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'REGULATED' WHEN 4 THEN 'NEVER_EGRESS' ELSE NULL END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.expr(INJECTED).alias("t"), F.expr(TIER).alias("tier"), F.expr(LEVEL).alias("level"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_q(p)})" for p in patterns) + ")"


def _list(parts) -> str:
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


_D = f"WITH d AS (SELECT doc_id, {INJECTED} AS t, {TIER} AS tier, {LEVEL} AS level FROM documents)"
_COUNT = " + ".join(f"CAST(regexp_matches(t, {_q(p)}) AS INTEGER)" for p in rules.SECRET_PATTERNS)
_LABELS = _list(f"CASE WHEN regexp_matches(t, {_q(p)}) THEN '{n}' END" for n, p in rules.PII_PATTERNS)
_BLOCK = "upper(coalesce(level, '')) IN ('CONFIDENTIAL', 'REGULATED', 'NEVER_EGRESS')"
_PATTERN_LIST = _list(f"CASE WHEN regexp_matches(t, {_q('(?i)' + p)}) THEN 'pattern:{n}' END" for ps in rules.level_patterns().values() for n, p in ps)
_KEYWORD_LIST = _list(f"CASE WHEN contains(lower(t), {_q(k)}) THEN {_q('keyword:' + k)} END" for ks in rules.level_keywords().values() for k in ks)


def _fast(t: str = "t") -> str:
    out = "CASE"
    for v in reversed(rules.LEVELS[1:]):
        hits = [f"contains(lower({t}), {_q(k)})" for k in rules.level_keywords()[v]] + [f"regexp_matches({t}, {_q('(?i)' + p)})" for _, p in rules.level_patterns()[v]]
        out += " WHEN " + " OR ".join(hits) + f" THEN '{v}'"
    return out + " END"


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"{_D} SELECT doc_id, array_to_string(list_sort({_PATTERN_LIST}), ',') AS signals FROM d")
def fast_path_patterns(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("low", F.lower("t")).withColumn("hits", C.hits(F.col("t"), F.col("low"), keywords=False))
    return d.select("doc_id", F.array_join(C.signals(F.col("hits")), ",").alias("signals"))


@query(f"{_D} SELECT doc_id, array_to_string(list_sort({_KEYWORD_LIST}), ',') AS signals FROM d")
def fast_path_keywords(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("low", F.lower("t")).withColumn("hits", C.hits(F.col("t"), F.col("low"), patterns=False))
    return d.select("doc_id", F.array_join(C.signals(F.col("hits")), ",").alias("signals"))


@query(f"{_D}, f AS (SELECT doc_id, {_fast()} AS fast_level FROM d) SELECT doc_id, fast_level, CASE WHEN fast_level IS NULL THEN 0.0::DOUBLE ELSE 0.95::DOUBLE END AS fast_confidence FROM f")
def fast_path_level(spark, sf_dir):
    return privacy.fast_path(_docs(spark, sf_dir), "t").select("doc_id", "fast_level", "fast_confidence")


#: Vectors 0 to 99 are the curated anchors, their label gives the level; all others are queries.
_LEVEL_OF = "['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'REGULATED', 'NEVER_EGRESS'][1 + label % 5]"
_SCORES = f"""
WITH a AS (SELECT vec_id, {_LEVEL_OF} AS level, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 100),
q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id >= 100),
c AS (SELECT q.vec_id, q.label, a.level, list_cosine_similarity(q.v, a.v) AS s,
  row_number() OVER (PARTITION BY q.vec_id, a.level ORDER BY list_cosine_similarity(q.v, a.v) DESC) AS k FROM q, a),
m AS (SELECT vec_id, any_value(label) AS label, level, round(avg(s), 4) AS score FROM c WHERE k <= 3 GROUP BY vec_id, level),
p AS (SELECT vec_id, any_value(label) AS label, {", ".join(f"coalesce(max(score) FILTER (WHERE level = '{v}'), 0.0) AS s{k}" for k, v in enumerate(rules.LEVELS))} FROM m GROUP BY vec_id),
e AS (SELECT *, greatest(s0, s1, s2, s3, s4) AS emb_score FROM p),
l AS (SELECT *, CASE WHEN emb_score < 0.35 THEN 'INTERNAL' {" ".join(f"WHEN s{k} = emb_score THEN '{v}'" for k, v in enumerate(rules.LEVELS))} END AS emb_level,
  CASE {" ".join(f"WHEN s{k} = emb_score THEN '{v}'" for k, v in enumerate(rules.LEVELS))} END AS pred FROM e)
"""


def _anchored(spark, sf_dir, rounded=True):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    anchors = e.filter("vec_id < 100").select(C.level_of(F.col("label") % 5).alias("level"), "embedding")
    return corpus.anchor_scores(e.filter("vec_id >= 100"), anchors, rounded=rounded)


@query(_SCORES + f"SELECT vec_id, {', '.join(f's{k} AS {v.lower()}' for k, v in enumerate(rules.LEVELS))} FROM p")
def anchor_topk_scores(spark, sf_dir):
    return _anchored(spark, sf_dir).select("vec_id", *(F.col(v).alias(v.lower()) for v in rules.LEVELS))


@query(_SCORES + "SELECT vec_id, emb_level, emb_score FROM l")
def embedding_level(spark, sf_dir):
    return corpus.embedding_level(_anchored(spark, sf_dir)).select("vec_id", "emb_level", "emb_score")


_RANK = "list_position(['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'REGULATED', 'NEVER_EGRESS'], {})"


@query(
    _SCORES + f", f AS (SELECT doc_id, {_fast('t')} AS fl FROM (SELECT doc_id, {INJECTED} AS t FROM documents)),"
    f" b AS (SELECT doc_id, fl, emb_level AS el, emb_score AS es, {_RANK.format('fl')} AS fr, {_RANK.format('emb_level')} AS er FROM f LEFT JOIN l ON doc_id = vec_id)"
    " SELECT doc_id, CASE WHEN fl IS NOT NULL AND el IS NOT NULL THEN CASE WHEN fr >= er THEN fl ELSE el END ELSE coalesce(fl, el, 'INTERNAL') END AS level,"
    " CASE WHEN fl IS NOT NULL AND el IS NOT NULL THEN CASE WHEN fr > er THEN 0.95::DOUBLE WHEN fr < er THEN es ELSE greatest(0.95::DOUBLE, es) END WHEN fl IS NOT NULL THEN 0.95::DOUBLE WHEN el IS NOT NULL THEN es ELSE 0.5::DOUBLE END AS confidence,"
    " CASE WHEN fl IS NOT NULL AND el IS NOT NULL THEN 'combined' WHEN el IS NOT NULL THEN 'embedding' ELSE 'fast_path' END AS origin FROM b"
)
def classify_combined(spark, sf_dir):
    emb = corpus.embedding_level(_anchored(spark, sf_dir)).select(F.col("vec_id"), "emb_level", "emb_score")
    d = privacy.fast_path(_docs(spark, sf_dir), "t").select("doc_id", "fast_level", "fast_confidence")
    d = d.join(emb, F.col("doc_id") == F.col("vec_id"), "left")
    level, conf, source = privacy.combine(F.col("fast_level"), F.col("fast_confidence"), F.col("emb_level"), F.col("emb_score"))
    return d.select("doc_id", level.alias("level"), conf.alias("confidence"), source.alias("origin"))


def _classified(spark, sf_dir):
    emb = corpus.embedding_level(_anchored(spark, sf_dir)).select(F.col("vec_id"), "emb_level", "emb_score")
    d = privacy.fast_path(_docs(spark, sf_dir), "t").select("doc_id", F.nullif(F.col("tier"), F.lit("MEDIUM")).alias("tier"), "fast_level", "fast_confidence")
    return routing.classify(d.join(emb, F.col("doc_id") == F.col("vec_id"), "left"))


_ORDER_KEYS = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'simple' WHEN '2' THEN 'MEDIUM' WHEN '3' THEN 'COMPLEX' WHEN '4' THEN 'REASONING' ELSE 'OTHER' END AS tier, CASE o_orderkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'REGULATED' WHEN 4 THEN 'NEVER_EGRESS' ELSE 'UNKNOWN' END AS level"
_MATRIX_SQL = ", ".join(f"('{t}', '{v}', '{a}')" for t, v, a in rules.MATRIX)


@query(f"WITH o AS (SELECT o_orderkey, {_ORDER_KEYS} FROM orders), m(mt, mv, a) AS (VALUES {_MATRIX_SQL}) SELECT o_orderkey, coalesce(a, 'LOCAL_ONLY') AS routing_action FROM o LEFT JOIN m ON upper(tier) = mt AND upper(level) = mv")
def routing_matrix(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").selectExpr("o_orderkey", *(f"{x} AS {n}" for x, n in ((_ORDER_KEYS.split(" AS tier, ")[0], "tier"), (_ORDER_KEYS.split(" AS tier, ")[1].removesuffix(" AS level"), "level"))))
    return o.select("o_orderkey", privacy.routing_action(F.col("tier"), F.col("level")).alias("routing_action"))


@query(
    f"WITH m(mt, mv, act) AS (VALUES {_MATRIX_SQL}) SELECT c.doc_id, c.level, c.confidence, c.origin, coalesce(act, 'LOCAL_ONLY') AS routing_action"
    f" FROM ({ORACLE_SQL['classify_combined']}) c JOIN (SELECT doc_id, {TIER} AS tier FROM documents) d ON c.doc_id = d.doc_id LEFT JOIN m ON mt = d.tier AND mv = c.level"
)
def classify_routed(spark, sf_dir):
    """The whole classification with its route; a null tier (here where it was MEDIUM) counts as MEDIUM."""
    return _classified(spark, sf_dir).select("doc_id", "level", "confidence", "origin", "routing_action")


def _span_query(name, pattern):
    def run(spark, sf_dir):
        spans = C.find_all(F.col("t"), pattern, name, 1.0, 0)
        d = _docs(spark, sf_dir).select("doc_id", F.posexplode(spans).alias("ord", "s"))
        return d.select("doc_id", "ord", F.col("s.value").alias("value"))

    run.__name__ = f"span_{name.lower()}"
    sql = f"{_D}, m AS (SELECT doc_id, regexp_extract_all(t, {_q(pattern)}, 0) AS v FROM d) SELECT doc_id, CAST(k AS INTEGER) AS ord, v[k + 1] AS value FROM (SELECT doc_id, v, unnest(range(len(v))) AS k FROM m)"
    query(sql)(run)


for _name, _pattern in rules.PII_PATTERNS:
    _span_query(_name, _pattern)


def _luhn(v: str) -> str:
    digits = f"list_reverse(string_split(regexp_replace({v}, '[^0-9]', '', 'g'), ''))"
    return f"list_sum(list_transform({digits}, lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER) WHEN CAST(x AS INTEGER) > 4 THEN 2 * CAST(x AS INTEGER) - 9 ELSE 2 * CAST(x AS INTEGER) END)) % 10 = 0"


def _plain(pattern: str) -> str:
    """The pattern without what the oracle's expressions lack: look-arounds, which become word boundaries or a check of the value."""
    return pattern.replace(r"(?:^|(?<=\W))", r"\b").replace(r"(?=\W|$)", r"\b").replace(r"(?!000|666|9\d\d)", "").replace("(?!00)", "").replace("(?!0000)", "")


def _find_sql(k: int, etype: str, pattern: str, score: float) -> str:
    """Spans of one recognizer: a match starts after the pieces between the matches before it, and those."""
    rx = _q("(?ims)" + _plain(pattern))
    checks = {"CREDIT_CARD": _luhn("value"), "US_SSN": "NOT regexp_matches(value, '^(000|666|9)|-00-|-0000$')"}
    return (
        f"SELECT doc_id, {k} AS ord, '{etype}' AS etype, {-score}::DOUBLE AS nscore, {int(etype not in rules.PREFERRED)} AS pref, start, start + length(value) AS stop, value"
        f" FROM (SELECT doc_id, v[i] AS value, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS start"
        f" FROM (SELECT doc_id, v, b, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {rx}, 0) AS v, string_split_regex(t, {rx}) AS b FROM d WHERE regexp_matches(t, {rx}))))"
        f" WHERE {checks.get(etype, 'true')}"
    )


#: Tables d (documents), kept (spans after the fold: doc_id, g, start, stop, etype, value), m (mapping) and red (redacted texts).
_SPANS = (
    _D.replace("WITH d", "WITH RECURSIVE d", 1)
    + ", every AS (" + " UNION ALL ".join(_find_sql(k, *r) for k, r in enumerate(rules.recognizers())) + "),"
    " s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, nscore, pref, ord, stop) AS k FROM every),"
    " fold AS (SELECT doc_id, k, CAST(1 AS BIGINT) AS g, start, stop, nscore, pref, etype, value FROM s WHERE k = 1 UNION ALL"
    " SELECT doc_id, k, g + free, CASE WHEN take THEN s_start ELSE start END, CASE WHEN take THEN s_stop ELSE stop END, CASE WHEN take THEN s_nscore ELSE nscore END,"
    " CASE WHEN take THEN s_pref ELSE pref END, CASE WHEN take THEN s_etype ELSE etype END, CASE WHEN take THEN s_value ELSE value END"
    " FROM (SELECT f.doc_id, s.k, f.g, CAST(s.start >= f.stop AS BIGINT) AS free, s.start >= f.stop OR s.nscore < f.nscore OR (s.nscore = f.nscore AND s.pref < f.pref) AS take,"
    " f.start, f.stop, f.nscore, f.pref, f.etype, f.value, s.start AS s_start, s.stop AS s_stop, s.nscore AS s_nscore, s.pref AS s_pref, s.etype AS s_etype, s.value AS s_value"
    " FROM fold f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1)),"
    " kept AS (SELECT doc_id, g, arg_max(start, k) AS start, arg_max(stop, k) AS stop, arg_max(etype, k) AS etype, arg_max(value, k) AS value FROM fold GROUP BY doc_id, g),"
    " firsts AS (SELECT doc_id, value, min(g) AS g, arg_min(etype, g) AS etype FROM kept GROUP BY doc_id, value),"
    " m AS (SELECT doc_id, value, etype, g, '<' || etype || '_' || CAST(row_number() OVER (PARTITION BY doc_id, etype ORDER BY g) AS VARCHAR) || '>' AS placeholder FROM firsts),"
    " o AS (SELECT doc_id, value, placeholder, row_number() OVER (PARTITION BY doc_id ORDER BY length(value) DESC, g) AS k FROM m),"
    " steps AS (SELECT doc_id, t, CAST(0 AS BIGINT) AS k FROM d UNION ALL SELECT r.doc_id, replace(r.t, o.value, o.placeholder), o.k FROM steps r JOIN o ON r.doc_id = o.doc_id AND o.k = r.k + 1),"
    " red AS (SELECT doc_id, arg_max(t, k) AS redacted FROM steps GROUP BY doc_id),"
    " counts AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)"
)


@query(_SPANS + " SELECT doc_id, CAST(g - 1 AS INTEGER) AS ord, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, etype FROM kept")
def dedup_spans(spark, sf_dir):
    d = C.exploded(privacy.redact(_docs(spark, sf_dir), "t"), F.col("spans"), "s", "doc_id", at="ord")
    return d.select("doc_id", "ord", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.etype").alias("etype"))


_MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_MAIL_MAP = f"{_D}, m AS (SELECT doc_id, t, unnest(regexp_extract_all(t, {_q(_MAIL)}, 0)) AS v, unnest(range(len(regexp_extract_all(t, {_q(_MAIL)}, 0)))) AS k FROM d), f AS (SELECT doc_id, v, min(k) AS k FROM m GROUP BY doc_id, v), n AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM f)"


def _mailed(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("spans", C.find_all(F.col("t"), _MAIL, "EMAIL_ADDRESS", 1.0, 0))
    return d.withColumn("mapping", C.mapping(F.col("spans")))


@query(_MAIL_MAP + " SELECT doc_id, v AS value, '<EMAIL_ADDRESS_' || CAST(i AS VARCHAR) || '>' AS placeholder FROM n")
def pseudonym_numbering(spark, sf_dir):
    return C.exploded(_mailed(spark, sf_dir), F.col("mapping"), "m", "doc_id").select("doc_id", "m.value", "m.placeholder")


@query(
    _MAIL_MAP.replace("WITH d", "WITH RECURSIVE d", 1)
    + ", o AS (SELECT doc_id, v, i, row_number() OVER (PARTITION BY doc_id ORDER BY length(v) DESC, i) AS k FROM n), r AS (SELECT doc_id, t, CAST(0 AS BIGINT) AS k FROM d UNION ALL SELECT r.doc_id, replace(r.t, o.v, '<EMAIL_ADDRESS_' || CAST(o.i AS VARCHAR) || '>'), o.k FROM r JOIN o ON r.doc_id = o.doc_id AND o.k = r.k + 1)"
    " SELECT doc_id, md5(arg_max(t, k)) AS redacted_md5, CAST(max(k) AS INTEGER) AS n_placeholders FROM r GROUP BY doc_id"
)
def redact_text(spark, sf_dir):
    return _mailed(spark, sf_dir).select("doc_id", F.md5(C.redact(F.col("t"), F.col("mapping"))).alias("redacted_md5"), F.size("mapping").alias("n_placeholders"))


@query(_MAIL_MAP + " SELECT d.doc_id, md5(coalesce(replace(any_value(d.t), '<EMAIL_ADDRESS_1>', max(n.v) FILTER (WHERE n.i = 1)), any_value(d.t))) AS restored_md5, CAST(count(n.v) AS INTEGER) AS n_restored FROM d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id")
def restore_roundtrip(spark, sf_dir):
    d = _mailed(spark, sf_dir).withColumn("redacted", C.redact(F.col("t"), F.col("mapping")))
    t, n = C.restore(F.col("redacted"), F.col("mapping"))
    return d.select("doc_id", F.md5(t).alias("restored_md5"), n.alias("n_restored"))


@query(_SPANS + " SELECT doc_id, md5(redacted) AS redacted_md5, CAST(coalesce(n, 0) AS INTEGER) AS entity_count, coalesce(n, 0) > 0 AS redaction_applied FROM red LEFT JOIN counts USING (doc_id)")
def redact_all_types(spark, sf_dir):
    return privacy.redact(_docs(spark, sf_dir), "t").select("doc_id", F.md5("redacted").alias("redacted_md5"), "entity_count", "redaction_applied")


_CATEGORY = "CASE etype " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in rules.CHECK_TYPES.items()) + " ELSE 'CONTEXTUAL' END"
_FINDINGS = f"f AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT c, ',' ORDER BY c) AS categories FROM (SELECT doc_id, {_CATEGORY} AS c FROM kept) WHERE c IN ('PII', 'SECRETS', 'INTERNAL_REFS') GROUP BY doc_id)"


@query(f"{_SPANS}, {_FINDINGS} SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_findings, coalesce(n, 0) = 0 AS clean, coalesce(categories, '') AS categories FROM d LEFT JOIN f USING (doc_id)")
def scan_findings(spark, sf_dir):
    d = privacy.scan(privacy.redact(_docs(spark, sf_dir), "t"))
    return d.select("doc_id", F.size("findings").alias("n_findings"), "clean", F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda s: C.check_type(s["etype"])))), ",").alias("categories"))


#: Events as the log of a mapping store: every second one of a user's puts, the others get.
_OPS_SQL = "ops AS (SELECT user_id AS mapping_id, CASE WHEN event_id % 2 = 0 THEN 'put' ELSE 'get' END AS op, event_type AS payload, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\", event_id AS seq FROM events)"


def _ops(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("mapping_id"), F.when(F.col("event_id") % 2 == 0, F.lit("put")).otherwise(F.lit("get")).alias("op"), F.col("event_type").alias("payload"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))


@query(
    f"WITH {_OPS_SQL}, l AS (SELECT *, lag(op) OVER w AS lop, lag(payload) OVER w AS lp, lag(\"at\") OVER w AS la FROM ops WINDOW w AS (PARTITION BY mapping_id ORDER BY \"at\", seq))"
    " SELECT mapping_id, seq, coalesce(lop = 'put' AND \"at\" - la <= 7200, false) AS found, CASE WHEN lop = 'put' AND \"at\" - la <= 7200 THEN lp END AS payload FROM l WHERE op = 'get'"
)
def mapping_ttl(spark, sf_dir):
    """What each get finds; two hours suit the test table's sparse events."""
    return routing.mapping_reads(_ops(spark, sf_dir), 7200)


@query(
    f"WITH {_OPS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY mapping_id ORDER BY \"at\" DESC, seq DESC) AS k FROM ops)"
    " SELECT mapping_id, payload, \"at\" FROM k WHERE k = 1 AND op = 'put' AND (SELECT max(\"at\") FROM ops) - \"at\" <= 86400"
)
def mapping_active(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    last = ops.agg(F.max("at").alias("_now"))
    return routing.active_mappings(ops, F.lit(last.first()[0]), 86400)


_CARD = r"[0-9]{16}"
_DIGIT_SUM = "list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN CAST(v[CAST(i + 1 AS INTEGER)] AS INTEGER) WHEN CAST(v[CAST(i + 1 AS INTEGER)] AS INTEGER) > 4 THEN 2 * CAST(v[CAST(i + 1 AS INTEGER)] AS INTEGER) - 9 ELSE 2 * CAST(v[CAST(i + 1 AS INTEGER)] AS INTEGER) END))"


@query(f"{_D}, m AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_CARD}', 0)) AS v FROM d) SELECT doc_id, v AS value, {_DIGIT_SUM} % 10 = 0 AS valid FROM m")
def luhn_cards(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(_CARD), F.lit(0))).alias("value"))
    return d.select("doc_id", "value", C.luhn_ok(F.col("value")).alias("valid"))


@query(f"{_D} SELECT doc_id, {_BLOCK} AS triggered FROM d")
def rail_sensitivity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.upper(F.coalesce("level", F.lit(""))).isin(*rules.INPUT_BLOCKED).alias("triggered"))


@query(f"{_D} SELECT doc_id, {_COUNT} AS patterns_matched FROM d")
def rail_secrets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.secret_count(F.col("t")).alias("patterns_matched"))


@query(f"{_D} SELECT doc_id, array_to_string({_LABELS}, ',') AS labels FROM d")
def rail_pii(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(C.pii_labels(F.col("t")), ",").alias("labels"))


_CONV = "WITH c AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) || CASE conv_id % 3 WHEN 0 THEN ' password = hunter2hunter2' WHEN 1 THEN ' mail a.b@corp.example' ELSE '' END AS t, CASE conv_id % 5 WHEN 0 THEN 'regulated' WHEN 1 THEN 'PUBLIC' ELSE NULL END AS level FROM conversations GROUP BY conv_id)"


@query(
    f"{_CONV}, g AS (SELECT conv_id, level, {_COUNT} AS ns, {_LABELS} AS pl, {_BLOCK} AS b FROM c)"
    " SELECT conv_id, CASE WHEN b OR ns > 0 THEN 'BLOCK_SAAS' WHEN len(pl) > 0 THEN 'REQUIRE_REDACTION' ELSE 'ALLOW' END AS action,"
    " CASE WHEN ns > 0 THEN 'secrets:' || CAST(ns AS VARCHAR) WHEN b THEN 'level:' || upper(level) WHEN len(pl) > 0 THEN 'pii:' || array_to_string(pl, ',') ELSE '' END AS reason,"
    " concat_ws(',', CASE WHEN b THEN 'sensitivity' END, CASE WHEN ns > 0 THEN 'secret_detection' END, CASE WHEN len(pl) > 0 THEN 'pii_detection' END) AS rails,"
    f" CASE WHEN b OR ns > 0 THEN '{rules.LOCAL_MODEL}' END AS suggested_route FROM g"
)
def guard_input(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["text"]), " ").alias("t"))
    c = c.withColumns({"t": F.concat("t", F.expr("CASE conv_id % 3 WHEN 0 THEN ' password = hunter2hunter2' WHEN 1 THEN ' mail a.b@corp.example' ELSE '' END")), "level": F.expr("CASE conv_id % 5 WHEN 0 THEN 'regulated' WHEN 1 THEN 'PUBLIC' ELSE NULL END")})
    return privacy.guard_input(c, "t").select("conv_id", "action", "reason", F.array_join("rails", ",").alias("rails"), "suggested_route")


_ROUTE = "CASE doc_id % 3 WHEN 0 THEN 'GPT-4' WHEN 1 THEN 'qwen' ELSE NULL END"


_CHUNK_LEVELS = "{list}(level, 'public', CASE WHEN doc_id % 7 < 3 THEN 'Regulated' END, CASE doc_id % 5 WHEN 0 THEN 'NEVER_EGRESS' WHEN 1 THEN 'INTERNAL' ELSE 'confidential' END)"


@query(
    f"{_D}, r AS (SELECT doc_id, t, {_ROUTE} AS route, {_CHUNK_LEVELS.format(list='list_value')} AS s FROM d),"
    " c AS (SELECT doc_id, t, i, (route IS NULL OR regexp_matches(lower(route), '^(gemini|gpt|claude|openai)')) AND upper(coalesce(s[i + 1], 'PUBLIC')) IN ('CONFIDENTIAL', 'REGULATED', 'NEVER_EGRESS') AS bad FROM (SELECT *, unnest(range(4)) AS i FROM r))"
    " SELECT doc_id, CAST(count(*) FILTER (WHERE NOT bad) AS INTEGER) AS n_kept, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE bad), '') AS removed,"
    " md5(coalesce(string_agg(CAST(i AS VARCHAR) || ':' || t, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '')) AS kept_md5 FROM c GROUP BY doc_id"
)
def guard_retrieval(spark, sf_dir):
    levels = F.expr(_CHUNK_LEVELS.format(list="array"))
    chunks = F.transform(levels, lambda s, i: F.struct(F.concat(i.cast("string"), F.lit(":"), "t").alias("text"), s.alias("sensitivity")))
    d = _docs(spark, sf_dir).select("doc_id", chunks.alias("chunks"), F.expr(_ROUTE).alias("route"))
    kept, gone = privacy.filter_chunks(F.col("chunks"), F.col("route"))
    d = d.withColumns({"kept": kept, "gone": gone})
    return d.select("doc_id", F.size("kept").alias("n_kept"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"), F.md5(F.array_join(F.transform("kept", lambda c: c["text"]), "\n")).alias("kept_md5"))


_FOUND = _list(f"CASE WHEN regexp_matches(t, {_q(p)}) THEN 'SECRET:{k}' END" for k, p in enumerate(rules.SECRET_PATTERNS))
_ENTITIES = "CASE doc_id % 4 WHEN 0 THEN ['MERIDIAN', 'user7@corp.example', 'meridian'] WHEN 1 THEN NULL ELSE ['nobody here'] END"
_BACK = f"len(list_filter(coalesce({_ENTITIES}, []), lambda e: contains(lower(t), lower(e))))"


@query(
    f"{_D}, g AS (SELECT doc_id, {_FOUND} AS s, {_LABELS} AS p, CAST({_BACK} AS INTEGER) AS n FROM d)"
    " SELECT doc_id, CASE WHEN len(s) > 0 THEN 'BLOCK' WHEN len(p) > 0 OR n > 0 THEN 'RE_REDACT' ELSE 'ALLOW' END AS action,"
    " array_to_string(s || list_transform(p, lambda x: 'PII:' || x) || CASE WHEN n > 0 THEN ['RECONSTRUCTION:' || CAST(n AS VARCHAR)] ELSE [] END, ',') AS findings, n AS n_reconstructed FROM g"
)
def guard_output(spark, sf_dir):
    entities = F.expr("CASE doc_id % 4 WHEN 0 THEN array('MERIDIAN', 'user7@corp.example', 'meridian') WHEN 1 THEN NULL ELSE array('nobody here') END")
    d = privacy.guard_output(_docs(spark, sf_dir).withColumn("entities", entities), "t")
    return d.select("doc_id", "action", F.array_join("findings", ",").alias("findings"), "n_reconstructed")


_RAIL = f"CASE WHEN upper(coalesce(level, '')) IN ('NEVER_EGRESS', 'REGULATED') THEN 'sensitivity_gate' WHEN {_COUNT} > 0 THEN 'secret_scan' WHEN len({_LABELS}) > 0 THEN 'pii_verification' END"


@query(f"{_D}, g AS (SELECT doc_id, {_RAIL} AS rail FROM d) SELECT doc_id, rail, rail IS NULL AS approved FROM g")
def guard_egress(spark, sf_dir):
    return privacy.guard_egress(_docs(spark, sf_dir), "t").select("doc_id", "rail", "approved")


_GAP = "concat(coalesce(text, ''), ' <A_', CAST(1 + doc_id % 4 AS STRING), '> <A_1><A_1> <B_C_', CAST(1 + doc_id % 3 AS STRING), '> <B_C_1> <A_B_C_', CAST(1 + doc_id % 2 AS STRING), '> <X> <a_7> <P2_5>')"


@query(
    f"WITH p AS (SELECT doc_id, unnest(regexp_extract_all({_GAP.replace('STRING', 'VARCHAR')}, '<[A-Z_]+_\\d+>', 0)) AS v FROM documents),"
    " n AS (SELECT DISTINCT doc_id, regexp_extract(v, '^<(.*)_(\\d+)>$', 1) AS t, CAST(regexp_extract(v, '^<(.*)_(\\d+)>$', 2) AS BIGINT) AS n FROM p),"
    " g AS (SELECT doc_id, t, min(n) = 1 AND max(n) = count(*) AS whole FROM n GROUP BY doc_id, t)"
    " SELECT doc_id, coalesce(bool_and(whole), true) AS ok FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id"
)
def placeholder_gaps(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", C.placeholder_gaps_ok(F.expr(_GAP)).alias("ok"))


@query("SELECT doc_id, doc_id % 3 <> 2 AS ok FROM documents")
def placeholder_gaps_broken(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", C.placeholder_gaps_ok(F.expr("concat('<A_1> <A_', CAST(1 + 2 * (doc_id % 3 % 2) + (doc_id % 3 - doc_id % 3 % 2) * 2 AS STRING), '>', CASE WHEN doc_id % 3 = 1 THEN ' <A_2>' ELSE '' END)")).alias("ok"))


_SIGNAL_SQL = ", ".join("(" + " OR ".join(f"contains(lower(t), {_q(k.lower())})" for k in ks) + f") AS {g}" for g, ks in rules.SIGNALS.items())
_CASES = sorted(rules.DECISIONS, key=lambda x: -x[1])


@query(
    f"{_D}, s AS (SELECT doc_id, tier, upper(level) AS level, {_SIGNAL_SQL} FROM d)"
    f" SELECT doc_id, CASE {' '.join(f'WHEN {r} THEN {_q(n)}' for n, _, r, _ in _CASES)} END AS decision,"
    f" coalesce(CASE {' '.join(f'WHEN {r} THEN {_q(m)}' for _, _, r, m in _CASES)} END, CASE tier {' '.join(f'WHEN {_q(t)} THEN {_q(m)}' for t, m in rules.TIER_MODELS.items())} END) AS model FROM s"
)
def decision_priority(spark, sf_dir):
    return privacy.decide(_docs(spark, sf_dir).withColumn("level", F.upper("level")), "t").select("doc_id", "decision", "model")


@query("WITH l AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) SELECT event_id FROM l WHERE prev IS NULL OR ts >= prev + INTERVAL 30 SECOND")
def request_dedup(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").withColumn("prev", F.lag("ts").over(w)).filter("prev IS NULL OR ts >= prev + INTERVAL 30 SECOND").select("event_id")


@query(
    "WITH l AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, session"
)
def sessionize(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.expr("CASE WHEN prev IS NULL OR ts > prev + INTERVAL 1 HOUR THEN 1 ELSE 0 END")
    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id").withColumn("prev", F.lag("ts").over(w)).withColumn("session", F.sum(fresh).over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts")).cast("timestamp"))
    return _t(spark, sf_dir, "events").groupBy(hour.alias("bucket"), "event_type").agg(F.count("*").alias("n"))


#: The whole text under headings of its own and of ours, with lines that only look like one.
_HEADED = "concat('intro ', CAST(doc_id AS STRING), chr(10), '## First part', chr(10), coalesce(text, ''), '.', chr(10), '### not a boundary', chr(10), '## ', chr(10), '##  Second', chr(10), 'tail', chr(10), '##x', chr(10), '## empty', chr(10), ' ')"
_BLANKS = "'^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'"


@query(
    f"WITH d AS (SELECT doc_id, string_split(regexp_replace(chr(10) || {_HEADED.replace('STRING', 'VARCHAR')}, '\\n##([\\x20\\x09\\x0B-\\x0D][^\\n]+)', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM documents),"
    " e AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS c FROM d),"
    f" b AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'Preamble' ELSE regexp_replace(string_split(c, chr(2))[1], {_BLANKS}) END AS section,"
    f" regexp_replace(CASE WHEN i = 1 THEN c ELSE string_split(c, chr(2))[2] END, {_BLANKS}) AS body FROM e),"
    " k AS (SELECT doc_id, section, body, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx FROM b WHERE body <> '')"
    " SELECT doc_id, CAST(idx AS INTEGER) AS idx, section, md5(body) AS body_md5, md5(section || ':' || CAST(idx AS VARCHAR)) AS chunk_id FROM k"
)
def chunk_headings(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.expr(_HEADED).alias("text"))
    return corpus.chunk_headings(d).select("doc_id", "idx", "section", F.md5("body").alias("body_md5"), "chunk_id")


@query(_SCORES + "SELECT l.vec_id, CASE WHEN list_position(['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'REGULATED', 'NEVER_EGRESS'], l.emb_level) >= 1 + l.label % 5 THEN l.emb_level ELSE " + _LEVEL_OF.replace("label", "l.label") + " END AS level FROM l")
def context_inheritance(spark, sf_dir):
    e = corpus.embedding_level(_anchored(spark, sf_dir))
    return e.select("vec_id", C.level_of(F.greatest(C.rank(F.col("emb_level")), F.col("label") % 5)).alias("level"))


_STRIP = "regexp_replace(text, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"


@query(f"WITH k AS (SELECT doc_id, row_number() OVER (PARTITION BY lower({_STRIP}) ORDER BY doc_id) AS n FROM documents WHERE length({_STRIP}) >= 15) SELECT doc_id FROM k WHERE n = 1")
def dedup_exact(spark, sf_dir):
    return corpus.dedup_exact(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query("WITH k AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(coalesce(text, '') || '0'), doc_id) AS k FROM documents) SELECT doc_id, lang, CASE WHEN k <= greatest(1, floor(n * 0.15)) THEN 'eval' ELSE 'train' END AS split FROM k")
def stratified_split(spark, sf_dir):
    return corpus.stratified_split(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang").select("doc_id", "lang", "split")


@query(
    "WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS k FROM (SELECT DISTINCT label, vec_id FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL)),"
    " every AS (SELECT x.label, y.k * (y.k - 1) // 2 + x.k AS p, least(x.vec_id, y.vec_id) AS a, greatest(x.vec_id, y.vec_id) AS b FROM k x JOIN k y ON x.label = y.label AND x.k < y.k),"
    " m AS (SELECT label, count(*) AS m FROM every GROUP BY label),"
    f" drawn AS (SELECT label, (t * (CASE WHEN m % {corpus.STEPS[0]} <> 0 THEN {corpus.STEPS[0]} ELSE {corpus.STEPS[1]} END % m) + CAST('0x' || left(md5(CAST(label AS VARCHAR)), 8) AS BIGINT)) % m AS p FROM (SELECT label, m, unnest(range(least(500, m))) AS t FROM m))"
    " SELECT label, a, b FROM every JOIN drawn USING (label, p)"
)
def positive_pairs(spark, sf_dir):
    return corpus.positive_pairs(_t(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")


@query(f"SELECT level, strategy, 10 AS n_examples FROM (VALUES {', '.join(f'({_q(v)})' for v in rules.LEVELS)}) l(level), (VALUES {', '.join(f'({_q(s)})' for s in corpus.STRATEGIES)}) s(strategy)")
def prompt_plan(spark, sf_dir):
    return corpus.prompt_plan(spark)


def _judged(spark, sf_dir, threshold=0.0):
    e = corpus.embedding_level(_anchored(spark, sf_dir, rounded=False), threshold)
    return e.select("vec_id", C.level_of(F.col("label") % 5).alias("truth"), F.col("emb_level").alias("pred"))


_TRUTH = _LEVEL_OF
_CONF = _SCORES.replace("round(avg(s), 4)", "avg(s)") + f", j AS (SELECT vec_id, {_TRUTH} AS truth, pred, emb_level FROM l)"
_F1 = "SELECT label, sum(tp) AS tp, sum(sup) AS support, sum(prd) AS predicted FROM (SELECT truth AS label, CAST(truth = {p} AS BIGINT) AS tp, 1 AS sup, 0 AS prd FROM j UNION ALL SELECT {p}, 0, 0, 1 FROM j) GROUP BY label"
_F1S = "SELECT label, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, round(coalesce(tp / nullif(predicted, 0), 0), 4) AS precision, round(coalesce(tp / nullif(support, 0), 0), 4) AS recall, round(coalesce(2 * coalesce(tp / nullif(predicted, 0), 0) * coalesce(tp / nullif(support, 0), 0) / nullif(coalesce(tp / nullif(predicted, 0), 0) + coalesce(tp / nullif(support, 0), 0), 0), 0), 4) AS f1 FROM "


@query(_CONF + " SELECT truth, pred, count(*) AS n FROM j GROUP BY truth, pred")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir), "truth", "pred")


@query(_CONF + f", k1 AS ({_F1.format(p='pred')}) {_F1S} k1")
def per_class_f1(spark, sf_dir):
    return metrics.per_class(metrics.confusion(_judged(spark, sf_dir), "truth", "pred"))


@query(_CONF + f", k1 AS ({_F1.format(p='pred')}), f AS ({_F1S} k1) SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM f")
def macro_weighted_f1(spark, sf_dir):
    return metrics.overall(metrics.per_class(metrics.confusion(_judged(spark, sf_dir), "truth", "pred")))


@query(_CONF + f", k1 AS ({_F1.format(p='pred')}), f AS ({_F1S} k1), k2 AS ({_F1.format(p='emb_level')}), g AS ({_F1S} k2) SELECT coalesce(f.label, g.label) AS label, coalesce(f.f1, 0) AS base_f1, coalesce(g.f1, 0) AS tuned_f1, round(coalesce(g.f1, 0) - coalesce(f.f1, 0), 4) AS delta FROM f FULL JOIN g ON f.label = g.label")
def model_delta(spark, sf_dir):
    one, two = (metrics.per_class(metrics.confusion(_judged(spark, sf_dir, t), "truth", "pred")) for t in (0.0, rules.LEVEL_THRESHOLD))
    return metrics.model_delta(one, two)


@query(_CONF + " SELECT vec_id, truth, pred FROM j WHERE truth <> pred ORDER BY vec_id LIMIT 20")
def topn_errors(spark, sf_dir):
    return _judged(spark, sf_dir).filter("truth <> pred").orderBy("vec_id").limit(20)


@query("SELECT event_type, count(value) AS n, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS stdev, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99, round(min(value), 2) AS min, round(max(value), 2) AS max FROM events GROUP BY event_type")
def latency_stats(spark, sf_dir):
    return metrics.latency_stats(_t(spark, sf_dir, "events"), "value", ("event_type",))


_WANTED = (("EMAIL_ADDRESS", _MAIL), ("PHONE_NUMBER", rules.PII_PATTERNS[2][1]), ("IP_ADDRESS", rules.PII_PATTERNS[4][1]))
_PRF = "round(coalesce({a} / nullif({b}, 0), 0), 4)"


@query(
    _SPANS
    + ", w AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS etype, unnest(regexp_extract_all(t, {_q(p)}, 0)) AS value FROM d" for n, p in _WANTED) + "),"
    " w2 AS (SELECT w.etype, EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = w.doc_id AND (k.etype = w.etype OR lower(k.value) = lower(w.value))) AS hit FROM w),"
    " pos AS (SELECT etype, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fn FROM w2 GROUP BY etype),"
    " neg AS (SELECT etype, count(*) AS fp FROM (SELECT DISTINCT doc_id, etype FROM kept) k WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = k.doc_id AND w.etype = k.etype) GROUP BY etype),"
    " c AS (SELECT coalesce(pos.etype, neg.etype) AS etype, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp FROM pos FULL JOIN neg ON pos.etype = neg.etype),"
    " r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)"
    " SELECT etype, tp, fn, fp, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM r"
)
def entity_prf(spark, sf_dir):
    t = F.col("t")
    want = F.concat(*(F.transform(C.find_all(t, p, n, 1.0, 0), lambda s: F.struct(s["etype"].alias("etype"), s["value"].alias("value"))) for n, p in _WANTED))
    d = privacy.redact(_docs(spark, sf_dir), "t").select(want.alias("want"), F.transform("spans", lambda s: F.struct(s["etype"].alias("etype"), s["value"].alias("value"))).alias("got"))
    return metrics.entity_prf(d, "want", "got")


@query(
    f"{_D}, g AS (SELECT doc_id, {_list(['CASE WHEN doc_id % 13 IN (3, 6) THEN ' + _q('secret') + ' END', 'CASE WHEN doc_id % 13 IN (1, 2, 4, 8, 10) THEN ' + _q('pii') + ' END'])} AS e, {_list([f'CASE WHEN {_COUNT} > 0 THEN ' + _q('secret') + ' END', f'CASE WHEN len({_LABELS}) > 0 THEN ' + _q('pii') + ' END'])} AS f FROM d),"
    " r AS (SELECT x.rail, list_contains(e, x.rail) AS e, list_contains(f, x.rail) AS f FROM g, (VALUES ('secret'), ('pii')) x(rail)),"
    " c AS (SELECT rail, count(*) FILTER (WHERE e AND f) AS tp, count(*) FILTER (WHERE e AND NOT f) AS fn, count(*) FILTER (WHERE f AND NOT e) AS fp, count(*) AS total FROM r GROUP BY rail)"
    " SELECT rail, tp, fn, fp, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS tpr, round(coalesce(fp / nullif(fp + (total - tp - fn), 0), 0), 4) AS fpr FROM c WHERE tp + fn + fp > 0"
)
def rail_rates(spark, sf_dir):
    e = C.array_of(F.when((F.col("doc_id") % _MOD).isin(3, 6), F.lit("secret")), F.when((F.col("doc_id") % _MOD).isin(1, 2, 4, 8, 10), F.lit("pii")))
    f = C.array_of(F.when(C.secret_count(F.col("t")) > 0, F.lit("secret")), F.when(F.size(C.pii_labels(F.col("t"))) > 0, F.lit("pii")))
    return metrics.rail_rates(_docs(spark, sf_dir).select(e.alias("e"), f.alias("f")), "e", "f")


@query(f"{_D} SELECT doc_id, array_to_string(list_sort({_LABELS}), ',') AS types, len({_LABELS}) AS n_types FROM d")
def audit_log(spark, sf_dir):
    labels = C.pii_labels(F.col("t"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(labels), ",").alias("types"), F.size(labels).cast("long").alias("n_types"))


@query("SELECT CASE WHEN quality = 1 THEN 'PUBLIC' WHEN quality = 0 THEN 'INTERNAL' END AS label, count(*) AS n FROM labels WHERE quality IN (0, 1) GROUP BY 1 UNION ALL SELECT x, 0 FROM (VALUES ('CONFIDENTIAL'), ('REGULATED'), ('NEVER_EGRESS')) v(x)")
def seeds_by_label(spark, sf_dir):
    d = _t(spark, sf_dir, "labels").select(F.expr("CASE WHEN quality = 1 THEN 'PUBLIC' WHEN quality = 0 THEN 'INTERNAL' END").alias("label"), F.lit("x").alias("text"))
    return tables.seeds_by_label(d, rules.LEVELS).select("label", "n")


@query(
    f"{_SPANS}, mm(mt, mv, a) AS (VALUES {_MATRIX_SQL}),"
    f" lv AS (SELECT doc_id, coalesce({_fast()}, 'INTERNAL') AS level, {_COUNT} AS n_secret FROM d),"
    f" e AS (SELECT red.doc_id, red.redacted, lv.level, lv.n_secret, {_RAIL.replace('t,', 'redacted,')} AS rail FROM red JOIN lv ON red.doc_id = lv.doc_id),"
    " z AS (SELECT e.*, d.tier, coalesce(a, 'LOCAL_ONLY') AS route, coalesce(n, 0) AS n FROM e JOIN d ON e.doc_id = d.doc_id LEFT JOIN mm ON mt = upper(d.tier) AND mv = e.level LEFT JOIN counts ON counts.doc_id = e.doc_id)"
    " SELECT doc_id, tier, level, route, rail, rail IS NULL AS approved, CAST(n AS INTEGER) AS entity_count, md5(redacted) AS redacted_md5,"
    " CASE WHEN level IN ('CONFIDENTIAL', 'REGULATED', 'NEVER_EGRESS') OR n_secret > 0 OR rail IS NOT NULL THEN 'LOCAL_ONLY' ELSE route END AS final_route FROM z"
)
def flagship(spark, sf_dir):
    """Scan, redact, check for egress and route every document."""
    d = privacy.lifecycle(_docs(spark, sf_dir).withColumnRenamed("t", "text"))
    return d.select("doc_id", "tier", "level", "route", "rail", "approved", "entity_count", F.md5("redacted").alias("redacted_md5"), "final_route")


_SECTIONED = "concat('short', chr(10), '---', chr(10), coalesce(text, ''), chr(10), '---', chr(10), '  a part that is long enough  ', chr(10), '---', chr(10), chr(10), '--- not alone', chr(10))"


@query(
    f"WITH p AS (SELECT doc_id, string_split({_SECTIONED}, chr(10) || '---' || chr(10)) AS p FROM documents), e AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS c FROM p),"
    f" b AS (SELECT doc_id, i, regexp_replace(c, {_BLANKS}) AS body FROM e)"
    " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS idx, md5(body) AS body_md5 FROM b WHERE length(body) >= 20"
)
def chunk_sections(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.expr(_SECTIONED).alias("text"))
    return corpus.chunk_sections(d).select("doc_id", "idx", F.md5("body").alias("body_md5"))


@query(
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM v q, v c WHERE q.vec_id % 50 = 0),"
    " r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, score FROM r WHERE rank <= 5"
)
def nearest_vectors(spark, sf_dir):
    """The stated queries, every vector whose id is divisible by 50, against all vectors."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return corpus.nearest(e.filter("id % 50 = 0"), e)


@query(f"SELECT doc_id, CAST(list_position(['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'REGULATED', 'NEVER_EGRESS'], level) - 1 AS INTEGER) AS label FROM (SELECT doc_id, {LEVEL} AS level FROM documents) WHERE level <> 'internal'")
def label_dataset(spark, sf_dir):
    return corpus.label_dataset(_t(spark, sf_dir, "documents").select("doc_id", "text", F.expr(LEVEL).alias("tier"))).select("doc_id", "label")


@query(f"WITH k AS (SELECT doc_id, doc_id % 3 = 1 AS is_seed, row_number() OVER (PARTITION BY lower({_STRIP}) ORDER BY doc_id % 3 <> 1, doc_id) AS n FROM documents WHERE length({_STRIP}) >= 15) SELECT doc_id, is_seed FROM k WHERE n = 1")
def seed_union(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("key"))
    return corpus.seed_union(d.filter("doc_id % 3 = 1"), d.filter("doc_id % 3 <> 1")).select("doc_id", "is_seed")


_LINES = "list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'))"


@query(
    f"WITH l AS (SELECT doc_id, text, {_LINES} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM l), f AS (SELECT doc_id, x, min(i) AS i FROM e GROUP BY doc_id, x),"
    " j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM f GROUP BY doc_id)"
    " SELECT doc_id, md5(CASE WHEN strlen(text) >= 1000 THEN t ELSE text END) AS compressed_md5 FROM l LEFT JOIN j USING (doc_id)"
)
def compress_context(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(routing.compressed(F.col("text"), 1000)).alias("compressed_md5"))


_MODEL = "CASE conv_id % 4 WHEN 0 THEN 'qwen3.6-35b-a3b' WHEN 1 THEN 'gemini-3-flash-preview' WHEN 2 THEN 'gemini-3.1-pro-preview' END"


@query(
    f"WITH t AS (SELECT conv_id, {_MODEL} AS model, CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS tokens_out FROM conversations GROUP BY conv_id),"
    f" p(m, i, o) AS (VALUES {', '.join(f'({_q(m)}, {a}::DOUBLE, {b}::DOUBLE)' for m, a, b in routing.PRICES)})"
    f" SELECT conv_id, round((tokens_in * i + tokens_out * o) / 1e6::DOUBLE, 9) AS cost, coalesce(model, '{routing.FALLBACK_MODEL}') AS served_by FROM t LEFT JOIN p ON m = model"
)
def model_cost(spark, sf_dir):
    n = lambda own: F.coalesce(F.sum(F.when(own, F.length("text")).otherwise(0)), F.lit(0)).cast("long")
    t = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(n(F.col("role") != "assistant").alias("tokens_in"), n(F.col("role") == "assistant").alias("tokens_out")).withColumn("model", F.expr(_MODEL))
    return routing.cost(t).select("conv_id", F.round("cost", 9).alias("cost"), routing.with_fallback(F.col("model"), F.lit(False)).alias("served_by"))


_IP = "concat(CASE doc_id % 5 WHEN 0 THEN '10.1' WHEN 1 THEN '172.16' WHEN 2 THEN '172.32' WHEN 3 THEN '192.168' ELSE '8.8' END, '.', CAST(doc_id % 256 AS STRING), CASE WHEN doc_id % 11 = 0 THEN '' ELSE '.9' END)"


@query("SELECT doc_id, doc_id % 5 IN (2, 4) AND doc_id % 11 <> 0 AND doc_id % 3 <> 0 AS allowed FROM documents")
def egress_network(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.expr(_IP).alias("ip"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 80 ELSE 443 END").alias("port"))
    return d.select("doc_id", routing.egress_allowed(F.col("ip"), F.col("port")).alias("allowed"))


_RULE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in [("keyword", v) for v, ks in rules.level_keywords().items() for _ in ks] + [("pattern", v) for v, ps in rules.level_patterns().items() for _ in ps] + [("recognizer", r[0]) for r in rules.recognizers()] + [("secret", "") for _ in rules.SECRET_PATTERNS] + [("pii", n) for n, _ in rules.PII_PATTERNS])


@query(f"SELECT kind, x AS of, count(*) AS n FROM (VALUES {_RULE_ROWS}) v(kind, x) GROUP BY kind, x")
def rule_inventory(spark, sf_dir):
    return routing.inventory(spark)


@query(
    f"WITH c AS ({ORACLE_SQL['classify_combined']}) SELECT origin AS source, count(*) AS n, count(*) FILTER (WHERE c.level = upper(d.level)) AS correct,"
    f" round(coalesce(count(*) FILTER (WHERE c.level = upper(d.level)) / nullif(count(*), 0), 0), 4) AS accuracy FROM c JOIN (SELECT doc_id, {LEVEL} AS level FROM documents) d ON c.doc_id = d.doc_id GROUP BY origin"
)
def source_accuracy(spark, sf_dir):
    truth = _docs(spark, sf_dir).select("doc_id", F.upper("level").alias("truth"))
    return metrics.source_accuracy(_classified(spark, sf_dir).join(truth, "doc_id"), "origin", "truth", "level")


def _entities(spark, sf_dir):
    t = F.col("t")
    want = F.concat(*(F.transform(C.find_all(t, p, n, 1.0, 0), lambda s: F.struct(s["etype"].alias("etype"), s["value"].alias("value"))) for n, p in _WANTED))
    return privacy.redact(_docs(spark, sf_dir), "t").select("doc_id", want.alias("want"), F.transform("spans", lambda s: F.struct(s["etype"].alias("etype"), s["value"].alias("value"))).alias("got"))


_WANT_SQL = "w AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS etype, unnest(regexp_extract_all(t, {_q(p)}, 0)) AS value FROM d" for n, p in _WANTED) + ")"


@query(
    f"{_SPANS}, {_WANT_SQL}, h AS (SELECT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = w.doc_id AND k.etype = w.etype AND (contains(k.value, w.value) OR contains(w.value, k.value))) AS hit FROM w)"
    " SELECT count(*) AS expected, count(*) FILTER (WHERE hit) AS found, round(coalesce(count(*) FILTER (WHERE hit) / nullif(count(*), 0), 0), 4) AS recall FROM h"
)
def strict_recall(spark, sf_dir):
    return metrics.strict_recall(_entities(spark, sf_dir), "want", "got")


@query(
    f"{_SPANS}, {_WANT_SQL}, k AS (SELECT DISTINCT value FROM w), f AS (SELECT value, value IN (SELECT value FROM kept) AS hit FROM k)"
    " SELECT count(*) AS known, count(*) FILTER (WHERE hit) AS found, round(coalesce(count(*) FILTER (WHERE hit) / nullif(count(*), 0), 0), 4) AS recall FROM f"
)
def corpus_recall(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return metrics.corpus_recall(C.exploded(e, F.col("want.value"), "value"), C.exploded(e, F.col("got.value"), "value"))


@query(f"{_SPANS} SELECT count(*) AS n, count(*) AS same, CASE WHEN count(*) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fidelity FROM counts JOIN d USING (doc_id) WHERE NOT regexp_matches(t, '<[A-Z_]+_[0-9]+>')")
def roundtrip_fidelity(spark, sf_dir):
    """Texts that hold placeholders of their own are left out, as restoring may fill these too."""
    d = privacy.restore(privacy.redact(_docs(spark, sf_dir), "t")).filter(~F.col("t").rlike(r"<[A-Z_]+_[0-9]+>"))
    return metrics.roundtrip_fidelity(d, "t", "restored", "redaction_applied")


_EXPECTED_RAIL = "CASE doc_id % 13 WHEN 3 THEN 'secret_scan' WHEN 6 THEN 'secret_scan' WHEN 1 THEN 'pii_verification' WHEN 4 THEN 'pii_verification' END"


@query(
    f"{_D}, g AS (SELECT doc_id, {_RAIL} AS rail, {_EXPECTED_RAIL} AS want FROM d)"
    " SELECT want AS rail, count(*) FILTER (WHERE rail = want) AS tp, 2 * count(*) FILTER (WHERE rail IS NULL) AS fn, count(*) FILTER (WHERE rail IS NULL) AS missed,"
    " round(coalesce(count(*) FILTER (WHERE rail = want) / nullif(count(*) FILTER (WHERE rail = want) + 2 * count(*) FILTER (WHERE rail IS NULL), 0), 0), 4) AS detection_rate FROM g WHERE want IS NOT NULL GROUP BY want"
)
def egress_detection(spark, sf_dir):
    d = privacy.guard_egress(_docs(spark, sf_dir), "t").withColumn("expected_rail", F.expr(_EXPECTED_RAIL))
    return metrics.egress_rates(d.withColumn("expected_approved", F.col("expected_rail").isNull()))[1]


@query(
    f"{_D}, g AS (SELECT {_RAIL} IS NULL AS approved, ({_EXPECTED_RAIL}) IS NULL AS e FROM d)"
    " SELECT count(*) AS n, round(coalesce(count(*) FILTER (WHERE e = approved) / nullif(count(*), 0), 0), 4) AS accuracy, count(*) FILTER (WHERE e AND NOT approved) AS false_positives, round(coalesce(count(*) FILTER (WHERE e AND NOT approved) / nullif(count(*), 0), 0), 4) AS fpr FROM g"
)
def egress_accuracy(spark, sf_dir):
    d = privacy.guard_egress(_docs(spark, sf_dir), "t").withColumn("expected_rail", F.expr(_EXPECTED_RAIL))
    return metrics.egress_rates(d.withColumn("expected_approved", F.col("expected_rail").isNull()))[0]


@query("SELECT event_type, count(*) FILTER (WHERE p) AS passed, count(p) AS total, count(*) FILTER (WHERE p) = count(p) AS all_passed FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value >= 0 END AS p FROM events) GROUP BY event_type")
def pass_rollup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE value >= 0 END").alias("p"))
    return metrics.rollup(e, "p", ("event_type",))


@query("SELECT count(value) AS n, round(count(value) / (sum(value) / 1000), 4) AS per_second FROM events")
def throughput(spark, sf_dir):
    return metrics.throughput(_t(spark, sf_dir, "events"), "value")


@query("SELECT doc_id, left(text, 80) AS preview FROM documents")
def text_preview(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", metrics.preview(F.col("text")).alias("preview"))


@query(_CONF + " SELECT 'confusion' AS section, '| ' || truth || ' | ' || pred || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS markdown FROM j GROUP BY truth, pred")
def report_markdown(spark, sf_dir):
    return metrics.report_lines("confusion", metrics.confusion(_judged(spark, sf_dir), "truth", "pred")).select("section", "markdown")
