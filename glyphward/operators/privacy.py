"""DataFrame operators: classification, redaction, guard rails, egress guard, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphward.functions import columns as C
from glyphward.functions import rules


def fast_path(df: DataFrame, text: str = "text", site: rules.Site = rules.Site()) -> DataFrame:
    """Adds fast_level, fast_confidence and signals. Each step refers to the column before it, so that a text is lowered and searched once."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumn("_low", F.lower(t)).withColumn("_hits", C.hits(t, F.col("_low"), site)).drop("_low")
    d = d.withColumn("fast_level", C.hit_level(F.col("_hits"))).withColumn("signals", C.signals(F.col("_hits"))).drop("_hits")
    return d.withColumn("fast_confidence", F.when(F.col("fast_level").isNotNull(), F.lit(rules.FAST_CONFIDENCE)).otherwise(F.lit(0.0)))


def combine(fast: Column, fast_conf: Column, emb: Column, emb_conf: Column) -> tuple[Column, Column, Column]:
    """Level, confidence and source: the higher rank wins with its confidence, equal ranks take the larger."""
    f, e = C.rank(fast), C.rank(emb)
    both = fast.isNotNull() & emb.isNotNull()
    level = F.when(both, F.when(f >= e, fast).otherwise(emb)).otherwise(F.coalesce(fast, emb, F.lit("INTERNAL")))
    conf = F.when(both, F.when(f > e, fast_conf).when(f < e, emb_conf).otherwise(F.greatest(fast_conf, emb_conf)))
    conf = conf.when(fast.isNotNull(), fast_conf).when(emb.isNotNull(), emb_conf).otherwise(F.lit(0.5))
    source = F.when(both, F.lit("combined")).when(emb.isNotNull(), F.lit("embedding")).otherwise(F.lit("fast_path"))
    return level, conf, source


def routing_action(tier: Column, level: Column) -> Column:
    """Matrix lookup without regard to case; LOCAL_ONLY for unknown keys."""
    pairs = [F.lit(x) for t, v, a in rules.MATRIX for x in (f"{t}|{v}", a)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("|", F.upper(tier), F.upper(level))), F.lit("LOCAL_ONLY"))


def redact(df: DataFrame, text: str = "text", site: rules.Site = rules.Site(), types: tuple[str, ...] | None = None) -> DataFrame:
    """Adds spans (deduplicated), mapping, redacted, entity_count and redaction_applied."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Each step refers to the column before it, so that no span is searched for twice.
    out = df.withColumn("_low", F.lower(t)).withColumn("_raw", C.detect(t, site, types, low=F.col("_low"))).drop("_low").withColumn("spans", C.dedup(F.col("_raw"))).drop("_raw").withColumn("mapping", C.mapping(F.col("spans")))
    return out.withColumns({"redacted": C.redact(F.coalesce(F.col(text), F.lit("")), F.col("mapping")), "entity_count": F.size("spans"), "redaction_applied": F.size("spans") > 0})


def restore(df: DataFrame, text: str = "redacted", mapping: str = "mapping") -> DataFrame:
    t, n = C.restore(F.col(text), F.col(mapping))
    return df.withColumns({"restored": t, "placeholders_restored": n})


def scan(df: DataFrame, spans: str = "spans", checks: tuple[str, ...] = rules.DEFAULT_CHECKS) -> DataFrame:
    found = F.filter(spans, lambda s: C.check_type(s["etype"]).isin(*checks))
    return df.withColumn("findings", found).withColumn("clean", F.size("findings") == 0)


def guard_input(df: DataFrame, text: str = "text", level: str = "level") -> DataFrame:
    """Adds allowed, action, reason, rails and suggested_route; the secret rail overrides the sensitivity rail's reason."""
    low = F.col("_low")
    d = df.withColumn("_low", F.lower(text)).withColumns({"_n_secret": C.secret_count(F.col(text), low), "_pii": C.pii_labels(F.col(text), low)}).drop("_low")
    blocked = F.upper(F.coalesce(F.col(level), F.lit(""))).isin(*rules.INPUT_BLOCKED)
    secret, pii = F.col("_n_secret") > 0, F.size("_pii") > 0
    action = F.when(blocked | secret, F.lit("BLOCK_SAAS")).when(pii, F.lit("REQUIRE_REDACTION")).otherwise(F.lit("ALLOW"))
    reason = F.when(secret, F.concat(F.lit("secrets:"), F.col("_n_secret").cast("string"))).when(blocked, F.concat(F.lit("level:"), F.upper(level))).when(pii, F.concat(F.lit("pii:"), F.array_join("_pii", ","))).otherwise(F.lit(""))
    rails = C.array_of(F.when(blocked, F.lit("sensitivity")), F.when(secret, F.lit("secret_detection")), F.when(pii, F.lit("pii_detection")))
    out = d.withColumns({"action": action, "reason": reason, "rails": rails, "suggested_route": F.when(blocked | secret, F.lit(rules.LOCAL_MODEL))})
    return out.withColumn("allowed", F.col("action") == "ALLOW").drop("_n_secret", "_pii")


def filter_chunks(chunks: Column, route: Column) -> tuple[Column, Column]:
    """Chunks (struct with sensitivity) that may go to the route, and the indices removed. No route counts as SaaS."""
    saas = F.when(F.coalesce(route, F.lit("")) == "", F.lit(True)).otherwise(C.is_saas(route))
    bad = lambda c: F.upper(F.coalesce(c["sensitivity"], F.lit("PUBLIC"))).isin(*rules.INPUT_BLOCKED)
    kept = F.when(saas, F.filter(chunks, lambda c: ~bad(c))).otherwise(chunks)
    gone = F.when(saas, F.array_compact(F.transform(chunks, lambda c, i: F.when(bad(c), i)))).otherwise(F.array().cast("array<int>"))
    return kept, gone


def guard_output(df: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Adds action, findings (SECRET patterns, then PII labels) and n_reconstructed."""
    secrets = C.array_of(*(F.when(C.matches(F.col(text), p), F.lit(f"SECRET:{k}")) for k, p in enumerate(rules.SECRET_PATTERNS)))
    back = F.size(F.filter(F.coalesce(F.col(entities), F.array().cast("array<string>")), lambda e: F.contains(F.lower(F.col(text)), F.lower(e))))
    d = df.withColumns({"_s": secrets, "_p": F.transform(C.pii_labels(F.col(text)), lambda x: F.concat(F.lit("PII:"), x)), "n_reconstructed": back})
    action = F.when(F.size("_s") > 0, F.lit("BLOCK")).when((F.size("_p") > 0) | (F.col("n_reconstructed") > 0), F.lit("RE_REDACT")).otherwise(F.lit("ALLOW"))
    rebuilt = F.when(F.col("n_reconstructed") > 0, F.array(F.concat(F.lit("RECONSTRUCTION:"), F.col("n_reconstructed").cast("string")))).otherwise(F.array().cast("array<string>"))
    return d.withColumns({"action": action, "findings": F.concat("_s", "_p", rebuilt)}).drop("_s", "_p")


def guard_egress(df: DataFrame, text: str = "redacted", level: str = "level", strict: bool = False) -> DataFrame:
    """Adds rail (the first that fails, or null) and approved: sensitivity, secrets, personal data, placeholders."""
    t, low = F.col(text), F.col("_low")
    rail = (
        F.when(F.upper(F.coalesce(F.col(level), F.lit(""))).isin(*rules.EGRESS_BLOCKED), F.lit("sensitivity_gate"))
        .when(C.secret_count(t, low) > 0, F.lit("secret_scan"))
        .when(F.size(C.pii_labels(t, low)) > 0, F.lit("pii_verification"))
        .when(~C.placeholders_ok(t, strict), F.lit("placeholder_integrity"))
    )
    return df.withColumn("_low", F.lower(t)).withColumn("rail", rail).drop("_low").withColumn("approved", F.col("rail").isNull())


def decide(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds decision and model: the rule of highest priority that holds, else the tier's default model. Needs level and tier."""
    low = F.lower(F.col(text))
    d = df.withColumns({g: F.coalesce(C.reduce_any([F.contains(low, F.lit(k.lower())) for k in ks]), F.lit(False)) for g, ks in rules.SIGNALS.items()})
    decision, model = None, None
    for name, _, rule, target in sorted(rules.DECISIONS, key=lambda x: -x[1]):
        hit = F.expr(rule)
        decision = F.when(hit, F.lit(name)) if decision is None else decision.when(hit, F.lit(name))
        model = F.when(hit, F.lit(target)) if model is None else model.when(hit, F.lit(target))
    default = F.try_element_at(F.create_map(*(F.lit(x) for kv in rules.TIER_MODELS.items() for x in kv)), F.upper("tier"))
    return d.withColumns({"decision": decision, "model": F.coalesce(model, default)}).drop(*rules.SIGNALS)


def lifecycle(df: DataFrame, text: str = "text", tier: str = "tier", site: rules.Site = rules.Site()) -> DataFrame:
    """Classify, route, guard, redact, check for egress; what a rail blocks ends LOCAL_ONLY. One pass, no shuffle."""
    d = fast_path(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), "_text", site)
    d = d.withColumn("level", F.coalesce("fast_level", F.lit("INTERNAL"))).withColumn("route", routing_action(F.col(tier), F.col("level")))
    d = guard_egress(redact(d, "_text", site), "redacted", "level")
    blocked = F.upper("level").isin(*rules.INPUT_BLOCKED) | (C.secret_count(F.col("_text")) > 0) | ~F.col("approved")
    return d.withColumn("final_route", F.when(blocked, F.lit("LOCAL_ONLY")).otherwise(F.col("route"))).drop("_text")
