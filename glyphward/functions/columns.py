"""Column functions: signals, levels, spans with offsets, redaction and restoration.

All are native expressions; offsets are code points, spans half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphward.functions import rules

SPAN = "struct<start:int,nscore:double,pref:int,ord:int,stop:int,etype:string,value:string>"
MAPPING = "struct<value:string,etype:string,placeholder:string>"


def array_of(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def rank(level: Column) -> Column:
    """0 to 4; null for an unknown level."""
    return F.nullif(F.array_position(F.array(*map(F.lit, rules.LEVELS)), F.upper(level)), F.lit(0)).cast("int") - 1


def level_of(rank_: Column) -> Column:
    return F.get(F.array(*map(F.lit, rules.LEVELS)), rank_)


def matches(text: Column, pattern: str, flags: str = "", site: rules.Site = rules.Site(), low: Column | None = None) -> Column:
    """text.rlike(pattern), with the search left out where none of the literals (or no run of digits) that a match needs is there.

    low: the text in lower case, where it is at hand; else it is made anew for each pattern.
    """
    some, digits = rules.needed(pattern, site), rules.needed_digits(pattern)
    found = text.rlike(flags + pattern)
    if some:
        low = F.lower(text) if low is None else low
        return reduce_any([F.contains(low, F.lit(x)) for x in some]) & found
    return text.rlike("[0-9]" * digits) & found if digits else found


def hits(text: Column, low: Column, site: rules.Site = rules.Site(), patterns: bool = True, keywords: bool = True) -> Column:
    """One entry for each pattern and keyword met: the rank of its level (a digit), then its name."""
    found = []
    for level in rules.LEVELS[1:]:
        at = str(rules.LEVELS.index(level))
        if patterns:
            found += [F.when(matches(text, p, "(?i)", site, low), F.lit(f"{at}pattern:{n}")) for n, p in rules.level_patterns(site)[level]]
        if keywords:
            found += [F.when(F.contains(low, F.lit(k)), F.lit(f"{at}keyword:{k}")) for k in rules.level_keywords(site)[level]]
    return array_of(*found)


def signals(found: Column) -> Column:
    return F.array_sort(F.transform(found, lambda h: F.substring(h, 2, 1 << 30)))


def hit_level(found: Column) -> Column:
    """The most restrictive level of the hits, or null."""
    return level_of(F.substring(F.array_max(found), 1, 1).cast("int"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where lambdas inside body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(df: DataFrame, array: Column, name: str, *keep: str | Column, at: str = "_at") -> DataFrame:
    """keep, and for each element of a computed array a row with its place (at, from 0) and itself (name).

    Over a plain explode Spark sets a filter on the size of the array, which searches each text once more,
    and lowers it anew for each pattern. The outer form has no such filter; the row that it adds for an
    empty or null array is dropped by its missing place.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, name)).filter(F.col(at).isNotNull())


#: Numbers summed in one run of starts_of; appending to an array copies it, so runs must be short.
RUN = 128


def starts_of(sizes: Column) -> Column:
    """Of each number in an array of int, the sum of those before it (array of int)."""

    def sums(values):
        nil = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, nil, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def by_run(values):
        runs = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(RUN)), lambda k: F.slice(values, k, F.lit(RUN)))
        firsts = lambda runs: sums(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n)))
        return let(runs, lambda runs: F.flatten(F.zip_with(runs, firsts(runs), lambda r, s: F.transform(sums(r), lambda x: x + s))))

    return let(sizes, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(by_run(v)))


def placed(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, stop, value) of the matches, value being the group; a match starts where the pieces and matches before it end."""

    def spans(both):
        sizes = F.zip_with(both["found"], both["between"], lambda v, g: F.length(g) + F.coalesce(F.length(v), F.lit(0)))
        gaps = F.zip_with(starts_of(sizes), both["between"], lambda s, g: s + F.length(g))
        ends = F.zip_with(both["found"], F.slice(gaps, 1, F.size(both["found"])), lambda v, s: F.struct(s.alias("start"), (s + F.length(v)).alias("stop"), v.alias("value")))
        if not group:
            return ends
        return F.zip_with(ends, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, v: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), v.alias("value")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(both, spans)


def find_all(text: Column, pattern: str, etype: str, score: float, order: int, check=None, site: rules.Site = rules.Site(), low: Column | None = None) -> Column:
    """Spans of all matches."""
    pref = F.lit(int(etype not in rules.PREFERRED))

    def span(m):
        return F.struct(m["start"].alias("start"), F.lit(-score).alias("nscore"), pref.alias("pref"), F.lit(order).alias("ord"), m["stop"].alias("stop"), F.lit(etype).alias("etype"), m["value"].alias("value"))

    spans = F.transform(placed(text, pattern), span).cast(f"array<{SPAN}>")
    if check is not None:
        spans = F.filter(spans, lambda s: check(s["value"]))
    return F.when(matches(text, pattern, site=site, low=low), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def luhn_ok(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def detect(text: Column, site: rules.Site = rules.Site(), types: tuple[str, ...] | None = None, threshold: float = 0.5, low: Column | None = None) -> Column:
    """All spans of the recognizers with a score of threshold or more, sorted by (start, score, preference, order)."""
    parts = [
        find_all(text, "(?ims)" + p, t, s, k, luhn_ok if t == "CREDIT_CARD" else None, site, low)
        for k, (t, p, s) in enumerate(rules.recognizers(site))
        if s >= threshold and (types is None or t in types)
    ]
    return F.array_sort(F.concat(*parts)) if parts else F.array().cast(f"array<{SPAN}>")


def dedup(spans: Column) -> Column:
    """Left fold over sorted spans: an overlap with the last kept one is settled by score, then preference."""

    def step(kept, s):
        last = F.element_at(kept, -1)
        better = (s["nscore"] < last["nscore"]) | ((s["nscore"] == last["nscore"]) & (s["pref"] < last["pref"]))
        free = (F.size(kept) == 0) | (s["start"] >= F.get(kept, F.size(kept) - 1)["stop"])
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when(free, F.array_append(kept, s)).when(better, swapped).otherwise(kept)

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step))


def mapping(kept: Column) -> Column:
    """Placeholders in order of start: one per literal value, numbered from 1 within its type."""

    def step(m, s):
        n = F.size(F.filter(m, lambda e: e["etype"] == s["etype"])) + 1
        ph = F.concat(F.lit("<"), s["etype"], F.lit("_"), n.cast("string"), F.lit(">"))
        return F.when(F.exists(m, lambda e: e["value"] == s["value"]), m).otherwise(F.array_append(m, F.struct(s["value"].alias("value"), s["etype"].alias("etype"), ph.alias("placeholder"))))

    return F.aggregate(kept, F.array().cast(f"array<{MAPPING}>"), step)


def _longest_first(m: Column, what: str) -> Column:
    ranked = F.transform(m, lambda e, i: F.struct((-F.length(e[what])).alias("n"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(ranked), lambda r: r["e"])


def redact(text: Column, m: Column) -> Column:
    """Global literal replacement, longest value first (not by span: it also reaches into other words)."""
    return F.aggregate(_longest_first(m, "value"), text, lambda t, e: F.replace(t, e["value"], e["placeholder"]))


def restore(text: Column, m: Column) -> tuple[Column, Column]:
    """The restored text, and how many distinct placeholders were found on the way."""
    nil = F.struct(text.alias("t"), F.lit(0).alias("n"))

    def step(a, e):
        return F.struct(F.replace(a["t"], e["placeholder"], e["value"]).alias("t"), (a["n"] + F.contains(a["t"], e["placeholder"]).cast("int")).alias("n"))

    out = F.aggregate(_longest_first(m, "placeholder"), nil, step)
    return out["t"], out["n"]


def check_type(etype: Column) -> Column:
    pairs = [F.lit(x) for kv in rules.CHECK_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), etype), F.lit("CONTEXTUAL"))


def secret_count(text: Column, low: Column | None = None) -> Column:
    return sum((matches(text, p, low=low).cast("int") for p in rules.SECRET_PATTERNS), F.lit(0))


def pii_labels(text: Column, low: Column | None = None) -> Column:
    return array_of(*(F.when(matches(text, p, low=low), F.lit(n)) for n, p in rules.PII_PATTERNS))


def is_saas(route: Column) -> Column:
    return F.lower(route).rlike("^(" + "|".join(rules.SAAS_PREFIXES) + ")")


def placeholders_ok(text: Column, strict: bool = False) -> Column:
    """As read, well-formed placeholders are all that is looked at, so the check holds; strict finds unnumbered ones."""
    return ~text.rlike(r"<(?![A-Z0-9_]*_\d+>)[A-Z][A-Z0-9_]*>") if strict else F.lit(True)


def placeholder_gaps_ok(text: Column) -> Column:
    """Whether the numbers of each type's placeholders are exactly 1 to their highest."""
    found = F.regexp_extract_all(text, F.lit(r"<[A-Z_]+_\d+>"), F.lit(0))
    parts = F.array_distinct(F.transform(found, lambda p: F.struct(F.regexp_extract(p, r"^<(.*)_(\d+)>$", 1).alias("t"), F.regexp_extract(p, r"^<(.*)_(\d+)>$", 2).try_cast("int").alias("n"))))

    def whole(t):
        own = F.array_distinct(F.transform(F.filter(parts, lambda p: p["t"] == t), lambda p: p["n"]))
        return (F.array_min(own) == 1) & (F.array_max(own) == F.size(own))

    return F.coalesce(F.forall(F.array_distinct(F.transform(parts, lambda p: p["t"])), whole), F.lit(False))


def reduce_any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
