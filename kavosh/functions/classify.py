"""Column builders that detect technologies, order them, and score contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavosh.functions.dicts import QUALITY, TECHNOLOGIES, TECHNOLOGY_ORDER
from kavosh.functions.text import bound

TECH_TYPE = "array<struct<name:string,confidence:double,evidence:array<string>,evidence_count:int>>"


def detect_technologies(html: Column, url: Column, headers: Column) -> Column:
    """Array of (name, confidence, evidence, evidence_count) of the technologies a page shows.

    All signatures are literal patterns, so each is compiled once and runs inside generated
    code. A signature of weight 0.9 or more is enough; else two hits or two places and a
    confidence of 0.35. Places other than html and header look at the URL.
    """
    where = {"html": F.coalesce(html, F.lit("")), "header": F.lower(F.coalesce(headers, F.lit("")))}
    other = F.coalesce(url, F.lit(""))
    hits = F.array(*[where.get(place, other).rlike(f"(?i){pattern}") for rules in TECHNOLOGIES.values() for pattern, _, place in rules])
    return bound(hits, _weighed)  # every pattern is tried once per page


def _weighed(hits: Column) -> Column:
    found, at = [], 0
    for name, rules in TECHNOLOGIES.items():
        hit = [F.get(hits, F.lit(at + i)) for i in range(len(rules))]
        at += len(rules)
        score = sum((F.when(h, w).otherwise(0.0) for h, (_, w, _) in zip(hit, rules)), F.lit(0.0))
        top = F.greatest(*[F.when(h, w).otherwise(0.0) for h, (_, w, _) in zip(hit, rules)], F.lit(0.0))
        n = sum((h.cast("int") for h in hit), F.lit(0))
        places = sum((F.greatest(*[h.cast("int") for h, (_, _, p) in zip(hit, rules) if p == place], F.lit(0)) for place in dict.fromkeys(p for _, _, p in rules)), F.lit(0))
        most = max(0.55 * sum(w for _, w, _ in rules), 0.01)
        confidence = F.round(F.least(score / F.lit(most), F.lit(1.0)), 2)
        evidence = F.slice(F.array_compact(F.array(*[F.when(h, F.lit(p[:60])) for h, (p, _, _) in zip(hit, rules)])), 1, 6)
        shown = (top >= 0.9) | (((n >= 2) | (places >= 2)) & (confidence >= 0.35))
        found.append(F.when(shown, F.struct(F.lit(name).alias("name"), confidence.alias("confidence"), evidence.alias("evidence"), n.alias("evidence_count"))))
    return F.array_compact(F.array(*found))


def technology_rank(name: Column) -> Column:
    """Place in the order of presentation; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TECHNOLOGY_ORDER]), name), F.lit(0)), F.lit(len(TECHNOLOGY_ORDER) + 1))


def format_technologies(techs: Column) -> Column:
    """Names in the order of presentation, each once, joined by '; '.

    ``techs``: array of (name, confidence, ...); of equal names the highest confidence counts.
    """
    ranked = F.array_sort(F.transform(techs, lambda t: F.struct(technology_rank(t["name"]).alias("r"), (-t["confidence"]).alias("c"), F.lower(t["name"]).alias("l"), t["name"].alias("name"))))
    return F.array_join(F.array_distinct(F.transform(ranked, lambda t: t["name"])), "; ")


def quality_score(phones: Column, emails: Column, socials: Column, technologies: Column, name: Column, domain: Column, city: Column, address: Column) -> Column:
    """How complete a contact is, 0 to 1, to two places; flags come from presence alone."""
    has = {
        "phones": phones, "emails": emails, "socials": socials, "technologies": technologies, "name": F.coalesce(name, F.lit("")) != F.coalesce(domain, F.lit("")),
        "city": F.coalesce(city, F.lit("")) != "", "address": F.coalesce(address, F.lit("")) != "",
    }
    total = sum((F.when(has[k], w).otherwise(0.0) for k, w in QUALITY.items()), F.lit(0.0))
    return F.round(F.least(total, F.lit(1.0)), 2)
