"""Ordered rule lists and small grammars as column expressions; the first rule that fires decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
PRICE_LEVELS = {"PRICE_LEVEL_FREE": 1, "PRICE_LEVEL_INEXPENSIVE": 2, "PRICE_LEVEL_MODERATE": 3, "PRICE_LEVEL_EXPENSIVE": 4, "PRICE_LEVEL_VERY_EXPENSIVE": 5}
LEADING = "calle avenida av avda pasaje psje pje callejon bulevar boulevard".split()
TRAILING = "street st avenue ave road rd lane passage alley boulevard blvd".split()
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()


def price_level(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in PRICE_LEVELS.items():
        out = out.when(name == k, v)
    return out


def pair_decision(evidence: Column, activity: Column, left_type: Column, right_type: Column, one_hint: Column, same_kind: Column, qid: Column, many: Column, located: Column, metres: Column, names: Column) -> Column:
    """Of two proposals: SAME, NEW or AMBIGUOUS. A type of the left one that the right one lacks parts them."""
    return (
        F.when(evidence, "SAME").when(activity, "NEW").when(left_type != right_type, "NEW").when(one_hint & ~same_kind, "AMBIGUOUS").when(qid, "SAME").when(many, "AMBIGUOUS")
        .when(located & (metres <= 150), F.when(names, "SAME").otherwise("AMBIGUOUS")).when(located, "NEW").when(names, "AMBIGUOUS").otherwise("NEW")
    )


#: Rules of identity in order: name, condition over the evidence's columns, status (fixed values; conditions in SQL, which
#: both engines read). Absent evidence is the empty text; grounded: the place corresponds by more than the search's scope.
GROUNDED = "correspondence NOT IN ('', 'ADMISSION_SCOPE_ONLY')"
COLLIDES = "(name = 'MULTIPLE' OR alias = 'MULTIPLE')"
IDENTITY_RULES = (
    ("IDENTITY_CONTRADICTION", "contradiction <> ''", "REJECTED"),
    ("STRUCTURED_ROUTE", "route = 'MULTIPLE_CLUSTERS'", "AMBIGUOUS"),
    ("STRUCTURED_ROUTE", "route = 'COMPATIBLE'", "VERIFIED"),
    ("CATALOG_ROUTE_VARIANT", "variant = 'SINGLE'", "VERIFIED"),
    ("CATALOG_ROUTE_VARIANT", "variant = 'MULTIPLE'", "AMBIGUOUS"),
    ("CATALOG_VERIFIED_HINT", "hint = 'SINGLE'", "VERIFIED"),
    ("CATALOG_VERIFIED_HINT", "hint = 'MULTIPLE'", "AMBIGUOUS"),
    ("CONTEXTUAL_CORRESPONDENCE", "contextual = 'DISTINGUISHED'", "VERIFIED"),
    ("CONTEXTUAL_CORRESPONDENCE", "contextual = 'AMBIGUOUS'", "AMBIGUOUS"),
    ("SOURCE_DECLARED_IDENTITY", "declared <> ''", "VERIFIED"),
    ("ADDRESS_MATCH", "address <> ''", "VERIFIED"),
    ("MATERIAL_COMPETITOR_KNOWN", "competitors = 'MATERIAL_COMPETITOR_KNOWN'", "AMBIGUOUS"),
    ("QID_LINK", "wikidata_source = 'LINK' AND wikidata_role = 'CORROBORATING'", "VERIFIED"),
    ("GROUNDED_CONVERGENCE", f"{GROUNDED} AND convergence = 'CORROBORATING' AND competitors = 'NO_MATERIAL_COMPETITOR'", "VERIFIED"),
    ("GROUNDED_UNIQUE_EXACT_NAME", f"{GROUNDED} AND name = 'SINGLE'", "VERIFIED"),
    ("GROUNDED_UNIQUE_ALIAS", f"{GROUNDED} AND alias = 'SINGLE' AND alias_role = 'CORROBORATING'", "VERIFIED"),
    ("WIKIDATA_CORROBORATION", f"wikidata_source <> '' AND wikidata_role = 'CORROBORATING' AND (NOT {COLLIDES} OR wikidata_source <> 'NEARBY') AND {GROUNDED}", "VERIFIED"),
    ("NAME_COLLISION", f"wikidata_source <> '' AND {COLLIDES}", "AMBIGUOUS"),
    ("QID_LINK_MISMATCH", "wikidata_source <> '' AND wikidata_role = 'CONTRADICTORY'", "REJECTED"),
    ("WIKIDATA_UNAVAILABLE", "wikidata_unavailable <> ''", "INSUFFICIENT_EVIDENCE"),
    ("NAME_COLLISION", COLLIDES, "AMBIGUOUS"),
    ("NAME_UNIQUENESS_UNKNOWN", "name = 'UNKNOWN' OR alias = 'UNKNOWN'", "INSUFFICIENT_EVIDENCE"),
)


def identity_verdict() -> Column:
    """struct(status, rule) of rows with the columns of IDENTITY_RULES; the first rule that fires decides."""
    told = lambda status, rule: F.struct(F.lit(status).alias("status"), F.lit(rule).alias("rule"))
    out = F.when(F.lit(False), told("", ""))
    for rule, condition, status in IDENTITY_RULES:
        out = out.when(F.expr(condition), told(status, rule))
    return out.otherwise(told("INSUFFICIENT_EVIDENCE", "NO_DECISIVE_EVIDENCE"))


def route_variant(name: Column) -> Column:
    """The name without one leading and one trailing designator, whatever their case and accents, where something is left;
    white space as one space."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    key = lambda w: F.translate(F.lower(F.regexp_replace(w, r"[.\u0300-\u036f]", "")), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
    lead = (F.size(words) > 1) & key(words[0]).isin(*LEADING)
    rest = F.when(lead, F.slice(words, 2, F.size(words) - 1)).otherwise(words)
    trail = (F.size(rest) > 1) & key(F.element_at(rest, -1)).isin(*TRAILING)
    return F.array_join(F.when(trail, F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest), " ")


CLOCK = r"(\d{1,2}):(\d{2})\s*([AaPp][Mm])?\s*[–-]\s*(\d{1,2}):(\d{2})\s*([AaPp][Mm])?"


def _weekday(line: Column) -> Column:
    weekdays = F.create_map(*[F.lit(x) for k, d in enumerate(WEEKDAYS) for x in (d, k)])
    return F.when(F.instr(line, ":") > 0, weekdays[F.lower(F.trim(F.substring_index(line, ":", 1)))])


def _said(line: Column) -> Column:
    return F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line)))


def _closed(line: Column) -> Column:
    return F.contains(F.lower(_said(line)), F.lit("closed"))


def opening_ranges(lines: Column) -> Column:
    """array<struct<weekday, start, end>> in minutes of weekday texts; 0 is Sunday. A range past midnight is split over two
    days, one that ends at midnight ends at 24:00, closed days and lines that can't be read have none."""

    def parts(line: Column) -> Column:
        day = _weekday(line)
        texts = F.when(day.isNotNull() & ~_closed(line), F.split(_said(line), ",")).otherwise(F.array().cast("array<string>"))
        return F.transform(F.filter(texts, lambda t: F.regexp_like(t, F.lit(CLOCK))), lambda t: F.struct(day.alias("day"), t.alias("text")))

    def group(t: Column, k: int) -> Column:
        return F.regexp_extract(t, CLOCK, k)

    def minutes(hour: Column, minute: Column, half: Column) -> Column:
        h = F.when(half == "", hour.cast("int")).otherwise(hour.cast("int") % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0))
        return h * 60 + minute.cast("int")

    def ranges(p: Column) -> Column:
        t, day = p["text"], p["day"]
        # A half of the day after the second time only holds for both; after the first only, for neither.
        both = group(t, 6)
        start, end = minutes(group(t, 1), group(t, 2), F.when(both == "", "").when(group(t, 3) == "", both).otherwise(group(t, 3))), minutes(group(t, 4), group(t, 5), both)
        one = lambda d, a, b: F.struct(d.cast("int").alias("weekday"), a.cast("int").alias("start"), b.cast("int").alias("end"))
        return (
            F.when((end > 0) & (end <= start), F.array(one(day, start, F.lit(1440)), one((day + 1) % 7, F.lit(0), end)))
            .when((end == 0) & (start > 0), F.array(one(day, start, F.lit(1440)))).otherwise(F.array(one(day, start, end)))
        )

    return F.flatten(F.transform(F.flatten(F.transform(lines, parts)), ranges))


def opening_week(lines: Column) -> Column:
    """array<struct<weekday, ranges>> of the days that are known, closed ones with no range; null where no line can be read,
    which is unknown and never taken for closed. A day is known by its own line or by a range that reaches into it."""
    ranges = opening_ranges(lines)
    closed = F.transform(F.filter(lines, lambda t: _weekday(t).isNotNull() & _closed(t)), lambda t: _weekday(t).cast("int"))
    days = F.array_sort(F.array_union(closed, F.transform(ranges, lambda r: r["weekday"])))
    own = lambda d: F.transform(F.filter(ranges, lambda r: r["weekday"] == d), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return F.when(F.size(days) > 0, F.transform(days, lambda d: F.struct(d.alias("weekday"), own(d).alias("ranges"))))


def open_during(week: Column, weekday: Column, start: Column, end: Column) -> Column:
    """Within one range of the day; unknown weeks and days count as open."""
    day = F.get(F.filter(week, lambda d: d["weekday"] == weekday), F.lit(0))
    return F.coalesce(F.exists(day["ranges"], lambda r: (start >= r["start"]) & (end <= r["end"])), F.lit(True))


def _balanced(text: str) -> str:
    """The first object of a text with balanced braces, strings aside; else from the first to the last brace."""
    start, depth, quoted, escaped = text.find("{"), 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    stop = text.rfind("}")
    return text[start : stop + 1] if 0 <= start < stop else text


#: What repairing looks at: strings, which may not be closed; comments; commas.
LEXEME = re.compile(r'"(?:[^"\\]|\\.)*"?|/\*.*?(?:\*/|\Z)|//[^\n]*|,', re.S)
AFTER_COMMA = re.compile(r"(?:\s|/\*.*?\*/|//[^\n]*)*[}\]]", re.S)
CONTROLS = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _repaired(text: str) -> str:
    def mend(m: re.Match) -> str:
        said = m[0]
        if said[0] == '"':
            return re.sub(r"[\n\r\t]", lambda c: CONTROLS[c[0]], said)
        return "," if said == "," and not AFTER_COMMA.match(text, m.end()) else ""

    return LEXEME.sub(mend, text)


@F.pandas_udf(StringType())
def balanced_object(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else _balanced(x))


@F.pandas_udf(StringType())
def repaired_object(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else _repaired(x))


def extract_json(text: Column) -> Column:
    """The JSON object in a model's answer: reasoning and code fences off, then the first balanced object."""
    out = F.trim(F.regexp_replace(F.trim(text), r"(?is)<think>.*?</think>", ""))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"(?i)^```json\s*", ""), r"^```\s*", ""), r"\s*```$", "")
    return F.trim(balanced_object(out))


def repair_json(text: Column) -> Column:
    """Trailing commas and comments off, line ends and tabs inside strings escaped; what strings hold otherwise stays."""
    return repaired_object(text)
