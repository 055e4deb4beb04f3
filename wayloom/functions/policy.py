"""Decision tables of resolution, planning and text evidence as column expressions; the first rule that fires decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason -> (operational class, composition class).
DEFICITS = {
    "NO_CANDIDATE_ACQUIRED": ("PENDING_CLASSIFICATION", "MISSING_KNOWLEDGE"),
    "CANDIDATE_UNCONFIRMED": ("PENDING_CLASSIFICATION", "MISSING_KNOWLEDGE"),
    "CANDIDATE_REJECTED": ("PENDING_CLASSIFICATION", "MISSING_KNOWLEDGE"),
    "AMBIGUOUS_CANDIDATES": ("KNOWLEDGE_DEFICIT", "MISSING_KNOWLEDGE"),
    "IDENTITY_CONFLICT": ("PENDING_CLASSIFICATION", "CONTRADICTORY_EVIDENCE"),
    "DESTINATION_INCOMPATIBLE": ("PENDING_CLASSIFICATION", "CONTRADICTORY_EVIDENCE"),
    "DESTINATION_COMPATIBILITY_UNKNOWN": ("PENDING_CLASSIFICATION", "UNKNOWN"),
    "PROVIDER_FAILURE": ("OPERATIONAL_FAILURE", "SYSTEM_FAILURE"),
    "IDENTITY_AUTHORITY_UNAVAILABLE": ("OPERATIONAL_FAILURE", "SYSTEM_FAILURE"),
    "RESOLUTION_REVOKED": (None, "MISSING_KNOWLEDGE"),
}
OWN_NAMES = "name short_name alt_name official_name".split()
SPEEDS = {"WALKING": 4.5, "CYCLING": 13.0, "DRIVING": 25.0, "PUBLIC_TRANSPORT": 25.0}  # km/h
DETOUR = 1.3
FALLBACK_MINUTES = 20
CONTEXT_ATOMS = 3
SENTENCE_ENDS, WIDE_ENDS = ".!?", "。！？｡؟।"

#: White space of the text kernel: the ASCII controls, no-break and typographic spaces, line and paragraph separators.
SPACE = "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _lookup(values: dict, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast("string")).otherwise(out)
    return out


def deficit_class(reason: Column) -> Column:
    """Operational class of a runtime reason; none for a revoked resolution, which is no runtime reason."""
    return _lookup({k: a for k, (a, _) in DEFICITS.items()}, reason)


def composition_class(reason: Column) -> Column:
    return _lookup({k: b for k, (_, b) in DEFICITS.items()}, reason)


def persistable(reason: Column) -> Column:
    """The reason, where it may stay on an unresolved member of a partial composite."""
    return F.when((composition_class(reason) == "MISSING_KNOWLEDGE") & deficit_class(reason).isNotNull(), reason)


def acquisition_plan(kind: Column, authorized: Column, country: Column) -> Column:
    """Strategies that may look for an identity: places have two more, one of them only within a country."""
    place = kind == "PLACE"
    steps = F.array(F.lit("NOMINATIM"), F.when(place, "PLACES"), F.when(place & country.isNotNull(), "OVERTURE_IDENTITY"))
    return F.when(authorized, F.array_compact(steps)).otherwise(F.array().cast("array<string>"))


def source_document(url: Column) -> Column:
    """A trimmed URL as a document: scheme and host in lower case, no fragment, no last slash; other texts as they are."""
    text = F.trim(url)
    head = F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), "(?s)#.*$", "")
    return F.when(head == "", text).otherwise(F.regexp_replace(F.concat(F.lower(head), rest), "/$", ""))


def source_relation(a: Column, b: Column) -> Column:
    """SAME_SOURCE, DIFFERENT_SOURCE or, where either side names no document, SOURCE_UNKNOWN."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "SOURCE_UNKNOWN").when(F.arrays_overlap(a, b), "SAME_SOURCE").otherwise("DIFFERENT_SOURCE")


def kind_compatibility(asserted: Column, kind: Column) -> Column:
    wanted = F.when(asserted == "ESTABLISHMENT", "POINT_OF_INTEREST").otherwise("SETTLEMENT")
    return F.when(asserted.isNull(), "NOT_ASSERTED").when(F.coalesce(kind, F.lit("UNKNOWN")) == "UNKNOWN", "UNKNOWN").when(kind == wanted, "COMPATIBLE").otherwise("INCOMPATIBLE")


def pool_outcome(inside: Column, undetermined: Column, complete: Column, unknown_kind: Column) -> Column:
    """Of a pool's members that fit the asserted kind: how many are inside the locality, how many can't be told."""
    return (
        F.when(inside > 1, "AMBIGUOUS").when((inside == 0) & (undetermined > 0), "INCOMPLETE_COMPARISON").when(inside == 0, "NO_CONSISTENT_MEMBER")
        .when((undetermined > 0) | ~complete, "INCOMPLETE_COMPARISON").when(unknown_kind > 0, "KIND_UNESTABLISHED").otherwise("DISTINGUISHED")
    )


def travel_mode(allowed: Column) -> Column:
    """Walking wherever it is allowed, else the first mode."""
    return F.when(F.array_contains(allowed, "WALKING"), "WALKING").otherwise(F.element_at(allowed, 1))


def speed_kmh(mode: Column) -> Column:
    out = F.lit(SPEEDS["WALKING"])
    for k, v in SPEEDS.items():
        out = F.when(mode == k, F.lit(v)).otherwise(out)
    return out


def internal_walking(metres: Column, minutes: Column, point: Column) -> Column:
    """Known metres; none where only minutes are known; unknown: none for a point, else 20 minutes' walk."""
    return F.coalesce(metres, F.when(minutes.isNotNull() | point, 0.0).otherwise(FALLBACK_MINUTES * SPEEDS["WALKING"] * 1000 / 60))


def walking_reasons(projected: Column, leg: Column, longest: Column, allowed: Column, per_day: Column, at_once: Column) -> Column:
    """Limits that a candidate would exceed: over the day, where walking is allowed at all, and at one go."""
    day = F.when(F.array_contains(allowed, "WALKING") & (projected > per_day), "MAX_WALKING_PER_DAY_EXCEEDED")
    return F.array_compact(F.array(day, F.when((leg > at_once) | (longest > at_once), "MAX_CONTINUOUS_WALKING_EXCEEDED")))


def authorization(grant: Column, components: Column) -> Column:
    """WALK or ROUTE_LIKE where the work unit owns that intent and the candidate has two components, else DEFAULT."""
    return F.when(grant.isNull() | (components < 2), "DEFAULT").when(grant == "walk", "WALK").otherwise("ROUTE_LIKE")


def qid(text: Column) -> Column:
    return F.when(F.regexp_like(F.trim(text), F.lit("^Q[1-9][0-9]*$")), F.trim(text))


def visible_heading(text: Column) -> Column:
    """A heading without markers, link targets and emphasis; white space as one space."""
    out = F.regexp_replace(text, f"^{SPACE}{{0,3}}#{{1,6}}{SPACE}+", "")
    out = F.regexp_replace(out, f"{SPACE}+#+{SPACE}*$", "")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[*_`]+", ""), f"{SPACE}+", " "))


def statements(text: Column) -> Column:
    """Visible statements in order: sentences, lines, the text of images; no markup, none without a letter or digit."""
    out = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "\n$1\n")
    out = F.regexp_replace(F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1"), "[*_~`#]+", " ")
    parts = F.split(out, f"(?<=[{SENTENCE_ENDS}]){SPACE}+|(?<=[{WIDE_ENDS}]){SPACE}*|\n+")
    tidy = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, f"{SPACE}+", " ")))
    return F.filter(tidy, lambda s: F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")))


def quotable(text: Column) -> Column:
    """The form in which a quoted span is looked for: links and emphasis off, lower case, no space before punctuation or
    beside quotation marks, white space as one space."""
    out = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1"), "[*_~`#]+", " ")
    out = F.regexp_replace(F.lower(out), f"{SPACE}+([,.:;?!])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, f"{SPACE}*([\"“”«»]){SPACE}*", "$1"), f"{SPACE}+", " "))


def span_support(span: Column, cited: Column, seen: Column, matches: Column) -> Column:
    """Whose evidence holds a span: a cited item's; else that of the only item that has it."""
    return (
        F.when(span == "", "NO_SUPPORT_SPAN").when(cited.isNotNull(), "DECLARED_KEY_VERIFIED").when(matches == 1, "REATTRIBUTED_UNIQUE_EXACT_SPAN")
        .when(matches > 1, "AMBIGUOUS_SUPPORTING_EVIDENCE").when(seen, "SPAN_NOT_FOUND_IN_CITED_EVIDENCE").otherwise("MISSING_EVIDENCE_TEXT")
    )


def relation_in_order(relation: Column, conflict: Column) -> Column:
    """A composition within another one overlaps it only in part where the order of shared members disagrees."""
    return F.when((relation == "SUBCOMPOSITION") & conflict, "PARTIAL_OVERLAP").otherwise(relation)


def decisive_evidence(e: dict[str, Column]) -> Column:
    """SAME, AMBIGUOUS or DISTINCT and what decided it, as struct(verdict, evidence), from a pair's evidence by name."""
    similar, alone = e["name"] >= 0.72, e["standalone"]
    confirmed = (e["roles"] == 1) & ((e["name"] == 1) | (e["concept"] == 1)) & ~e["conflict"]
    strong = ~alone & ((e["members"] >= 0.5) | (e["roles"] >= 0.4))
    said = lambda v, why: F.struct(F.lit(v).alias("verdict"), (F.lit(why) if isinstance(why, str) else why).alias("evidence"))
    contained = F.when(alone, "STANDALONE_COMPOSITE_MEMBERSHIP").when(e["source"] == "SAME_SOURCE", "SUBCOMPOSITION_SAME_SOURCE_CONTAINMENT").when(e["source"] == "DIFFERENT_SOURCE", "SUBCOMPOSITION_DIFFERENT_SOURCE").otherwise("SUBCOMPOSITION_SOURCE_UNKNOWN")
    r = e["relation"]
    return (
        F.when((r == "EXACT_COMPOSITION") & confirmed, said("SAME", "EXACT_COMPOSITION_IDENTITY_CONFIRMED")).when(r == "EXACT_COMPOSITION", said("AMBIGUOUS", "EXACT_COMPOSITION_IDENTITY_UNCONFIRMED"))
        .when((r == "DISJOINT") & similar, said("AMBIGUOUS", "SIMILAR_NAME_WITHOUT_SHARED_STRUCTURE")).when(r == "DISJOINT", said("DISTINCT", "STRUCTURALLY_DISJOINT"))
        .when(similar, said("AMBIGUOUS", "STRUCTURAL_OVERLAP_WITH_SIMILAR_NAME")).when(r == "SUBCOMPOSITION", said("DISTINCT", contained))
        .when(strong, said("AMBIGUOUS", "PARTIAL_OVERLAP_IDENTITY_UNRESOLVED")).otherwise(said("DISTINCT", F.when(alone, "STANDALONE_COMPOSITE_MEMBERSHIP").otherwise("PARTIAL_OVERLAP_INSUFFICIENT")))
    )


def evidence_total(e: dict[str, Column]) -> Column:
    """Orders candidates; it never decides identity."""
    near = F.when(e["km"] <= 0.5, 0.08).when(e["km"] <= 1.5, 0.04).otherwise(0.0)
    return e["name"] * 0.22 + e["semantic"] * 0.2 + e["members"] * 0.15 + e["roles"] * 0.3 + e["provenance"] * 0.05 + near


def reconciliation(same: Column, positioned: Column, covered: Column, conflicts: Column, learned: Column) -> Column:
    """What one more observation of a composition does to the stored one; a conflict anywhere rejects all of it."""
    return F.when(~same | ~positioned | ~covered, "NOT_ELIGIBLE").when(conflicts > 0, "CONFLICT_REJECTED").when(learned > 0, "ENRICHED").otherwise("NO_NEW_KNOWLEDGE")
