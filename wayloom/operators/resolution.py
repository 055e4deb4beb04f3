"""Entity resolution: verdict tables as expressions, admission of compositions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def structural_relation(a: Column, b: Column) -> Column:
    """Of two member sets: DISJOINT, EXACT_COMPOSITION, SUBCOMPOSITION or PARTIAL_OVERLAP."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(both == 0, "DISJOINT")
        .when((both == F.size(a)) & (both == F.size(b)), "EXACT_COMPOSITION")
        .when((both == F.size(a)) | (both == F.size(b)), "SUBCOMPOSITION")
        .otherwise("PARTIAL_OVERLAP")
    )


def pair_verdict(relation: Column, similar: Column, overlap: Column, exact: Column) -> Column:
    """SAME, AMBIGUOUS or DISTINCT by relation; ``exact``: roles, names and order agree."""
    return (
        F.when(relation == "EXACT_COMPOSITION", F.when(exact, "SAME").otherwise("AMBIGUOUS"))
        .when(relation == "SUBCOMPOSITION", F.when(similar, "AMBIGUOUS").otherwise("DISTINCT"))
        .when(relation == "PARTIAL_OVERLAP", F.when(similar | overlap, "AMBIGUOUS").otherwise("DISTINCT"))
        .otherwise(F.when(similar, "AMBIGUOUS").otherwise("DISTINCT"))
    )


def admission(members: Column, resolved: Column, distinct: Column, blocking: Column) -> Column:
    """Admission of a composition by its members, first rule that fires."""
    return (
        F.when(members == 0, "NO_MEMBERS").when(resolved == 0, "NO_RESOLVED_MEMBER").when(resolved == members, "COMPLETE")
        .when(distinct < 2, "BELOW_DISTINCT_FLOOR").when(blocking > 0, "BLOCKING_DEFICIT").otherwise("PARTIAL")
    )
