"""Every query of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import feeds, gathered, geometry, identity, intake, knowledge, literals, members, more, overlap, persistence, planner, policy, ranking, relational, retrieval, scalar, scopes, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
