"""String functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters of Latin-1 and Latin Extended-A that decompose to one letter and marks: folded in generated code.
SINGLE = {chr(c): d[0] for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFKD", chr(c)).lower()) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])}


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not "\u0300" <= c <= "\u036f").lower()


@F.pandas_udf(StringType())
def nfkd_fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without marks U+0300 to U+036F, in lower case; null stays null."""
    for s in parts:
        yield s.map(lambda x: None if x is None else _fold(x))


def _plain(s: Column) -> Column:
    return F.translate(s, "".join(SINGLE), "".join(SINGLE.values()))


def norm_name(s: Column) -> Column:
    """Compatibility decomposition, marks dropped, lower case, runs of anything but a to z and digits as one space, trimmed.

    Strings that one table of letters folds stay in generated code; only others, with ligatures, full-width or decomposed
    letters, go through Arrow.
    """
    simple = F.regexp_like(_plain(s), F.lit("^[\\x00-\\x7FßæøđħłŧŋœÆØĐĦŁŦŊŒ¿¡«»\u2010-\u201F\u2026\u20AC]*$"))
    folded = F.when(simple, F.lower(_plain(s))).otherwise(nfkd_fold(F.when(~simple, s)))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def tokens(s: Column) -> Column:
    """Distinct words of the normalised name."""
    return F.array_distinct(F.filter(F.split(norm_name(s), " "), lambda t: t != ""))


def overlap_ratio(a: Column, b: Column) -> Column:
    """|A & B| / max(|A|, |B|); both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(both / most)


def token_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(F.array_union(a, b))
    return F.when(any_ == 0, 1.0).otherwise(both / any_)


def name_match(a: Column, b: Column) -> Column:
    """Equal or one contained in the other after normalisation; empty names match nothing."""
    x, y = norm_name(a), norm_name(b)
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x))


def document_identity(url: Column) -> Column:
    """A URL without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def redact(s: Column) -> Column:
    """Bearer tokens and key=value secrets masked."""
    out = F.regexp_replace(s, r"(?i)bearer\s+[a-z0-9._-]+", "Bearer [redacted]")
    return F.regexp_replace(out, r"(?i)(api[_-]?key|token|secret|password)=[^&\s]+", "$1=[redacted]")
