"""Listings in wiki texts: balanced templates, their parameters, and an audit of what was dropped."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Templates that hold listings, with the section they belong to; other words of a section, in order.
SECTION_OF = {"see": "SEE", "ver": "SEE", "do": "DO", "hacer": "DO", "eat": "EAT", "comer": "EAT"}
LISTINGS = frozenset([*SECTION_OF, "listing", "listado"])
HEADED = (("ver", "SEE"), ("see", "SEE"), ("hacer", "DO"), ("do", "DO"), ("comer", "EAT"), ("eat", "EAT"))
BRACES, BRACKETS = re.compile(r"\{\{|\}\}"), re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
NAME, HEADER = re.compile(r"([a-zA-ZáéíóúÁÉÍÓÚ_]+)[\s|}]"), re.compile(r"==+\s*([^=]+?)\s*==+")
NUMBER, QID = re.compile(r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)"), re.compile(r"Q[0-9]+", re.I)
MARKUP = (
    (re.compile(r"\[\[(?:Archivo|File|Image|Imagen):[^\]]+\]\]", re.I), ""), (re.compile(r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]"), r"\1"), (re.compile(r"\[https?://[^\s\]]+\s+([^\]]+)\]"), r"\1"),
    (re.compile(r"\[https?://[^\s\]]+\]"), ""), (re.compile(r"<[^>]+>"), ""),
)
#: Rows that a task holds as Python objects.
AT_ONCE = 1000
ENTITIES = re.compile("&(?:quot|amp|lt|gt|#39);")


def templates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the outermost balanced templates with a name, in order.

    One pass with a stack: closing braces end the last opening that is still open, so an opening that never closes takes
    nothing with it, and closings without an opening are text.
    """
    opened: list[int] = []
    closed: list[tuple[int, int]] = []
    for m in BRACES.finditer(text):
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            closed.append((opened.pop(), m.end()))
    out, far = [], 0
    for a, b in sorted(closed):
        if a >= far and (name := NAME.match(text, a + 2)):
            out.append((a, b, name[1].lower()))
            far = b
    return out


def parameters(body: str) -> dict[str, str]:
    """key=value parts between the bars outside nested templates and links; the last of equal keys stands."""
    cuts, depth = [], 0
    for m in BRACKETS.finditer(body):
        if m[0] == "|":
            cuts += [m.start()] if depth == 0 else []
        else:
            depth += 1 if m[0] in ("{{", "[[") else -1
    parts = [body[a + 1 : b] for a, b in zip(cuts, [*cuts, len(body)][1:], strict=True)]
    return {key.strip().lower(): value.strip() for key, eq, value in (p.partition("=") for p in parts) if eq}


def plain(text: str) -> str:
    for pattern, to in MARKUP:
        text = pattern.sub(to, text)
    return " ".join(ENTITIES.sub(lambda m: html.unescape(m[0]), text).split())


def _number(text: str | None, most: float) -> float | None:
    text = (text or "").strip()
    return v if NUMBER.fullmatch(text) and abs(v := float(text)) <= most else None


def section(name: str, kind: str, before: str) -> str:
    """By the template, else its type, else the last heading before it."""
    if found := SECTION_OF.get(name) or SECTION_OF.get(kind.strip().lower()):
        return found
    heads = HEADER.findall(before)
    last = heads[-1].lower() if heads else ""
    return next((s for word, s in HEADED if word in last), "OTHER")


def parsed(text: str) -> Iterator[dict]:
    """Every outermost template in order: an entry, or why it is none (dropped)."""
    for a, b, name in templates(text):
        row = dict.fromkeys(KINDS.names) | {"template": name, "start": a}
        if name not in LISTINGS:
            yield row | {"dropped": "UNSUPPORTED"}
            continue
        own = parameters(text[a + 2 : b - 2])
        said = own.get("name") or own.get("nombre")
        if not said or not plain(said):
            yield row | {"dropped": "EMPTY_NAME" if "name" in own or "nombre" in own else "MISSING_NAME"}
            continue
        about = next((own[k] for k in ("content", "description", "descripción", "contenido") if own.get(k)), "")
        qid = QID.search(own.get("wikidata", ""))
        yield row | {
            "name": plain(said), "description": plain(about) or None, "latitude": _number(own.get("lat") or own.get("latitude"), 90), "longitude": _number(own.get("long") or own.get("lon") or own.get("longitude"), 180),
            "wikidata": qid[0].upper() if qid else None, "section": section(name, own.get("tipo") or own.get("type") or "", text[:a]),
        }


KINDS = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int32()), ("start", pa.int64()), ("template", pa.string()), ("name", pa.string()), ("description", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("wikidata", pa.string()), ("section", pa.string()), ("dropped", pa.string())])
LISTED = "doc_id long, ordinal int, start long, template string, name string, description string, latitude double, longitude double, wikidata string, section string, dropped string"


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The templates of batches (doc_id, text), AT_ONCE rows at a time, whatever the texts of a batch hold."""
    for batch in batches:
        rows: list[dict] = []
        for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            for k, r in enumerate(parsed(t.as_py() or ""), 1):
                rows.append(r | {"doc_id": d.as_py(), "ordinal": k})
                if len(rows) == AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=KINDS)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=KINDS)


def listings(docs: DataFrame) -> DataFrame:
    """A row per outermost template of docs (doc_id, text): its entry, or why it was dropped. Null texts have none."""
    return docs.select("doc_id", "text").mapInArrow(listed, LISTED)


def audit(rows: DataFrame) -> DataFrame:
    """Per document: listings recognised and parsed, entries by section, drops by reason. Counts add up before the shuffle."""
    n = lambda c: F.count_if(c)
    return rows.groupBy("doc_id").agg(
        n(F.col("dropped").isNull() | (F.col("dropped") != "UNSUPPORTED")).alias("recognised"), n(F.col("dropped").isNull()).alias("parsed"), *[n(F.col("section") == s).alias(s.lower()) for s in ("SEE", "DO", "EAT", "OTHER")],
        *[n(F.col("dropped") == d).alias(d.lower()) for d in ("MISSING_NAME", "EMPTY_NAME", "UNSUPPORTED")],
    )
