"""A long text as a finite sequence of windows: the most relevant editorial unit first, then all the rest in order.

Headings form a tree by level, told by a scan with a stack; what fits a unit stays whole. Chunks are packed paragraphs of
one section. Every chunk stands in some window, and a whole unit never shares a window with a part of another one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values.
PAYLOAD = re.compile(r"data:[a-z0-9.+/-]+(?:;[a-z0-9=.+-]+)*;base64,[a-z0-9+/=]+", re.I)
HEADING = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
GAP, TOKEN = re.compile(r"\n[ \t]*\n"), re.compile(r"[^\W_]+")
HEADING_WEIGHT, CHUNKS_A_BUDGET, SEPARATOR = 2, 4, 7


class Unit(NamedTuple):
    start: int
    end: int
    whole: bool


class Chunk(NamedTuple):
    start: int
    end: int
    unit: int
    said: int  # characters without white space at the ends


def terms(text: str) -> set[str]:
    """Words of three characters and more, without marks, in lower case, plurals folded."""
    out = set()
    for word in TOKEN.findall(text):
        if len(word) >= 3:
            t = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()
            out.add(t[:-3] + "y" if len(t) > 4 and t.endswith("ies") else t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t)
    return out


def units(text: str, most: int) -> list[Unit]:
    """Subtrees of headings that fit, the text before and between them. The only heading of the least level is the title of
    the page, no unit, so that it doesn't swallow it."""
    heads = [(m.start(), len(m[1])) for m in HEADING.finditer(text)]
    ends, open_ = [len(text)] * len(heads), []
    for k, (at, level) in enumerate(heads):
        while open_ and heads[open_[-1]][1] >= level:
            ends[open_.pop()] = at
        open_.append(k)
    low = min((level for _, level in heads), default=0)
    title = next(k for k, (_, level) in enumerate(heads) if level == low) if sum(level == low for _, level in heads) == 1 else -1
    out: list[Unit] = []

    def lead(a: int, b: int) -> None:
        if text[a:b].strip():
            out.append(Unit(a, b, b - a <= most))

    lead(0, heads[0][0] if heads else len(text))
    done = 0
    for k, (at, _) in enumerate(heads):
        if at < done:
            continue
        if k != title and ends[k] - at <= most:
            out.append(Unit(at, ends[k], True))
            done = ends[k]
        else:
            lead(at, heads[k + 1][0] if k + 1 < len(heads) else len(text))
    return out


def _cut(text: str, a: int, b: int, most: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most so many characters, ended by a line, else by white space, where there is any."""
    while b - a > most:
        stop = text.rfind("\n", a + 1, a + most)
        if stop < 0:
            stop = max((m.start() for m in re.finditer(r"\s", text[a + 1 : a + most])), default=-2) + a + 1
        to = stop + 1 if stop > a else a + most
        yield a, to
        a = to
    if b > a:
        yield a, b


def chunks(text: str, parts: list[Unit], most: int) -> list[Chunk]:
    """Paragraphs of each section packed up to so many characters; blank ones have none."""
    edges = sorted({0, len(text), *(m.start() for m in HEADING.finditer(text))})
    out, unit = [], 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        stops = [a, *(m.end() + a for m in GAP.finditer(text[a:b])), b]
        packed: list[list[int]] = []
        for x, y in zip(stops[:-1], stops[1:], strict=True):
            for s, e in _cut(text, x, y, most):
                if packed and e - packed[-1][0] <= most:
                    packed[-1][1] = e
                else:
                    packed.append([s, e])
        for s, e in packed:
            if said := len(text[s:e].strip()):
                while unit < len(parts) and parts[unit].end <= s:
                    unit += 1
                out.append(Chunk(s, e, unit, said))
    return out


def scores(bodies: list[set[str]], heads: list[set[str]], asked: set[str]) -> list[float]:
    """Distinct asked terms by how few of the ranges have them, those of headings twice."""
    n = len(bodies)
    weight = {t: math.log(1 + n / df) for t in sorted(asked) if (df := sum(t in b or t in h for b, h in zip(bodies, heads, strict=True)))}
    return [sum(w * (HEADING_WEIGHT if t in h else 1 if t in b else 0) for t, w in weight.items()) for b, h in zip(bodies, heads, strict=True)]


def _headed(text: str, spans: list[tuple[int, int]]) -> list[set[str]]:
    """Terms of the headings above and within each range: the path to it and those that start in it."""
    path: list[tuple[int, str]] = []
    heads = []
    for m in HEADING.finditer(text):
        while path and path[-1][0] >= len(m[1]):
            path.pop()
        path.append((len(m[1]), m[2]))
        heads.append((m.start(), " ".join(t for _, t in path)))
    out = []
    for a, b in spans:
        before = [t for at, t in heads if at <= a][-1:]
        out.append(terms(" ".join(before + [t for at, t in heads if a < at < b])))
    return out


def cost(held: list[Chunk]) -> int:
    return sum(c.said for c in held) + SEPARATOR * max(0, len(held) - 1)


def windows(text: str, asked: set[str], most: int, unit_most: int) -> tuple[list[Chunk], list[tuple[str, list[int], bool]]]:
    """(chunks, windows): strategy, numbers of the chunks in order and whether only whole units stand in it."""
    if len(text) <= most:
        return [Chunk(0, len(text), 0, len(text.strip()))], [("WHOLE_DOCUMENT", [0], True)]
    parts = units(text, unit_most)
    every = chunks(text, parts, max(1, most // CHUNKS_A_BUDGET))
    if not every:
        return [], []
    of: dict[int, list[int]] = {}
    for k, c in enumerate(every):
        of.setdefault(c.unit, []).append(k)
    rank = scores([terms(text[u.start : u.end]) for u in parts], _headed(text, [u[:2] for u in parts]), asked)
    best = max(range(len(parts)), key=lambda u: (rank[u], -u))
    first = of.get(best, [])
    if not parts[best].whole:
        # Text that fits no unit: its own best chunks, as many as the budget holds.
        spans = [every[k][:2] for k in range(len(every))]
        rank = scores([terms(text[a:b]) for a, b in spans], _headed(text, spans), asked)
        taken: list[int] = []
        for k in sorted(first, key=lambda k: (-rank[k], k)):
            if cost([every[i] for i in [*taken, k]]) <= most:
                taken.append(k)
        first = sorted(taken)
    out = [("SECTION_UNIT" if parts[best].whole else "RELEVANCE_WINDOWS", first, parts[best].whole)]
    seen, held = set(first), []
    price = lambda ks: cost([every[k] for k in ks])
    for u, own in of.items():
        if seen.issuperset(own):
            continue
        if parts[u].whole and price(own) <= most:
            if held and price([*held, *own]) > most:
                out.append(("DOCUMENT_ORDER_CONTINUATION", held, True))
                held = []
            held = held + own
            continue
        if held:
            out.append(("DOCUMENT_ORDER_CONTINUATION", held, True))
            held = []
        if parts[u].whole:
            out.append(("DOCUMENT_ORDER_CONTINUATION", own, True))
            continue
        # Runs of the budget; the last chunk of one is the first of the next, so what spans a cut stands whole somewhere.
        a = 0
        while a < len(own):
            b = a + 1
            while b < len(own) and price(own[a : b + 1]) <= most:
                b += 1
            if not seen.issuperset(own[a:b]):
                out.append(("DOCUMENT_ORDER_CONTINUATION", own[a:b], False))
            if b >= len(own):
                break
            a = b - 1 if b - 1 > a else b
    if held:
        out.append(("DOCUMENT_ORDER_CONTINUATION", held, True))
    return every, out


WINDOW = "doc_id long, window int, strategy string, n_chunks int, fresh int, start long, end long, chars long, whole boolean"


def windowed(docs: DataFrame, most: int, unit_most: int) -> DataFrame:
    """A row per window of docs (doc_id, text, asked): strategy, chunks, those that stood in no earlier window, the range in
    the text without inline payload, the characters told. Null texts are empty and have one empty window."""
    kinds = pa.schema([("doc_id", pa.int64()), ("window", pa.int32()), ("strategy", pa.string()), ("n_chunks", pa.int32()), ("fresh", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("chars", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                every, found = windows(PAYLOAD.sub("", r["text"] or ""), terms(r["asked"] or ""), most, unit_most)
                seen: set[int] = set()
                for n, (strategy, ks, whole) in enumerate(found, 1):
                    held = [every[k] for k in ks]
                    rows.append((r["doc_id"], n, strategy, len(ks), len(set(ks) - seen), held[0].start, held[-1].end, cost(held), whole))
                    seen |= set(ks)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * len(kinds), kinds.types, strict=True)], schema=kinds)

    return docs.select("doc_id", "text", "asked").mapInArrow(run, WINDOW)
