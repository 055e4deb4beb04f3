"""Literal names in whole texts: a fold that knows which script a mark belongs to, with offsets into the source.

Folding: compatibility forms unified, marks taken off Latin letters only (elsewhere they tell words apart), recomposed, lower
case, everything but letters, digits and marks one space. Words are what spaces part, and in scripts written without spaces
the runs of one script; there is no dictionary, so a name that ends within a run of Han or kana isn't found there.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names are broadcast up to so many and so many code points; beyond, they meet the texts by a word of each.
FEW_NAMES, FEW_CHARS = 50_000, 4 << 20
# Scripts without spaces, one run each.
DENSE = re.compile(r"[⺀-⿟々〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003FFFF]+|[ぁ-ゟ]+|[゠-ヿㇰ-ㇿ]+|[฀-๿]+|[຀-໿]+|[ក-៿]+|[က-႟]+")
DENSE_ANY = re.compile("[" + re.sub(r"[][+|]", "", DENSE.pattern) + "]")
MARKS = re.compile("[̀-ͯ]+")


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may become one with what stands before them: marks, and second parts of composed letters."""
    parts = {chr(c): d for c in range(0x110000) if (d := unicodedata.decomposition(chr(c)))}
    second = {chr(int(d.split()[1], 16)) for d in parts.values() if not d.startswith("<") and " " in d} | {chr(c) for c in range(0x1160, 0x1200)}
    begins = {c: unicodedata.normalize("NFKD", c)[0] for c in parts}
    return frozenset(second | {c for c, first in begins.items() if first in second or unicodedata.combining(first)})


@lru_cache(maxsize=1 << 16)
def _folded(cluster: str) -> str:
    out, latin = [], False
    for c in unicodedata.normalize("NFKD", cluster):
        if latin and "̀" <= c <= "ͯ":
            continue
        latin = c.isalpha() and unicodedata.name(c, "").startswith("LATIN")
        out.append(c)
    said = unicodedata.normalize("NFC", "".join(out)).lower()
    return "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in said)


class _Singles(dict):
    """What a character alone folds to, by code point."""

    def __missing__(self, c: int) -> str:
        self[c] = out = _folded(chr(c))
        return out


_SINGLES = _Singles()
#: One for one: by code point, that of what it folds to, or a note that it isn't known yet or that it takes more than this.
UNKNOWN, MORE = 0x110000, 0x110001


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.full(0x110000, UNKNOWN, np.uint32)


@lru_cache(maxsize=1)
def _clusters() -> tuple[frozenset[str], re.Pattern[str]]:
    """Marks, and the pattern of a character with what may become one with it."""
    marks = _joining() | {chr(c) for c in range(0x80, 0x110000) if unicodedata.combining(chr(c))}
    return marks, re.compile("([\\s\\S][" + "".join(map(re.escape, sorted(marks))) + "]+)")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _one_for_one(text: str) -> str | None:
    """The text if each character folds to one, without marks that may join another."""
    table, points = _table(), _points(text)
    out = table[points]
    if (new := out == UNKNOWN).any():
        marks = _clusters()[0]
        for c in np.unique(points[new]).tolist():
            said = _SINGLES[c]
            table[c] = ord(said) if len(said) == 1 and chr(c) not in marks else MORE
        out = table[points]
    return None if (out == MORE).any() else out.tobytes().decode("utf-32-le", "surrogatepass")


class Fold:
    """A folded text that finds its way back: characters without marks are translated all at once, those with marks one by one,
    and only who asks for places pays for them."""

    def __init__(self, text: str):
        self.parts, self.wide = [text], [text.translate(_SINGLES) if text.isascii() else _one_for_one(text)]
        if self.wide[0] is None:
            marks, clusters = _clusters()
            self.parts = [text] if marks.isdisjoint(text) else clusters.split(text)  # every other one is a character with marks
            self.wide = [_folded(p) if n % 2 else p.translate(_SINGLES) for n, p in enumerate(self.parts)]
        self.whole = "".join(self.wide)
        self.said = " ".join(self.whole.split())
        self._at: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the characters before blanks are made one: which are none, and where each one's source starts and ends."""
        starts, ends, k = [], [], 0
        for n, (part, wide) in enumerate(zip(self.parts, self.wide, strict=True)):
            to = k + len(part)
            if n % 2:
                starts.append(np.full(len(wide), k))
                ends.append(np.full(len(wide), to))
            else:
                own = np.arange(k, to)
                if len(wide) != len(part):
                    own = np.repeat(own, [len(_SINGLES[ord(c)]) for c in part])
                starts.append(own)
                ends.append(own + 1)
            k = to
        black = np.flatnonzero(_points(self.whole) != 32)
        return black, np.concatenate(starts), np.concatenate(ends)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where the source of the folded characters a to b starts and ends; neither end is a blank."""
        if self._at is None:
            self._at = self._places()
        black, starts, ends = self._at
        first = black[a - self.said.count(" ", 0, a)]
        last = black[b - 1 - self.said.count(" ", 0, b - 1)]
        return int(starts[first]), int(ends[last])


def folded(text: str | None) -> str:
    return Fold(text or "").said


def fold(text: str) -> tuple[str, list[int], list[int]]:
    """The folded text and, for each of its characters, where the source characters that it comes from start and end; a blank
    comes from the first that it stands for."""
    f = Fold(text)
    black, starts, ends = f._places()
    at: list[int] = []
    n = 0
    for c in f.said:
        at.append(int(black[n - 1]) + 1 if c == " " else int(black[n]))
        n += c != " "
    return f.said, starts[at].tolist() if at else [], ends[at].tolist() if at else []


def words(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words of a folded text."""
    out = []
    for m in re.finditer(r"[^ ]+", text):
        at = m.start()
        for d in DENSE.finditer(text, m.start(), m.end()):
            if d.start() > at:
                out.append((at, d.start()))
            out.append(d.span())
            at = d.end()
        if at < m.end():
            out.append((at, m.end()))
    return out


def _firsts(said: str, by_word: dict[str, list[str]]) -> dict[str, list[int]]:
    """Names, listed by their first word, that stand in a folded text as whole words: how often, and start and end of the first."""
    found: dict[str, list[int]] = {}
    if not said.isascii() and DENSE_ANY.search(said):
        spans = words(said)
        ends = {b for _, b in spans}
        for a, b in spans:
            for name in by_word.get(said[a:b], ()):
                if a + len(name) in ends and said.startswith(name, a):
                    found.setdefault(name, [0, a, a + len(name)])[0] += 1
        return found
    padded, every = f" {said} ", said.split(" ")  # every word stands between blanks
    for word in by_word.keys() & set(every):
        for name in by_word[word]:
            asked = f" {name} "
            if (first := padded.find(asked)) >= 0:
                n, at = (every.count(name), -1) if name == word else (0, first)
                while at >= 0:
                    n, at = n + 1, padded.find(asked, at + 1)
                found[name] = [n, first, first + len(name)]
    return found


def _listed(names: list[str]) -> dict[str, list[str]]:
    by_word: dict[str, list[str]] = defaultdict(list)
    for name in names:
        a, b = words(name)[0]
        by_word[name[a:b]].append(name)
    return by_word


FOUND = "uid long, name string, n long, start long, end long"


def folded_names(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, word): distinct folded names with a letter or digit, and the first word of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = {folded(t) for t in batch.column(0).to_pylist()}
            kept = sorted(t for t in said if any(unicodedata.category(c)[0] in "LN" for c in t))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([t[slice(*words(t)[0])] for t in kept], pa.string())], ["name", "word"])

    return names.select(F.col(f"`{column}`")).mapInArrow(run, "name string, word string").distinct()


def _search(batches: Iterator[pa.RecordBatch], by_word: dict[str, list[str]] | None, quoted: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()][: 5 + quoted]
    for batch in batches:
        rows = []
        lists = batch.column("names").to_pylist() if by_word is None else [None] * batch.num_rows
        for uid, text, names in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), lists, strict=True):
            f = Fold(text or "")
            for name, (n, a, b) in _firsts(f.said, by_word if by_word is not None else _listed(names)).items():
                start, end = f.span(a, b)
                rows.append((uid, name, n, start, end, text[start:end])[: 5 + quoted])
        columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["uid", "name", "n", "start", "end", "quoted"][: 5 + quoted])


def names_in_texts(docs: DataFrame, names: DataFrame, few: int = FEW_NAMES, quoted: bool = False) -> DataFrame:
    """(uid, name, n, start, end): how often each name stands as whole words in each text of docs (uid, text), and the span
    of the first time in the source, in code points; with quoted, also what stands there.

    names (name) are folded and made distinct; null and empty texts and names without a letter or digit meet nothing. As
    long as the names are few they go to all tasks and texts aren't shuffled. Beyond, every text meets the names by its
    words, one row per text and word, and only names that share a first word with a text are looked for in it.
    """
    asked = folded_names(names)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()
    docs, schema = docs.select("uid", "text"), FOUND + ", quoted string" * quoted
    if size.n <= few and size.chars <= FEW_CHARS:
        held = docs.sparkSession.sparkContext.broadcast([r.name for r in asked.select("name").collect()])
        return docs.mapInArrow(lambda batches: _search(batches, _listed(held.value), quoted), schema)

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, said = [], []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = folded(text)
                own = {whole[a:b] for a, b in words(whole)}
                uids += [uid] * len(own)
                said += own
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(said, pa.string())], ["uid", "word"])

    met = docs.mapInArrow(spoken, "uid long, word string").join(asked, "word").groupBy("uid").agg(F.collect_set("name").alias("names"))
    return docs.join(met, "uid").select("uid", "text", "names").mapInArrow(lambda batches: _search(batches, None, quoted), schema)


def fold_column(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the folded text of a column; null stays null."""
    kept = [c for c in rows.columns if c != out]
    schema = rows.select(*kept).withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if t is None else folded(t) for t in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return rows.select(*kept).mapInArrow(run, schema)
