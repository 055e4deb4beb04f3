"""Byte-level BPE encoding and decoding by a rank file.

Pre-tokens are cut over whole batches of code points at once. Those that are tokens of the vocabulary are resolved
together by a minimal perfect hash of its tokens and a comparison of all bytes; the others, remembered by their bytes,
are merged on a linked list of byte runs with a heap of the pairs that the ranks know.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BACK, BASE, mix, pieces, powers, table

BATCH_BYTES = 1 << 20
#: Code points that are cut at once; a longer text is read in such spans, parted where a token starts whatever precedes it.
SPAN = 1 << 20
#: Merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1 << 19
#: Slots of a level of the perfect hash, as a multiple of the keys that are left.
SPARSE = 2
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, as the pattern engine of the library that reads these rank files knows them: its
    version of Unicode decides, not that of Python."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, by ``public_tokenizers.PATTERN``; edge marks the first code point of each text.

    A run of one class is a pre-token. White space before something else parts with its last character, which is the
    beginning of what follows if it is a blank and a pre-token of its own if not. An apostrophe that begins a pre-token
    forms one with s, t, m, d, re, ve or ll after it; the letters behind that start anew.
    """
    n = len(points)
    kind = classes()[points]
    at = edge.copy()
    at[1:] |= kind[1:] != kind[:-1]
    blank = (points == 32) & (kind == SPACE)
    inner = ~edge[1:]
    white = kind == SPACE
    last_white = np.zeros(n, bool)
    last_white[:-1] = white[:-1] & ~white[1:] & inner
    after_blank = np.zeros(n, bool)
    after_blank[1:] = last_white[:-1] & blank[:-1]
    at = (at & ~after_blank) | last_white
    quote = np.flatnonzero((points == 39) & at)
    if len(quote):
        edges = np.r_[edge, True, True, True]
        near = np.r_[points, np.zeros(3, points.dtype)]
        one, two = near[quote + 1], near[quote + 2]
        in_one = ~edges[quote + 1]
        in_two = in_one & ~edges[quote + 2]
        short = in_one & np.isin(one, [ord(c) for c in "stmd"])
        long = in_two & ((((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        q = quote[short | long]
        at[q + 1] = False
        end = q + np.where(short[short | long], 2, 3)
        at[end[end < n]] |= kind[end[end < n]] == LETTER
    return at


def spans(text: str) -> Iterator[str]:
    """A text in parts of about SPAN code points, cut before a blank between two characters that aren't white space."""
    at = 0
    while len(text) - at > SPAN:
        to = text.find(" ", at + SPAN)
        while to > 0 and (to + 1 >= len(text) or text[to - 1].isspace() or text[to + 1].isspace()):
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each of n keys has its own index below n. A key takes the slot that
    it alone hits on the first level where there is one; its index is the number of taken slots before."""

    def __init__(self, keys: np.ndarray):
        self.sizes, taken, left = [], [], keys
        while len(left):
            size = max(64, SPARSE * len(left))
            slot = self.slot(left, len(self.sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            self.sizes.append(size)
            taken.append(alone)
            left = left[~alone[slot]]
        self.taken = np.concatenate([np.zeros(0, bool), *taken])
        self.before = np.cumsum(self.taken) - self.taken

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; -1 or any index for a key that wasn't given."""
        out, open_, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.slot(keys[open_], level, size)
            hit = self.taken[at]
            out[open_[hit]] = self.before[at[hit]]
            open_, base = open_[~hit], base + size
        return out


def digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs."""
    p, q = powers(BASE, len(raw)), powers(BACK, len(raw))
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=h[1:])
    return mix((h[end] - h[begin]) * q[begin] + (end - begin).astype(np.uint64))


def gathered(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs, on end."""
    ends = np.cumsum(size)
    return raw[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes and decodes by the lines ``base64 rank`` of a rank file, which must hold all single bytes."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        if not all(bytes([i]) in self.ranks for i in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        tokens = list(self.ranks)
        size = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        begin = np.cumsum(size) - size
        keys = digests(raw, begin, begin + size)
        self.index = PerfectHash(keys)
        place = np.argsort(self.index(keys))
        self.raw, self.begin, self.size = raw, begin[place], size[place]
        self.id = np.array(list(self.ranks.values()), np.int64)[place]
        self.by_id = np.full(self.id.max() + 1, -1)
        self.by_id[self.id] = np.arange(len(place))
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def whole(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ids of the runs that are tokens, else -1: the hash names one token, whose bytes are compared."""
        size = end - begin
        at = self.index(digests(raw, begin, end))
        hit = np.flatnonzero((at >= 0) & (self.size[at] == size))
        out = np.full(len(begin), -1)
        if len(hit):
            n, token = size[hit], at[hit]
            same = gathered(raw, begin[hit], n) == gathered(self.raw, self.begin[token], n)
            good = np.logical_and.reduceat(same, np.cumsum(n) - n)
            out[hit[good]] = self.id[token[good]]
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token: the pair of lowest rank merges first, the leftmost of equals, until no pair has a rank."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the run at i ends where the next one begins
        alive = bytearray(b"\1") * n
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (rank := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (rank, h, end))
        return tuple(ranks[piece[i : after[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """int64 ids of all texts on end and len(texts) + 1 offsets. Null is empty; strings of special tokens are text."""
        parts = [s for t in texts for s in spans(t or "")]
        of = np.repeat(np.arange(len(texts)), [1 if len(t or "") <= SPAN else sum(1 for _ in spans(t)) for t in texts]) if texts else np.zeros(0, np.int64)
        ids, counts = [], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):
            to, held = at + 1, len(parts[at])
            while to < len(parts) and held + len(parts[to]) <= SPAN:
                held += len(parts[to])
                to += 1
            got, ends = self._encode(parts[at:to])
            ids.append(got)
            np.add.at(counts, of[at:to], np.diff(ends))
            at = to
        return np.concatenate([np.zeros(0, np.int64), *ids]), np.r_[0, np.cumsum(counts)]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(parts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(parts) + 1, np.int64)
        points, raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.frombuffer(joined.encode(), np.uint8)
        lengths = np.array([len(p) for p in parts])
        first = np.cumsum(lengths) - lengths
        edge = np.zeros(len(points), bool)
        edge[first[lengths > 0]] = True
        at = np.flatnonzero(starts(points, edge))
        byte = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]
        begin, end = byte[at], np.r_[byte[at[1:]], byte[-1]]
        token = self.whole(raw, begin, end)
        size = np.ones(len(token), np.int64)
        missed = np.flatnonzero(token < 0)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        data, merged = raw.tobytes(), []
        for a, b in zip(begin[missed].tolist(), end[missed].tolist(), strict=True):
            piece = data[a:b]
            found = self.seen.get(piece)
            if found is None:
                found = self.seen[piece] = self.merge(piece)
            merged.append(found)
        size[missed] = [len(m) for m in merged]
        ends = np.r_[0, np.cumsum(size)]
        out = np.empty(ends[-1], np.int64)
        out[ends[:-1][token >= 0]] = token[token >= 0]
        if merged:
            n = size[missed]
            last = np.cumsum(n)
            out[np.repeat(ends[:-1][missed] - last + n, n) + np.arange(last[-1])] = [i for m in merged for i in m]
        return out, np.r_[ends[np.searchsorted(at, first)], ends[-1]]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        place = self.by_id[ids]
        if len(place) and place.min() < 0:
            raise ValueError("an id that the rank file doesn't have")
        ends = np.r_[0, np.cumsum(self.size[place])]
        raw, at = gathered(self.raw, self.begin[place], self.size[place]).tobytes(), ends[offs].tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(lines: bytes) -> Codec:
    return Codec(lines)


@lru_cache(maxsize=2)
def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """For ids up to most: their digits and a comma, right-aligned, and how many of these bytes count."""
    ids, width = np.arange(most + 1), len(str(most))
    digits = (ids[:, None] // 10 ** np.arange(width - 1, -1, -1)) % 10 + 48
    return np.c_[digits, np.full(most + 1, 44)].astype(np.uint8), np.array([len(str(i)) for i in ids]) + 1


def joined(ids: np.ndarray, most: int) -> bytes:
    """Decimal ids joined by commas."""
    text, size = decimals(most)
    keep = np.arange(text.shape[1]) >= text.shape[1] - size[ids][:, None]
    return text[ids][keep].tobytes()[:-1]


def shipped(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The rank file's bytes (its size is the vocabulary's) for the executors. A path that isn't one of the driver's machine
    is read by Spark."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return spark.sparkContext.broadcast(f.read())
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def encode_column(docs: DataFrame, ranks: str, column: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with an array<int> of the ids of a whole text column in a column ``out``, which it replaces if there.

    Null and empty texts get an empty array, repeated rows equal ones, an empty table none. Each row is encoded by itself
    on its partition; nothing is shuffled.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(None).cast("array<int>")).schema
    held = shipped(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for part in pieces(batches, column, BATCH_BYTES):
            ids, offs = c.encode(part.column(column).to_pylist())
            made = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode_column(docs: DataFrame, ranks: str, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes (binary, which a cut sequence of ids may leave invalid as text) of an array<int> column; a null
    array decodes to none."""
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(b"").cast("binary")).schema
    held = shipped(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                part = whole.slice(a, 256)
                lists = [np.asarray(x if x is not None else [], np.int64) for x in part.column(column).to_pylist()]
                offs = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
                made = pa.array(c.decode(np.concatenate([np.zeros(0, np.int64), *lists]), offs), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op12_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and the digest of what the ids decode to."""
    held = shipped(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part in pieces(batches, "text", BATCH_BYTES):
            ids, offs = c.encode(part.column("text").to_pylist())
            own = [sha(joined(ids[a:b], len(c.by_id) - 1)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            back = [sha(data) for data in c.decode(ids, offs)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(own), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
