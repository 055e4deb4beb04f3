"""SentencePiece encoding and decoding of whole texts in numpy batches.

A batch's texts are cut into units that no piece crosses: a run of spaces with the word after it, or a line end. Distinct
units of one length form a matrix of code points and advance together: hashes of all substrings up to the longest piece
probe the sorted hashes of the pieces. Over that lattice run

* ``viterbi``: the segmentation of greatest total score; vectorised maxima over start positions store backpointers. This
  is how a unigram model encodes.
* ``merge``: repeatedly the best-scoring adjacent pair of each row, leftmost first. This is how a BPE model encodes, and
  Viterbi does not reproduce its ids.

``auto`` takes what the model file asks for.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, give_back, mix, pieces, powers, table

SPACE = "▁"
UNITS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Bytes of text handled at once, cells of one lattice.
BATCH_BYTES, CELLS = 6 << 20, 4 << 20
#: Units whose ids a worker remembers between batches; beyond, it starts anew.
REMEMBERED = 400_000
#: Characters from which a unit is merged alone, with a heap.
LONG_UNIT = 200


def default_model() -> str:
    """The vocabulary file that the queries use; any model of identity normalisation is taken as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, model: str | bytes):
        """model: the model file's path or its bytes."""
        from sentencepiece import sentencepiece_model_pb2

        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models of identity normalisation that keep white space are supported")
        kinds = model.SentencePiece
        self.prefix = norm.add_dummy_prefix
        self.own = "viterbi" if model.trainer_spec.model_type == model.trainer_spec.UNIGRAM else "merge"
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        plain = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        if any(SPACE in s.lstrip(SPACE) for _, s, _ in plain):
            raise ValueError("a piece crosses words")
        self.longest = max(len(s) for _, s, _ in plain)
        keys = np.array([self._key(s) for _, s, _ in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _, _ in plain], np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)  # which high bits of a hash any piece has
        self.maybe[self.keys >> np.uint64(44)] = True
        self.forget(())
        self.scores = np.zeros(len(model.pieces))
        self.scores[[i for i, _, _ in plain]] = [x for _, _, x in plain]
        self.unk_score = min(x for _, _, x in plain) - 10.0
        byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = [byte.get(f"<0x{b:02X}>", self.unk) for b in range(256)]
        values = {i: bytes([int(s[3:5], 16)]) for s, i in byte.items()}
        raw = [values[i] if i in values else b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]

    @staticmethod
    def _key(piece: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * BASE + np.uint64(ord(c) + 1)
            return int(mix(np.array([h + np.uint64(len(piece))]))[0])

    def lattice(self, codes: np.ndarray) -> np.ndarray:
        """(rows, start, length - 1) -> piece id or -1, of a matrix of code points."""
        n, size = codes.shape
        most, p = min(self.longest, size), powers(BASE, size)
        h = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            h[:, j + 1] = h[:, j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        out = np.full((n, size, most), -1, np.int32)
        for k in range(1, most + 1):
            key = mix(h[:, k:] - h[:, : size + 1 - k] * p[k] + np.uint64(k))
            r, i = np.nonzero(self.maybe[key >> np.uint64(44)])
            key = key[r, i]
            at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            out[r, i, k - 1] = np.where(self.keys[at] == key, self.ids[at], -1)
        return out

    def viterbi(self, ids: np.ndarray) -> np.ndarray:
        """Lengths of the chosen pieces by start position, 0 elsewhere."""
        n, size, most = ids.shape
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        for j in range(1, size + 1):
            ks = np.arange(1, min(most, j) + 1)
            own = ids[:, j - ks, ks - 1]
            score = np.where(own >= 0, self.scores[own], -np.inf)
            score[:, 0] = np.where(own[:, 0] >= 0, score[:, 0], self.unk_score)
            score += best[:, j - ks]
            k = score[:, ::-1].argmax(axis=1)  # of equal totals the longer last piece
            back[:, j] = len(ks) - k
            best[:, j] = score[np.arange(n), len(ks) - 1 - k]
        out, at = np.zeros((n, size), np.int64), np.full(n, size)
        while (live := np.flatnonzero(at > 0)).size:
            k = back[live, at[live]]
            at[live] -= k
            out[live, at[live]] = k
        return out

    def merge_one(self, ids: np.ndarray) -> np.ndarray:
        """merge for a single long unit, with a heap of pairs."""
        size, most = ids.shape
        out, before = np.ones(size, np.int64), list(range(-1, size - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            to = i + out[i]
            if i >= 0 and to < size and (both := int(out[i] + out[to])) <= most and ids[i, both - 1] >= 0:
                heappush(heap, (-self.scores[ids[i, both - 1]], i, int(out[i]), both))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, was, both = heappop(heap)
            if out[i] == was and out[i + was] == both - was:
                out[i], out[i + was] = both, 0
                if (to := i + both) < size:
                    before[to] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return out

    def merge(self, ids: np.ndarray) -> np.ndarray:
        n, size, most = ids.shape
        if size > LONG_UNIT:
            return np.stack([self.merge_one(x) for x in ids])
        out = np.ones((n, size), np.int64)
        live, at = np.arange(n), np.arange(size)
        while live.size:
            lengths, own = out[live], ids[live]
            to = np.minimum(at + lengths, size)
            both = lengths + np.where(to < size, np.take_along_axis(lengths, np.minimum(to, size - 1), 1), most)
            ok = (lengths > 0) & (both <= most)
            piece = np.take_along_axis(own, np.where(ok, both, 1)[:, :, None] - 1, 2)[:, :, 0]
            score = np.where(ok & (piece >= 0), self.scores[piece], -np.inf)
            i = score.argmax(axis=1)
            rows = np.arange(len(live))
            go = score[rows, i] > -np.inf
            live, i, both, to = live[go], i[go], both[rows, i][go], to[rows, i][go]
            out[live, i] = both
            out[live, to] = 0
        return out

    def encode_units(self, units: list[str], how: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each segmentation in how: token ids of all units on end, and len(units) + 1 offsets."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        found = [([], [], []) for _ in how]  # units, counts or positions, ids
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            step = max(1, CELLS // (int(length) * min(int(length), self.longest)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                codes = np.frombuffer("".join(units[r] for r in part).replace(" ", SPACE).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                ids = self.lattice(codes)
                for h, (unit, pos, token) in zip(how, found, strict=True):
                    lengths = getattr(self, h)(ids)
                    r, i = np.nonzero(lengths)
                    t = ids[r, i, lengths[r, i] - 1]
                    if (odd := np.flatnonzero(t < 0)).size:  # bytes of characters without a piece
                        spelt = [[self.byte_ids[b] for b in chr(codes[r[o], i[o]]).encode()] for o in odd]
                        times = np.ones(len(t), np.int64)
                        times[odd] = [len(s) for s in spelt]
                        r, i, t = np.repeat(r, times), np.repeat(i, times), np.repeat(t, times)
                        t[t < 0] = [b for s in spelt for b in s]
                    unit.append(part[r])
                    token.append(t)
        out = []
        for unit, _, token in found:
            unit, token = np.concatenate([np.zeros(0, np.int64), *unit]), np.concatenate([np.zeros(0, np.int32), *token])
            order = np.argsort(unit, kind="stable")
            out.append((token[order], np.r_[0, np.cumsum(np.bincount(unit, minlength=len(units)))]))
        return out

    def forget(self, how: tuple[str, ...]) -> None:
        self.how, self.seen = how, defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.known = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in how]

    def encode(self, texts: list[str | None], how: tuple[str, ...] = ("auto",)) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each segmentation in how: int32 ids of all texts on end, and len(texts) + 1 offsets. Null is empty."""
        how = tuple(self.own if h == "auto" else h for h in how)
        if how != self.how or len(self.seen) > REMEMBERED:
            self.forget(how)
        index, counts, before = [], np.zeros(len(texts), np.int64), len(self.seen)
        for k, text in enumerate(texts):
            if text:
                units = UNITS.findall((" " if self.prefix else "") + text.replace(SPACE, " "))
                counts[k] = len(units)
                index.append(np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units)))
        index = np.concatenate([np.zeros(0, np.int64), *index])
        at = np.r_[0, np.cumsum(counts)]
        if len(self.seen) > before:
            fresh = self.encode_units(list(islice(self.seen, before, None)), how)
            self.known = [(np.concatenate([t, u]), np.concatenate([o, o[-1] + v[1:]])) for (t, o), (u, v) in zip(self.known, fresh, strict=True)]
        out = []
        for token, offs in self.known:
            n = np.diff(offs)[index]
            ends = np.r_[0, np.cumsum(n)]
            out.append((token[np.repeat(offs[:-1][index] - ends[:-1], n) + np.arange(ends[-1])], ends[at]))
        return out

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """The texts of ids on end: bytes of the pieces on end, without the prefix space; invalid bytes are replaced."""
        n = np.diff(self.raw_at)[ids]
        ends = np.r_[0, np.cumsum(n)]
        raw = self.raw[np.repeat(self.raw_at[:-1][ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = ends[offs]
        return [raw[a + (self.prefix and raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def shipped(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The model file's bytes (its size is the vocabulary's, not the data's) for the executors, which needn't hold it. A
    path that isn't one of the driver's machine is read by Spark."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return spark.sparkContext.broadcast(f.read())
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def encode_column(docs: DataFrame, model: str, column: str = "text", out: str = "token_ids", how: str = "auto") -> DataFrame:
    """docs with an array<int> of token ids of a whole text column in a column ``out``, which it replaces if there.

    Null and empty texts get an empty array. Each row is encoded by itself on its partition; nothing is shuffled, and a
    batch holds about BATCH_BYTES of text or one longer text.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(None).cast("array<int>")).schema
    held = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for part in pieces(batches, column, BATCH_BYTES):
            ids, offs = c.encode(part.column(column).to_pylist(), (how,))[0]
            made = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])
        c.forget(c.how)
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode_column(docs: DataFrame, model: str, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the text of an array<int> column; null arrays decode to the empty text."""
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit("")).schema
    held = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                part = whole.slice(a, 256)
                lists = [np.asarray(x if x is not None else [], np.int64) for x in part.column(column).to_pylist()]
                offs = np.r_[0, np.cumsum([len(x) for x in lists])]
                made = pa.array(c.decode(np.concatenate([np.zeros(0, np.int64), *lists]), offs), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids of the Viterbi segmentation and of the model's own, digested, and whether decoding both returns the
    text. A text that holds U+2581 itself comes back with spaces in its place, as the model defines, so not the same."""
    held = shipped(spark, default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for part in pieces(batches, "text", BATCH_BYTES):
            texts = part.column("text").to_pylist()
            columns = [part.column("doc_id")]
            same = [True] * len(texts)
            for ids, offs in c.encode(texts, ("auto", "viterbi")):
                columns += [pa.array(np.diff(offs), pa.int64()), pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)])]
                same = [s and x == (t or "") for s, x, t in zip(same, c.decode(ids, offs), texts, strict=True)]
            columns.append(pa.array(same))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "n_viterbi", "viterbi_sha256", "round_trip"])
        c.forget(c.how)
        give_back()

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, n_viterbi long, viterbi_sha256 string, round_trip boolean")
