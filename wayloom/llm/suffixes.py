"""Repeated byte strings across documents, by enhanced suffix arrays over anchored contexts.

Every 200-byte window picks an anchor: the 64-byte gram of least hash in it. Equal windows pick equal grams at equal
places, so all occurrences of a repeated window meet in the index list of its gram. The windows of one anchor are
consecutive; together with the byte before them they are its context, some 270 bytes.

1. Grams are dealt with a hash of their context's windows, equal contexts of a batch once. Grams met once can't repeat.
2. The contexts of a gram that is met again are dealt with their bytes, equal ones of a batch once, with all their places. A
   suffix array of the windows of each gram's contexts is built by prefix doubling, with the common prefixes of
   neighbours; a context of several places is a leaf that stands there twice. A stack scan yields the intervals of common
   prefixes of 200 bytes and more, and those whose occurrences have different bytes to the left, or start a context, are
   the repeats that can't be extended to the left. Every repeated window lies in one, so their occurrences are the spans.
3. The spans of a document are joined back and cut out.

A gram of very many contexts (a notice between ever other neighbours) is no group of its own: its windows are dealt by
themselves, by a hash of their 200 bytes, so only those meet that are equal, and equal ones are pre-aggregated.

Grams travel packed, a row per (map batch, bucket).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BACK, BASE, Scratch, deal_out, mix, pieces, powers, release, strings, table, unpack, unused

WIDTH, GRAM = 200, 64
BATCH_BYTES, SPAN = 4 << 20, 1 << 20
#: Grams a bucket holds, about; bytes of contexts that a bucket holds, about.
BUCKET_GRAMS, BUCKET_BYTES = 200_000, 4 << 20
#: Different contexts from which a gram's windows are dealt one by one, and how many such grams are told apart, the most
#: frequent first; one of so many contexts is counted for that, by its hash, so counts of all tasks add up. Any choice gives
#: the same result.
HOT_CONTEXTS, HOT_GRAMS, COUNTED = 5_000, 1 << 19, 32


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array known."""
    return known[np.searchsorted(known, values).clip(max=len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def anchors(raw: np.ndarray, offs: np.ndarray, hot: np.ndarray | None = None, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window, hash of all their bytes) of each run of windows with one anchor; windows lie
    within a document. The windows of hot grams stand alone, under the hash of their bytes in place of the gram's."""
    n, reach = len(raw), width - gram + 1
    valid = np.zeros(n + 1, np.int32)
    size = np.diff(offs)
    has = size >= width
    np.add.at(valid, offs[:-1][has], 1)
    np.add.at(valid, (offs[1:] - width + 1)[has], -1)
    valid = np.cumsum(valid)[:n] > 0
    p, q = powers(BASE, SPAN + width), powers(BACK, SPAN + width)
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, n, SPAN):
        part = raw[s : s + SPAN + width - 1]
        ok = valid[s : s + SPAN]
        if len(part) < width or not ok.any():
            continue
        h = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=h[1:])
        g = mix((h[gram:] - h[:-gram]) * q[: len(part) - gram + 1])
        m = len(g)
        rows = -(-m // reach)
        low = np.full(rows * reach, np.uint64(2**64 - 1))
        low[:m] = g & ~np.uint64(0xFFFFFF) | np.arange(m, dtype=np.uint64)
        low = low.reshape(rows, reach)
        ahead = np.minimum.accumulate(low, axis=1).ravel()
        behind = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].ravel()
        at = np.minimum(behind[: m - reach + 1], ahead[reach - 1 : m]) & np.uint64(0xFFFFFF)
        at, ok = at[: len(ok)].astype(np.int64), ok[: len(at)]
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        last = ok.copy()
        last[:-1] &= (at[1:] != at[:-1]) | ~ok[1:]
        first, end = np.flatnonzero(new), np.flatnonzero(last)
        key = g[at[first]]
        if hot is not None and (lone := among(key, hot)).any():
            n_windows = (end - first + 1)[lone]
            every = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + np.repeat(first[lone], n_windows)
            first, end = np.concatenate([first[~lone], every]), np.concatenate([end[~lone], every])
            key = np.concatenate([key[~lone], mix((h[every + width] - h[every]) * q[every] + np.uint64(WIDTH))])
        whole = mix((h[end + width] - h[first]) * q[first] + (end - first).astype(np.uint64))
        found.append((key, first + s, end + s, whole))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """starts ordered by the width bytes from each, and whether each agrees in all of them with the one before it.

    Ranks of 8 bytes come from the bytes themselves and double up to the largest power of two below the width; two
    overlapping ranks then cover it.
    """
    n = len(text)
    padded = np.zeros(n + width + 8, np.uint8)
    padded[:n] = text
    block = np.zeros(n, np.uint64)
    for k in range(8):
        block = block << np.uint64(8) | padded[k : k + n]
    _, rank = np.unique(block, return_inverse=True)
    size = 8
    while size * 2 <= width:
        more = np.zeros(n, np.int64)
        more[: n - size] = rank[size:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 2) + more, return_inverse=True)
        size *= 2
    key = rank[starts].astype(np.int64) * (n + 2) + rank[starts + width - size]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    return starts[order], same


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it; both are known to share width bytes."""
    out = np.full(len(order), width, np.int64)
    out[:1] = 0
    live = np.arange(1, len(order))
    while live.size:
        a, b = order[live] + out[live], order[live - 1] + out[live]
        ok = (a < ends[live]) & (b < ends[live - 1])
        live, a, b = live[ok], a[ok], b[ok]
        live = live[text[a] == text[b]]
        out[live] += 1
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of the common-prefix tree of at least that length, children first."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        left = i - 1
        while stack[-1][0] > now:
            length, left = stack.pop()
            if length >= least:
                yield length, left, i - 1
        if stack[-1][0] < now:
            stack.append((now, left))


def ordered(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of the suffixes text[start:end]; a suffix comes before those it is a prefix of."""
    size = ends - starts
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    keys = [size]
    for a in range((int(size.max(initial=0)) + 7) // 8 * 8 - 8, -1, -8):
        block = np.zeros(len(starts), np.uint64)
        for k in range(a, a + 8):
            block = block << np.uint64(8) | np.where(k < size, padded[np.minimum(starts + k, len(text))], np.uint8(0))
        keys.append(block)
    return np.lexsort(keys)


def repeats(contexts: list[bytes], groups: np.ndarray, times: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(context, window, intervals) of distinct contexts (a byte to the left, then windows), where groups is the gram of
    each and times the number of its places; only contexts of one gram can share windows.

    context and window are those of the suffixes that start a repeat, in the order of the suffix array; an interval
    (length, first, last) is a group of them that shares length bytes, no more, and has different bytes to the left. The
    first window of a context counts as having another byte to its left than any other, as it may go on in another one. Of
    a context of several places the suffix from its first window, the only one whose places may differ to the left, stands
    there twice, next to itself, with all of its bytes in common.
    """
    order = np.argsort(groups, kind="stable")
    size = np.bincount(np.unique(groups, return_inverse=True)[1], minlength=1)
    size = np.repeat(size, size)
    # Windows of one context are never equal, so where a gram has no other one its first window is all there is to sort.
    alone = order[(size == 1) & (times[order] > 1)]
    context, window, lcp, left, first = _shared(contexts, order[size > 1], times, width)
    n = len(alone)
    context, window = np.concatenate([context, alone]), np.concatenate([window, np.zeros(n, np.int64)])
    lcp, left, first = np.concatenate([lcp, np.zeros(n, np.int64)]), np.concatenate([left, np.zeros(n, np.uint8)]), np.concatenate([first, np.ones(n, bool)])
    twice = first & (times[context] > 1)
    at = np.repeat(np.arange(len(context)), 1 + twice)
    copy = np.r_[False, at[1:] == at[:-1]][: len(at)]
    whole = np.array([len(c) - 1 for c in contexts], np.int64)
    context, window, left, first = context[at], window[at], left[at], first[at]
    lcp = np.where(copy, whole[context], lcp[at])
    changes = np.r_[0, np.cumsum((left[1:] != left[:-1]) | first[1:] | first[:-1])]
    found = [(m, i, j) for m, i, j in intervals(lcp.tolist(), width) if changes[j] > changes[i]] if len(lcp) else []
    return context, window, found


def _shared(contexts: list[bytes], order: np.ndarray, times: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(context, window, common prefix with the one before, byte to the left, whether it is the context's first) of the
    suffixes of the contexts in order, gram by gram, whose windows recur and aren't mere shifts of others."""
    none = np.zeros(0, np.int64)
    empty = none, none, none, np.zeros(0, np.uint8), np.zeros(0, bool)
    if not len(order):
        return empty
    text = np.frombuffer(b"".join(contexts[i] for i in order), np.uint8)
    length = np.array([len(contexts[i]) for i in order])
    at = np.cumsum(length) - length
    n = length - width
    owner = np.repeat(np.arange(len(order)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[owner] + 1
    sa, same = suffix_array(text, starts, width)
    where = np.searchsorted(at, sa, "right") - 1
    first = sa == at[where] + 1
    hit = same | first & (times[order[where]] > 1)
    hit[:-1] |= same[1:]
    sa, same, where, first = sa[hit], same[hit], where[hit], first[hit]
    if not len(sa):
        return empty
    # Runs that share width bytes; where all have one byte to the left, they are shifts of a run that is kept.
    head, left = np.flatnonzero(~same), text[sa - 1]
    diverse = (np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head)) | np.logical_or.reduceat(first, head)
    run = np.cumsum(~same) - 1
    keep = diverse[run]
    sa, where, run, first = sa[keep], where[keep], run[keep], first[keep]
    ends = at[where] + length[where]
    # Within a run the longer common prefixes need the full order.
    own = ordered(text, sa + width, ends)
    own = own[np.argsort(run[own], kind="stable")]
    sa, where, run, first, ends = (x[own] for x in (sa, where, run, first, ends))
    lcp = common_prefixes(text, ends, sa, width)
    lcp[np.r_[True, run[1:] != run[:-1]]] = 0
    return order[where], sa - at[where] - 1, lcp, text[sa - 1], first


def _hot_grams(docs: DataFrame) -> np.ndarray:
    """The grams of very many different contexts, a bounded number, ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", BATCH_BYTES):
            g, _, _, whole = anchors(*strings(part.column("text")))
            counted = mix(whole) % np.uint64(COUNTED) == 0
            both = np.unique(np.stack([g[counted], whole[counted]]), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["gram", "whole"])

    sums = docs.select("text").mapInArrow(count, "gram long, whole long").distinct().groupBy("gram").count().where(F.col("count") >= HOT_CONTEXTS // COUNTED)
    few = sums.orderBy(F.desc("count"), "gram").limit(HOT_GRAMS).select("gram").toPandas()
    return np.sort(few["gram"].to_numpy(np.int64).view(np.uint64))


def _grams(docs: DataFrame, n_buckets: int, hot: np.ndarray, settle: bool = True) -> DataFrame:
    """Packed (gram, context hash, uid, first window, bytes, times). Of contexts met again in their batch one goes on for
    two; the others are known to recur and travel by document, so a very common passage makes no large group: with times
    -1, that their bytes are needed, or with times 0 where one window is all there is, which is settled by its hash.
    Without settle all go on."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", BATCH_BYTES):
            raw, offs = strings(part.column("text"))
            g, first, last, whole = anchors(raw, offs, hot)
            if not len(g):
                continue
            order = np.lexsort((whole, g))
            g, whole, first, last = g[order], whole[order], first[order], last[order]
            new = np.r_[True, (g[1:] != g[:-1]) | (whole[1:] != whole[:-1]) | (not settle)]
            times = np.where(np.r_[~new[1:], False], 2, 1)[new]
            # Settled windows are next to each other: one row per stretch. Rows are set apart, that none spans two.
            row = np.searchsorted(offs, first, "right") - 1
            single = last == first
            done = union((first + row)[~new & single], (last + WIDTH + row)[~new & single])
            again = ~new & ~single
            of = np.searchsorted(offs + np.arange(len(offs)), done[:, 0], "right") - 1
            uid = part.column("uid").to_numpy()
            none, more = np.zeros(len(done), np.int64), np.zeros(again.sum(), np.int64)
            columns = [
                np.concatenate([g[new].view(np.int64), none, g[again].view(np.int64)]), np.concatenate([whole[new].view(np.int64), none, more]),
                np.concatenate([uid[row[new]], uid[of], uid[row[again]]]), np.concatenate([(first - offs[row])[new], done[:, 0] - of - offs[of], more]),
                np.concatenate([(last - first + WIDTH)[new], done[:, 1] - done[:, 0], more]), np.concatenate([times, none, more - 1]),
            ]
            by_doc = mix(np.concatenate([uid[of], uid[row[again]]]).astype(np.uint64))
            key = (np.concatenate([g[new], by_doc]) % np.uint64(n_buckets)).astype(np.int64)
            out = list(deal_out(columns, key))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["key", "blob"])

    return docs.mapInArrow(deal, "key long, blob binary")


def _by_uid(uid: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(uid, kind="stable")
    uid, columns = uid[order], [c[order] for c in columns]
    cuts = np.r_[0, np.flatnonzero(uid[1:] != uid[:-1]) + 1, len(uid)] if len(uid) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(uid[a]), [c[a:b] for c in columns]


def _met(pdf: pd.DataFrame, settle: bool = True) -> pd.DataFrame:
    """(uid, grams, spans): a document's grams whose contexts are needed in full, as the gram recurs, and the places of
    contexts of one window, which the hash tells to be repeated.

    Without settle all contexts of repeated grams are needed and no spans are told.
    """
    g, whole, uid, at, size, times = unpack(pdf["blob"].tolist(), 6)
    done, again = times == 0, times < 0
    spans, asked = [(uid[done], at[done], at[done] + size[done])], (uid[again], g[again])
    keep = times > 0
    g, whole, uid, at, size, times = (x[keep] for x in (g, whole, uid, at, size, times))
    order = np.lexsort((whole, g))
    g, whole, uid, at, size, times = (x[order] for x in (g, whole, uid, at, size, times))
    new_g = np.r_[True, g[1:] != g[:-1]][: len(g)]
    new_c = new_g | np.r_[True, whole[1:] != whole[:-1]][: len(g)]
    of_g, of_c = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
    n_g, n_c = np.bincount(of_g, times).astype(np.int64), np.bincount(of_c, times).astype(np.int64)
    same = n_c[of_c] > 1
    if settle:
        told = same & (size == WIDTH)
        spans.append((uid[told], at[told], at[told] + size[told]))
        kinds = np.bincount(of_g, new_c) > 1
        need = np.where(told, new_c & kinds[of_g], n_g[of_g] > 1)
    else:
        need = n_g[of_g] > 1
    rows = [(u, np.unique(x).tobytes(), None) for u, (x,) in _by_uid(np.concatenate([uid[need], asked[0]]), np.concatenate([g[need], asked[1]]))]
    rows += [(u, None, union(*x).tobytes()) for u, x in _by_uid(*(np.concatenate(c) for c in zip(*spans, strict=True)))] if settle else []
    return pd.DataFrame(rows, columns=["uid", "grams", "spans"]).astype({"uid": "int64"})


def _contexts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(key, gram, context, at): contexts of repeated grams, equal ones of a batch once.

    at: bytes of (uid, first window, 0) per occurrence.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", BATCH_BYTES):
            raw, offs = strings(part.column("text"))
            g, first, last, _ = anchors(raw, offs)
            row = np.searchsorted(offs, first, "right") - 1
            wanted = [np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in lists])) if lists else np.zeros(0, np.int64) for lists in part.column("grams").to_pylist()]
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            uid = part.column("uid").to_numpy()
            data = raw.tobytes()
            found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = defaultdict(list)
            for r in range(part.num_rows):
                a, b = cuts[r], cuts[r + 1]
                if a == b or not len(wanted[r]):
                    continue
                own = g[a:b].astype(np.int64)
                for i in np.flatnonzero(wanted[r][np.searchsorted(wanted[r], own).clip(max=len(wanted[r]) - 1)] == own) + a:
                    s, e = int(first[i]), int(last[i])
                    before = data[s - 1 : s] if s > offs[r] else b"\0"
                    found[int(g[i]), before + data[s : e + WIDTH]].append((int(uid[r]), s - int(offs[r]), 0))
            if not found:
                continue
            gram = np.array([k for k, _ in found], np.uint64)
            columns = [pa.array((gram % np.uint64(n_buckets)).astype(np.int64)), pa.array(gram.astype(np.int64)), pa.array([c for _, c in found], pa.binary()), pa.array([np.array(x, np.int64).tobytes() for x in found.values()], pa.binary())]
            whole = pa.RecordBatch.from_arrays(columns, ["key", "gram", "context", "at"])
            for x in range(0, whole.num_rows, 20_000):
                yield whole.slice(x, 20_000)

    return docs.mapInArrow(deal, "key long, gram long, context binary, at binary")


def _classes(pdf: pd.DataFrame) -> tuple[list[tuple[int, bytes]], list[np.ndarray]]:
    """The distinct (gram, context) of a bucket and the (uid, first window) of all places of each."""
    classes: dict[tuple[int, bytes], list[np.ndarray]] = defaultdict(list)
    for g, c, where in zip(pdf["gram"], pdf["context"], pdf["at"], strict=True):
        classes[g, c].append(np.frombuffer(where, np.int64).reshape(-1, 3)[:, :2])
    return list(classes), [np.concatenate(x) for x in classes.values()]


def _spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """(uid, spans) of a bucket: spans are bytes of (start, end) pairs, the occurrences of its intervals."""
    keys, places = _classes(pdf)
    context, window, found = repeats(*_leaves(keys, places))
    most = np.zeros(len(context), np.int64)
    for length, i, j in sorted(found):
        most[i : j + 1] = length  # of nested intervals the longest covers what the others do
    most[1:][(context[1:] == context[:-1]) & (window[1:] == window[:-1])] = 0  # a leaf that stands there twice
    context, window, length = context[most > 0], window[most > 0], most[most > 0]
    n = np.array([len(places[k]) for k in context], np.int64)
    uid, start = np.concatenate([np.zeros((0, 2), np.int64), *(places[k] for k in context)]).T
    start = start + np.repeat(window, n)
    rows = [(u, union(*x).tobytes()) for u, x in _by_uid(uid, start, start + np.repeat(length, n))]
    return pd.DataFrame(rows, columns=["uid", "spans"]).astype({"uid": "int64"})


def _leaves(keys: list[tuple[int, bytes]], places: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    return [c for _, c in keys], np.array([g for g, _ in keys], np.int64), np.array([len(x) for x in places], np.int64)


def union(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes covered by [s, e), as rows (start, end)."""
    if not len(s):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    far = np.maximum.accumulate(e)
    new = np.r_[True, s[1:] > far[:-1]]
    return np.stack([s[new], far[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]], axis=1)


def repeated_spans(docs: DataFrame, scratch: Scratch, column: str = "text", id_column: str = "doc_id", parts: str = "_parts") -> DataFrame:
    """docs (all columns) with a column ``parts``, which spans_of turns into the maximal runs of bytes of the UTF-8 text
    covered by a 200-byte string that also starts anywhere else in the table, same document included.

    Null texts are empty; texts under 200 bytes have none. Rows that repeat an id are documents of their own, and rows
    that repeat a whole document cover each other. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    uid = F.xxhash64(F.col(id_column), text)
    few = docs.select(uid.alias("uid"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    n_grams = total * 2 // (WIDTH - GRAM) + 1
    schema = "uid long, grams binary, spans binary"
    dealt = _grams(few, max(240, n_grams // BUCKET_GRAMS), _hot_grams(few))
    met = scratch.save(dealt.groupBy("key").applyInPandas(lambda k, p: _met(p), schema))
    release(docs.sparkSession)
    lists = met.where("grams is not null").groupBy("uid").agg(F.collect_list("grams").alias("grams"))
    # Rows equal in id and text share a uid and cover each other; the bytes of one are enough.
    size = met.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    bucketed = _contexts(few.join(lists, "uid"), max(240, size // 8 * 340 // BUCKET_BYTES)).groupBy("key").applyInPandas(lambda k, p: _spans(p), "uid long, spans binary")
    spans = scratch.save(bucketed)
    release(docs.sparkSession)
    known = met.where("spans is not null").select("uid", "spans").unionByName(spans)
    mark = unused(docs, "_uid")
    per_doc = known.groupBy(F.col("uid").alias(mark)).agg(F.collect_list("spans").alias(parts))
    return docs.withColumn(mark, uid).join(per_doc, mark, "left").drop(mark)


def spans_of(parts: list[bytes] | None) -> np.ndarray:
    if not parts:
        return np.zeros((0, 2), np.int64)
    every = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in parts])
    return union(every[:, 0], every[:, 1])


def cut(data: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for s, e in spans.tolist():
        out.append(data[at:s])
        at = e
    out.append(data[at:])
    return b"".join(out)


def dedup_repeats(docs: DataFrame, scratch: Scratch, column: str = "text") -> DataFrame:
    """docs with repeated bytes cut out of the text and n_chars, where there is such a column, brought up to date.

    Bytes of a character that is only partly covered go with it, so the text stays valid. Null texts stay null. Other
    columns pass, whatever their names.
    """
    schema, parts = docs.schema, unused(docs, "_parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, column, BATCH_BYTES):
            texts = []
            for text, spans in zip(part.column(column).to_pylist(), part.column(parts).to_pylist(), strict=True):
                texts.append(None if text is None else cut(text.encode(), spans_of(spans)).decode("utf-8", "ignore"))
            made = {column: pa.array(texts, pa.string())}
            if "n_chars" in schema.names:
                made["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in schema.names], schema.names)

    return repeated_spans(docs, scratch, column, parts=parts).mapInArrow(run, schema)


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """(uid, starts) of a bucket: bytes of (start, window hash) pairs where a maximal repeat may start, as the occurrences
    of these 200 bytes have different bytes, or none, to the left."""
    keys, places = _classes(pdf)
    context, window, found = repeats(*_leaves(keys, places))
    opens = np.array([(x[:, 1] == 0).any() for x in places], bool)  # whether a place is the start of a document
    runs = [np.unique(np.arange(i, j + 1)) for length, i, j in found if length >= WIDTH]
    wanted: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
    for run in runs:
        for k, w in zip(context[run].tolist(), window[run].tolist(), strict=True):
            wanted[keys[k][1][w + 1 : w + 1 + WIDTH]].add((k, w))
    out = []
    for said, members in wanted.items():
        left = {keys[k][1][w] for k, w in members}
        if len(left) > 1 or any(w == 0 and opens[k] for k, w in members):
            name = int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little", signed=True)
            out += [(u, p + w, name) for k, w in members for u, p in places[k].tolist()]
    uid, start, name = np.array(out, np.int64).reshape(-1, 3).T
    rows = [(u, np.stack(x, axis=1).tobytes()) for u, x in _by_uid(uid, start, name)]
    return pd.DataFrame(rows, columns=["uid", "starts"]).astype({"uid": "int64"})


def _grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """(window, tail, repeat, length): the maximal repeats that start with one window and the tails that hold them."""
    tails = [bytes(t) for t in pdf["bytes"]]
    lefts, n = [set(x) for x in pdf["lefts"]], pdf["n"].to_numpy()
    text, size = np.frombuffer(b"".join(tails), np.uint8), np.array([len(t) for t in tails], np.int64)
    at = np.cumsum(size) - size
    order = ordered(text, at, at + size)
    lcp = common_prefixes(text, (at + size)[order], at[order], WIDTH).tolist()
    groups = [(m, i, j) for m, i, j in intervals(lcp, WIDTH)]
    inner = {i for m, i, j in groups if m == size[order[i]]}  # a tail that all of an interval share is no group of its own
    groups += [(int(size[k]), i, i) for i, k in enumerate(order) if n[k] > 1 and i not in inner]
    rows = []
    for length, i, j in groups:
        own = order[i : j + 1]
        left = set().union(*(lefts[k] for k in own))
        if len(left) > 1 or -1 in left:
            name = int.from_bytes(hashlib.blake2b(tails[own[0]][:length], digest_size=8).digest(), "little", signed=True)
            rows += [(pdf["window"].iat[0], pdf["tail"].iat[k], name, length) for k in own]
    return pd.DataFrame(rows, columns=["window", "tail", "repeat", "length"]).astype("int64")


def maximal_repeats(docs: DataFrame, scratch: Scratch, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(repeat, length, uid, start): every maximal repeat of 200 bytes or more, of any length, with all its occurrences.

    uid: xxhash64 of id and text, so rows that repeat both are one document here; repeat: a hash of the repeated bytes.
    A maximal repeat starts where the occurrences of 200 bytes have different bytes, or none, to the left. Those starts
    come from the intervals of the anchors' contexts; the text from each to the end of its repeated run is a tail, and the
    intervals of the common-prefix tree over the tails of one start are the maximal repeats. Equal tails are
    pre-aggregated; a task holds the different ones of one start.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    docs = docs.select(F.col(id_column), F.col(column)).distinct()
    few = docs.select(F.xxhash64(F.col(id_column), text).alias("uid"), text.alias("text"))
    met = _grams(few, 240, np.zeros(0, np.uint64), settle=False).groupBy("key").applyInPandas(lambda k, p: _met(p, settle=False), "uid long, grams binary, spans binary")
    lists = scratch.save(met).groupBy("uid").agg(F.collect_list("grams").alias("grams"))
    starts = _contexts(few.join(lists, "uid"), 240).groupBy("key").applyInPandas(lambda k, p: _starts(p), "uid long, starts binary")
    per_doc = scratch.save(starts).groupBy("uid").agg(F.collect_list("starts").alias("starts"))
    spans = repeated_spans(few.withColumnRenamed("uid", "_id"), scratch, "text", "_id")

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", BATCH_BYTES):
            for u, said, parts, lists in zip(*(part.column(c).to_pylist() for c in ("_id", "text", "_parts", "starts")), strict=True):
                data, runs = said.encode(), spans_of(parts)
                rows = []
                for start, window in np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in lists]), axis=0).tolist():
                    tail = data[start : runs[np.searchsorted(runs[:, 0], start, "right") - 1, 1]]
                    rows.append((window, int.from_bytes(hashlib.blake2b(tail, digest_size=8).digest(), "little", signed=True), tail, data[start - 1] if start else -1, u, start))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

    names = ["window", "tail", "bytes", "left", "uid", "start"]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()), strict=True)))
    placed = spans.join(per_doc, F.col("_id") == F.col("uid")).select("_id", "text", "_parts", "starts")
    placed = scratch.save(placed.mapInArrow(tails, "window long, tail long, bytes binary, left int, uid long, start long"))
    classes = placed.groupBy("window", "tail").agg(F.first("bytes").alias("bytes"), F.collect_set("left").alias("lefts"), F.count("*").alias("n"))
    grown = classes.groupBy("window").applyInPandas(lambda k, p: _grown(p), "window long, tail long, repeat long, length long")
    return placed.select("window", "tail", "uid", "start").join(grown, ["window", "tail"]).select("repeat", "length", "uid", "start")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", BATCH_BYTES):
            rows = []
            for text, parts in zip(part.column("text").to_pylist(), part.column("_parts").to_pylist(), strict=True):
                data = (text or "").encode()
                spans = spans_of(parts)
                kept = cut(data, spans)
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_spans(docs, Scratch(spark, "suffixes"))
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
