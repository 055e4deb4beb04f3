"""Jaccard join of documents on word shingles, by set-relation skipping.

Sets that are equal are one class. A class's index entries are the first |s| - ceil(t |s|) + 1 of its shingles in a global
order (shingles met often last, then by hash), so two sets with Jaccard >= t share an entry. Two relations save work:

* Within an index list, entries sorted by size and position form blocks of one size. A probe leaves the list at the first
  block whose sizes can't reach t, and jumps to the next block at the first position that can't (block skipping).
* Every class first links to one highly similar class, the one it shares most entries with (its leader, verified). What
  the leader's answers say about another leader bounds the answers of all its followers: |x & y| differs from
  |lx & ly| by at most |x - lx| + |y - ly|, where shingles of no other class needn't count; they are told over
  whole sets. Most pairs of groups are settled by one verified pair of leaders; only followers that the
  bound leaves open are verified themselves (answer derivation).

The result is exact: links that decide nothing new about components are the only ones not looked at. Index entries travel
packed, a row per (map batch, bucket), so JVM and shuffle see few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import Scratch, deal_out, mix, pieces, release, table, unpack, unused
from .shingles import shingle_sets, signatures

BATCH_BYTES = 2 << 20
#: Shingles met often that are put last in the order, at most. Any choice gives the same result.
HOT_SHINGLES, HOT_LOCAL = 1 << 17, 8
#: Entries that a bucket of index lists holds, about; salts that a list of a hot shingle is dealt over at first.
BUCKET_ENTRIES, SALTS = 300_000, 16
#: Pairs that a bucket gathers before it drops repeated ones.
MOST_PAIRS = 1_000_000


def row_key(column: str = "text") -> F.Column:
    """What tells rows apart: a 64-bit hash of doc_id and text, whether each is null or not."""
    return F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col(column), F.col(column).isNull())


def _hot(spark_docs: DataFrame, column: str) -> np.ndarray:
    """Shingles that some partition meets in many classes, the most frequent first, a bounded number; sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= HOT_LOCAL
            h, n = h[keep], n[keep]
            if len(h) > HOT_SHINGLES:
                top = np.argsort(-n, kind="stable")[:HOT_SHINGLES]
                h, n = h[top], n[top]
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

        for part in pieces(batches, column, BATCH_BYTES):
            h, offs = shingle_sets(part.column(column))
            cid, _ = signatures(h, offs)
            fresh = np.array([c not in seen and not seen.add(c) for c in cid.tolist()], bool)
            if len(seen) > 1_000_000:
                seen.clear()
            held.append(h[np.repeat(fresh, np.diff(offs))])
            size += len(held[-1])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    few = spark_docs.select(column).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).select("h").toPandas()
    return np.sort(few["h"].to_numpy(np.int64).astype(np.uint64))


def _entries(docs: DataFrame, column: str, t: Fraction, hot: np.ndarray) -> DataFrame:
    """(doc_id, uid, cid, n, common, entries, bits): common is the share of the set's shingles that are met often, in
    thousandths; entries are the set's index shingles as bytes, in the global order; bits is the
    parity of the set's shingles per hash value below a power of two about its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, column, BATCH_BYTES):
            h, offs = shingle_sets(part.column(column))
            cid, n = signatures(h, offs)
            row = np.repeat(np.arange(len(n)), n)
            late = hot[np.searchsorted(hot, h).clip(max=len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
            common = np.bincount(row, late, minlength=len(n)).astype(np.int64) * 1000 // np.maximum(n, 1)
            every = h
            h = h[np.argsort((2 * row + late).astype(np.uint16 if len(n) < 1 << 15 else np.uint32), kind="stable")]  # ascending in a row already
            take = n - -(-n * t.numerator // t.denominator) + (n > 0)
            at = np.arange(len(h)) - offs[row]
            h = h[at < take[row]]
            wide = np.left_shift(64, np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64))
            base = np.cumsum(wide) - wide
            low = (every & (wide[row] - 1).astype(np.uint64)).astype(np.int64) + base[row]
            odd = np.packbits(np.bincount(low, minlength=int(wide.sum())) & 1).tobytes()
            bits = pa.array([odd[a : a + w] for a, w in zip((base // 8).tolist(), (wide // 8).tolist(), strict=True)], pa.binary())
            ends = np.r_[0, np.cumsum(take)]
            raw = h.astype("<u8").tobytes()
            made = pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), pa.array(cid), pa.array(n, pa.int64()), pa.array(common), made, bits], ["doc_id", "uid", "cid", "n", "common", "entries", "bits"])

    return docs.select("doc_id", row_key(column).alias("uid"), column).mapInArrow(run, "doc_id long, uid long, cid long, n long, common long, entries binary, bits binary")


def _spread(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, position) of the packed entries of a batch."""
    lists = [np.frombuffer(x, "<u8") for x in part.column("entries").to_pylist()]
    n = np.array([len(x) for x in lists], np.int64)
    h = np.concatenate([np.zeros(0, np.uint64), *lists])
    row = np.repeat(np.arange(len(n)), n)
    return row, h, np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _leaders(index: DataFrame, hot: np.ndarray, n_buckets: int, t: Fraction) -> DataFrame:
    """(cid, leader, fits): classes and the heads of the index lists they are in, with the number of lists whose head is
    another class of a size that fits.

    The head of a list is the class with the greatest share of common shingles, then the smallest: the text that a group
    of near copies was made from has no shingles of its own, so it is near all of them, where two copies may be far
    apart. A hot shingle's list is dealt over salts here; texts of nothing but common shingles go to all of them. What
    that leaves apart, the second pass brings together.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _small(batches):
            cid, n, common = (part.column(c).to_numpy() for c in ("cid", "n", "common"))
            fresh = np.array([c not in seen and not seen.add(c) for c in cid.tolist()], bool)
            if len(seen) > 1_000_000:
                seen.clear()
            part = part.filter(pa.array(fresh))
            cid, n, common = cid[fresh], n[fresh], common[fresh]
            row, h, _ = _spread(part)
            late = hot[np.searchsorted(hot, h).clip(max=len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
            salt = np.where(late, mix(cid.astype(np.uint64))[row] % np.uint64(SALTS), np.uint64(0))
            far = np.flatnonzero(late & (common[row] == 1000))
            row, h = np.concatenate([row, np.repeat(row[far], SALTS)]), np.concatenate([h, np.repeat(h[far], SALTS)])
            salt = np.concatenate([salt, np.tile(np.arange(SALTS, dtype=np.uint64), len(far))])
            key = (mix(h + salt) % np.uint64(n_buckets)).astype(np.int64)
            # Lists of one shingle in different salts may meet in a bucket; the salt keeps them apart.
            out = list(deal_out([mix(h + salt * np.uint64(n_buckets)).astype(np.int64), cid[row], n[row], -common[row]], key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["key", "blob"])

    def vote(_, pdf: pd.DataFrame) -> pd.DataFrame:
        h, cid, n, rare = unpack(pdf["blob"].tolist(), 4)
        order = np.lexsort((cid, rare, h))
        h, cid, n = h[order], cid[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])
        h, cid, n = h[new], cid[new], n[new]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
        small, large = np.minimum(n, n[first]), np.maximum(n, n[first])
        fits = ~head & (small * t.denominator >= large * t.numerator)
        pairs = pd.DataFrame({"cid": cid[fits], "leader": cid[first[fits]], "fits": 1})
        return pairs.groupby(["cid", "leader"], as_index=False, sort=False)[["fits"]].sum()

    dealt = index.select("cid", "n", "common", "entries").mapInArrow(deal, "key long, blob binary")
    votes = dealt.groupBy("key").applyInPandas(lambda k, p: vote(k, p), "cid long, leader long, fits long")
    return votes.groupBy("cid", "leader").agg(F.sum("fits").alias("fits"))


def _skip_pairs(h, group, comp, low, high, pos, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups of different components that share a list and that size and position allow.

    Entries are sorted by list, smallest size and position; each probe i holds a cursor j into its list. low, high: sizes
    of the group's members; pos: their first position.
    """
    order = np.lexsort((pos, low, h))
    h, group, comp, low, high, pos = (x[order] for x in (h, group, comp, low, high, pos))
    n = len(h)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    block = np.ones(n + 1, bool)
    block[1:n] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(block)
    after = starts[np.searchsorted(starts, np.arange(n), "right")]  # first entry of the next block
    ends = np.ones(n + 1, bool)
    ends[1:n] = h[1:] != h[:-1]
    stops = np.flatnonzero(ends)
    end = stops[np.searchsorted(stops, np.arange(n), "right")]
    wide = np.r_[0, np.cumsum(high != low)]
    plain = wide[after] == wide[:-1]  # whether the rest of the block stands for sets of one size
    live, j = np.arange(n), np.arange(1, n + 1)
    a, b = [], []
    while True:
        ok = j < end[live]
        live, j = live[ok], j[ok]
        if not live.size:
            break
        ok = low[j] * t.numerator <= high[live] * t.denominator
        live, j = live[ok], j[ok]
        if not live.size:
            break
        need = -(-(low[live] + low[j]) * t.numerator // (t.numerator + t.denominator))
        can_i, can_j = high[live] - pos[live] >= need, high[j] - pos[j] >= need
        live, j, need, can_j = live[can_i], j[can_i], need[can_i], can_j[can_i]  # larger sets need more still
        fits = can_j & (comp[live] != comp[j])
        a.append(np.minimum(group[live[fits]], group[j[fits]]))
        b.append(np.maximum(group[live[fits]], group[j[fits]]))
        if sum(map(len, a)) > MOST_PAIRS:  # many lists hold one pair
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            a, b = [both[0]], [both[1]]
        # Positions ascend within a block of one size, so what follows there can't reach either.
        j = np.where(~can_j & plain[j], after[j], j + 1)
    return np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])


def _rivals(index: DataFrame, placed: DataFrame, hot: np.ndarray, n_buckets: int, t: Fraction) -> DataFrame:
    """(a, b): pairs of leaders whose groups share an index list and may hold a link between different components.

    placed: (cid, leader, component) of classes in groups; others lead themselves. Entries of one group are
    pre-aggregated to one per list before the shuffle. The list of a hot shingle is dealt over pairs of salts, so that any
    two of its entries meet, and no task has it whole.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches, 60_000):
            n, lead, comp = (part.column(c).to_numpy() for c in ("n", "leader", "component"))
            row, h, pos = _spread(part)
            h = h.astype(np.int64)
            order = np.lexsort((lead[row], h))
            row, h, pos = row[order], h[order], pos[order]
            g = lead[row]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            at = np.flatnonzero(new)
            if not len(at):
                continue
            columns = [h[at], g[at], comp[row][at], np.minimum.reduceat(n[row], at), np.maximum.reduceat(n[row], at), np.minimum.reduceat(pos, at)]
            late = np.flatnonzero(hot[np.searchsorted(hot, columns[0].view(np.uint64)).clip(max=len(hot) - 1)] == columns[0].view(np.uint64)) if len(hot) else np.zeros(0, np.int64)
            if len(late):
                own = (mix(columns[1][late].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
                own, other = np.repeat(own, SALTS), np.tile(np.arange(SALTS), len(late))
                lists = mix(np.repeat(columns[0][late], SALTS).view(np.uint64) + (np.minimum(own, other) * SALTS + np.maximum(own, other) + 1).astype(np.uint64)).view(np.int64)
                columns = [np.concatenate([np.delete(x, late), lists if k == 0 else np.repeat(x[late], SALTS)]) for k, x in enumerate(columns)]
            columns[2], columns[4] = columns[2] ^ columns[1], columns[4] - columns[3]  # zeros for a class that leads itself alone
            out = list(deal_out(columns, (mix(columns[0].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["key", "blob"])

    def meet(_, pdf: pd.DataFrame) -> pd.DataFrame:
        h, g, comp, low, high, pos = unpack(pdf["blob"].tolist(), 6)
        comp, high = comp ^ g, high + low
        order = np.lexsort((g, h))
        h, g, comp, low, high, pos = (x[order] for x in (h, g, comp, low, high, pos))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        a, b = _skip_pairs(h[at], g[at], comp[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(pos, at), t)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    own = index.select("cid", "n", "entries").join(placed, "cid", "left")
    own = own.select("n", "entries", F.coalesce("leader", "cid").alias("leader"), F.coalesce("component", "cid").alias("component"))
    return own.mapInArrow(deal, "key long, blob binary").groupBy("key").applyInPandas(lambda k, p: meet(k, p), "a long, b long").distinct()


def _sets(docs: DataFrame, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, column, BATCH_BYTES):
            h, offs = shingle_sets(part.column(column))
            own = pa.array(signatures(h, offs)[0] == part.column("cid").to_numpy())  # not another row of a repeated doc_id
            made = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("cid"), made], ["cid", "members"]).filter(own)

    return docs.select("cid", column).mapInArrow(run, "cid long, members array<long>")


def _most(index: DataFrame, docs: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """(cid, n, most) of each class: most, n less the shingles that no other class has anywhere in its set, bounds all of
    its overlaps. A shingle travels as 32 bits in its bucket, twice a batch at most; one that is taken for another counts
    as shared, which only loosens the bound.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in pieces(batches, column, BATCH_BYTES):
            h, offs = shingle_sets(part.column(column))
            cid, n = signatures(h, offs)
            fresh = np.repeat(np.array([c not in seen and not seen.add(c) for c in cid.tolist()], bool), n)
            if len(seen) > 1_000_000:
                seen.clear()
            h, cid = h[fresh], np.repeat(cid, n)[fresh]
            order = np.argsort(h)
            h, cid = h[order], cid[order]
            again = h[1:] == h[:-1]
            two = np.ones(len(h), bool)
            two[2:] = ~(again[1:] & again[:-1])
            h, cid = h[two], cid[two]
            if not len(h):
                continue
            key = (mix(h) % np.uint64(n_buckets)).astype(np.int64)
            names, at = np.unique(cid, return_inverse=True)
            order = np.argsort(key * len(names) + at)
            h, cid, key = h[order].astype("<u4"), cid[order], key[order]
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            blobs = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                one, times = np.unique(cid[x:y], return_counts=True)
                blobs.append(len(one).to_bytes(8, "little") + one.tobytes() + times.astype("<u4").tobytes() + h[x:y].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]]), pa.array(blobs, pa.binary())], ["key", "blob"])

    def count(_, pdf: pd.DataFrame) -> pd.DataFrame:
        owners, shingles = [], []
        for x in pdf["blob"]:
            m = int.from_bytes(x[:8], "little")
            owners.append(np.repeat(np.frombuffer(x, np.int64, m, 8), np.frombuffer(x, "<u4", m, 8 + 8 * m)))
            shingles.append(np.frombuffer(x, "<u4", offset=8 + 12 * m))
        cid, h = np.concatenate(owners), np.concatenate(shingles)
        order = np.argsort(h, kind="stable")
        h, cid = h[order], cid[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low, high = np.minimum.reduceat(cid, at), np.maximum.reduceat(cid, at)
        cid, own = np.unique(low[low == high], return_counts=True)
        return pd.DataFrame({"cid": cid, "own": own.astype(np.int64)})

    sets = index.groupBy("cid").agg(F.first("n").alias("n"))
    n_buckets = max(240, (sets.agg(F.sum("n")).first()[0] or 0) // (4 * BUCKET_ENTRIES) + 1)
    dealt = docs.where("doc_id is not null").select(column).mapInArrow(deal, "key long, blob binary")
    own = dealt.groupBy("key").applyInPandas(lambda k, p: count(k, p), "cid long, own long").groupBy("cid").agg(F.sum("own").alias("own"))
    sizes = scratch.save(sets.join(own, "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most")))
    release(docs.sparkSession)
    return sizes


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds differ: at least so many shingles are in one set only. Wider bits fold onto narrower ones."""
    for b in batches:
        out = np.zeros(b.num_rows, np.int64)
        for k, (x, y) in enumerate(zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            w = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(z.reshape(-1, w), axis=0) for z in (x, y))
            out[k] = np.bitwise_count(x ^ y).sum()
        keep = [c for c in b.schema.names if not c.startswith("bits_")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out)], [*keep, "differ"])


def _overlap(pairs: DataFrame, index: DataFrame, docs: DataFrame, column: str, scratch: Scratch, t: Fraction) -> DataFrame:
    """pairs (a, b, slack, least) with na, nb and the overlap of their sets, without pairs that can't matter: those whose
    overlap plus slack is short of t / (1 + t) x least (both null: 0 and na + nb).

    The bits, a hundredth of the sets, rule out most pairs; only the texts of the rest travel. A hot b is split by the
    skew join.
    """
    bits = index.groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    for x in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}")), x)
    kinds = pairs.drop("bits_a", "bits_b").withColumn("differ", F.lit(0).cast("long")).schema
    pairs = pairs.select(*[c for c in kinds.names if c != "differ"], "bits_a", "bits_b").mapInArrow(_apart, kinds)
    most = F.floor((F.col("na") + F.col("nb") - F.col("differ")) / 2) + F.coalesce("slack", F.lit(0))
    reach = F.coalesce("least", F.col("na") + F.col("nb")) * t.numerator
    pairs = scratch.save(pairs.where(most * (t.numerator + t.denominator) >= reach))
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    first = index.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    sets = scratch.save(_sets(docs.select("doc_id", column).join(first, "doc_id"), column).dropDuplicates(["cid"]))
    release(docs.sparkSession)
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b")
    met = scratch.save(both.withColumn("overlap", F.size(F.array_intersect("ma", "mb")).cast("long")).drop("ma", "mb", "differ"))
    scratch.drop(sets)
    scratch.drop(pairs)
    release(docs.sparkSession)
    return met


def jaccard_rows(docs: DataFrame, scratch: Scratch, column: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, uid, n_shingles, component_id, group), one row per row of docs: components of the exact Jaccard join.

    Lower-cases A-Z, takes words between ASCII white space and sets of distinct 5-word shingles of whole texts. Null and
    empty texts have no shingles, link with nothing and are their own component; a text of fewer words has one shingle.
    Equal sets are linked. Two sets link when their Jaccard similarity is at least threshold, compared in integers.
    component_id is the smallest doc_id reachable. Rows that repeat a doc_id are sets of their own, so two components may
    share a component_id; group tells them apart (null for rows that link with nothing). Rows without a doc_id link with
    nothing. uid is ``row_key``. Only doc_id and the text column are read. An empty table gives an empty result.
    """
    spark, t = docs.sparkSession, Fraction(*threshold)
    union = lambda c, d: F.col("overlap") * (t.numerator + t.denominator) >= (F.col(c) + F.col(d)) * t.numerator
    shared = lambda c, d, p, q: F.least(c, d) * (t.numerator + t.denominator) >= (F.col(p) + F.col(q)) * t.numerator
    hot = _hot(docs, column)
    every = scratch.save(_entries(docs, column, t, hot))
    index = every.where("doc_id is not null")
    total = index.agg(F.sum(F.length("entries"))).first()[0] or 0
    n_buckets = max(240, total // 8 // BUCKET_ENTRIES + 1)
    votes = _leaders(index, hot, n_buckets, t)
    best = scratch.save(votes.groupBy("cid").agg(F.max_by("leader", F.struct("fits", -F.col("leader"))).alias("leader")))
    none = F.lit(None).cast("long")
    release(spark)
    chosen = best.select(F.col("cid").alias("a"), F.col("leader").alias("b"), none.alias("slack"), none.alias("least"))
    led = _overlap(chosen, index, docs, column, scratch, t).where(union("na", "nb"))
    led = scratch.save(led.select(F.col("a").alias("cid"), F.col("b").alias("leader"), F.col("na").alias("n"), "overlap"))
    inner = components(led.select(F.col("cid").alias("a"), F.col("leader").alias("b")), scratch)
    placed = scratch.save(inner.join(led, inner.node == led.cid, "left").select(F.col("node").alias("cid"), F.coalesce("leader", "node").alias("leader"), "component", "overlap", "n"))
    rivals = scratch.save(_rivals(index, placed.select("cid", "leader", "component"), hot, n_buckets, t))
    release(spark)
    sizes = _most(index, docs, column, scratch)
    # apart: shingles that the leader lacks and other sets may have.
    near = scratch.save(placed.where("n is not null").join(sizes.select("cid", "most"), "cid").select("cid", "leader", "component", "n", "most", (F.col("most") - F.col("overlap")).alias("apart")))
    # How far a group's followers are from their leader, how small they are and what they share with any set at most.
    reach = near.groupBy("leader").agg(F.max("apart").alias("d"), F.min("n").alias("s"), F.max("most").alias("m"))
    for x in ("a", "b"):
        rivals = rivals.join(sizes.select(F.col("cid").alias(x), F.col("n").alias(f"own{x}"), F.col("most").alias(f"most{x}")), x)
        rivals = rivals.join(reach.select(F.col("leader").alias(x), F.col("d").alias(f"d{x}"), F.col("s").alias(f"s{x}"), F.col("m").alias(f"m{x}")), x, "left")
        rivals = rivals.withColumns({f"d{x}": F.coalesce(f"d{x}", F.lit(0)), f"s{x}": F.least(F.coalesce(f"s{x}", f"own{x}"), f"own{x}"), f"m{x}": F.greatest(F.coalesce(f"m{x}", f"most{x}"), f"most{x}")})
    asked = scratch.save(rivals.where(shared("ma", "mb", "sa", "sb")).select("a", "b", (F.col("da") + F.col("db")).alias("slack"), (F.col("sa") + F.col("sb")).alias("least"), "ma", "mb", "sa", "sb"))
    met = _overlap(asked.select("a", "b", "slack", "least"), index, docs, column, scratch, t)
    links = met.where(union("na", "nb")).select("a", "b")
    # Pairs of leaders that are no link themselves, but whose followers may be: they hold other shingles or are smaller.
    possible = (F.col("overlap") + F.col("slack")) * (t.numerator + t.denominator) >= F.col("least") * t.numerator
    open_ = met.where(~union("na", "nb") & possible & ((F.col("slack") > 0) | (F.col("least") < F.col("na") + F.col("nb")))).select("a", "b", "overlap").join(asked.select("a", "b", "ma", "mb", "sa", "sb"), ["a", "b"])
    for x in ("a", "b"):
        side = near.select(F.col("leader").alias(x), "cid", F.col("component").alias(f"k{x}"), F.col("apart").alias(f"d{x}"))
        own = open_.select(x).distinct().join(placed.select(F.col("cid").alias(x), "component"), x, "left")
        own = own.select(x, F.col(x).alias("cid"), F.coalesce("component", x).alias(f"k{x}"), F.lit(0).cast("long").alias(f"d{x}"))
        side = side.unionByName(own).join(sizes.select("cid", F.col("n").alias("own"), "most"), "cid").withColumnRenamed("cid", f"c{x}")
        # The member's own size and bound take the place of its group's; members that can't link are never paired.
        joined = open_.join(side, x).where(shared("most", "mb" if x == "a" else "ma", "own", "sb" if x == "a" else "sa"))
        open_ = joined.drop(f"m{x}", f"s{x}").withColumnsRenamed({"most": f"m{x}", "own": f"s{x}"})
    sized = (F.least("sa", "sb") * t.denominator >= F.greatest("sa", "sb") * t.numerator) & (F.col("ka") != F.col("kb"))
    bound = (F.col("overlap") + F.col("da") + F.col("db")) * (t.numerator + t.denominator) >= (F.col("sa") + F.col("sb")) * t.numerator
    last = scratch.save(open_.where(bound & sized).select(F.col("ca").alias("a"), F.col("cb").alias("b"), none.alias("slack"), none.alias("least")).distinct())
    if last.limit(1).count():
        links = links.union(_overlap(last, index, docs, column, scratch, t).where(union("na", "nb")).select("a", "b"))
    # Groups found before are one node each now.
    for x in ("a", "b"):
        links = links.join(placed.select(F.col("cid").alias(x), F.col("component").alias(f"k{x}")), x, "left").withColumn(x, F.coalesce(f"k{x}", x)).drop(f"k{x}")
    outer = components(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), scratch)
    final = placed.select("cid", "component").join(outer, placed.component == outer.node, "full")
    final = scratch.save(final.select(F.coalesce("cid", outer.node).alias("node"), F.coalesce(outer.component, placed.component).alias("component")).unionByName(outer.select("node", "component")).groupBy("node").agg(F.min("component").alias("component")))
    # Components of class ids, then the smallest doc_id of all copies in each.
    for used in (best, sizes, led, placed, near, asked, met, last):
        scratch.drop(used)
    known = every.select("doc_id", "uid", "cid", F.col("n").alias("n_shingles"))
    lows = known.where("n_shingles > 0 and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("low"))
    lows = lows.join(final, lows.cid == final.node, "left").select("cid", "low", F.coalesce("component", "cid").alias("component"))
    ids = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = lows.join(ids, "component").select("cid", "component_id", F.col("component").alias("group"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    placed = known.join(by_class, "cid", "left")
    return placed.select("doc_id", "uid", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("group")).alias("group"))


def jaccard_components(docs: DataFrame, scratch: Scratch, column: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs; see ``jaccard_rows``."""
    return jaccard_rows(docs, scratch, column, threshold).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, scratch: Scratch, column: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component one row of its smallest doc_id stays.

    Rows are told apart by doc_id and text together, so a row that repeats another's doc_id with an unrelated text stays,
    and of rows that repeat both one stays. Null and empty texts and rows without a doc_id link with nothing and stay. Of
    rows with one doc_id in one component the smallest by a hash of the text stays. All columns pass, whatever their
    names. An empty table gives an empty result.
    """
    mark = unused(docs, "_uid")
    found = scratch.save(jaccard_rows(docs, scratch, column).where("group is not null").select("doc_id", "uid", "group"))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "uid")).alias("x")).select("group", F.col("x.uid").alias("first"))
    marked = found.join(first, "group").select("uid", (F.col("uid") == F.col("first")).alias("stays"))
    dropped = marked.where("not stays").select(F.col("uid").alias(mark)).distinct()
    again = scratch.save(marked.where("stays").groupBy(F.col("uid").alias(mark)).count().where("count > 1").select(mark))
    rows = docs.select("*", row_key(column).alias(mark))
    kept = rows.join(dropped, mark, "left_anti")
    if again.limit(1).count():  # rows that repeat doc_id and text
        once = kept.join(again, mark, "left_semi").dropDuplicates([mark])
        kept = kept.join(again, mark, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "jaccard"))


_LABELS = """r(node, low) AS (SELECT a, a FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)"""
OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
{_LABELS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id
"""
