"""Groups spelling variants: words one edit apart, each led to its far more frequent neighbour.

One edit leaves a half of a word intact. Every word therefore stands in a forward dictionary, in blocks of words that
share the first half, and in a reversed one, in blocks that share the second. Spark sorts both by range partitions of the
block; a task scans its blocks in order. Within a block the edit is known to lie between the shared prefix and the shared
suffix, so a block that is too long is cut the same way: its words share either half of what is left. Blocks that would
fill a task are cut so on Spark, in rounds, the others in the task, until they are short or a single place is left. Each
pair has one first place where its words differ, and only the block of that place counts it, so nothing is counted twice.
What leaves a block is one row per word (neighbours, best neighbour), not one per pair.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, Scratch, mix, pieces, release, table

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One of so many (document, run) pairs loses a letter, so that variants occur; 0: none does.
SPOIL = 97
#: Rows of a block that one task takes; rows of a block whose words are compared.
TASK_ROWS, BLOCK_ROWS = 4096, 24
#: Rows that a task scans together, and code points of them.
SCAN_ROWS, SCAN_POINTS = 1 << 15, 1 << 20
#: Different words that a counting task holds, and text bytes of a batch.
HELD_WORDS, BATCH_BYTES = 1 << 18, 4 << 20
# Letters A-Z (lower-cased), a-z and U+00C0..U+00FF form runs; all else separates them.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The letter runs of a text, one byte per code point (Latin-1); a null text has none."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def spoiled(doc_id: int | None, run: bytes, every: int = SPOIL) -> bytes:
    """The run, or without one of its letters where ``every`` divides the CRC of ``<doc_id>:<run>``; null ids are empty."""
    if not every:
        return run
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else b"%d" % doc_id, run if run.isascii() else run.decode("latin-1").encode()))
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoil: int = SPOIL) -> DataFrame:
    """(word, n) of the letter runs of docs (doc_id, text) that are long and frequent enough. Tasks add up before Spark does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for part in pieces(batches, "text", BATCH_BYTES):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                for word, n in Counter(runs(text.as_py())).items():
                    word = spoiled(doc_id, word, spoil)
                    if len(word) >= least_length:
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
        yield out()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def places(words: DataFrame) -> DataFrame:
    """Each word as a member of its pairs, with the places where they may differ: all of them.

    A pair is of two words of ``size`` code points (longer is false), or of one of size and one of one more, where the
    place is that of the code point which the longer one has in excess.
    """
    length = F.length("word")
    kinds = F.array(*[F.struct(s.cast("int").alias("size"), F.lit(x).alias("longer"), t.cast("int").alias("hi")) for s, x, t in ((length, False, length), (length, True, length + 1), (length - 1, True, length))])
    return words.select("word", "n", F.explode(kinds).alias("k")).select("word", "n", "k.size", "k.longer", F.lit(0).alias("lo"), "k.hi")


def halved(rows: DataFrame) -> DataFrame:
    """Rows of either half of the places, each with the block of words that agree in all others: prefix and suffix."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    cut = rows.withColumn("h", F.explode(halves)).drop("lo", "hi").select("*", "h.lo", "h.hi").drop("h").where("lo < hi")
    total = F.col("size") + F.col("longer").cast("int")
    suffix = F.expr("right(word, size + cast(longer as int) - hi)")
    return cut.withColumn("prefix", F.expr("left(word, lo)")).withColumn("suffix", F.when(total > F.col("hi"), suffix).otherwise(F.lit("")))


BLOCK = ("size", "longer", "lo", "hi", "prefix", "suffix")


def blocks(words: DataFrame, scratch: Scratch, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows (word, n, size, longer, lo, hi, prefix, suffix): each word once per block that it belongs to, where blocks of
    more than task_rows rows are halved until none is left or a single place is (then a block has at most one word per
    code point and word beside it)."""
    done, live = [], halved(places(words))
    while True:
        live = scratch.save(live)
        sizes = live.groupBy(*BLOCK).count().where((F.col("count") > task_rows) & (F.col("hi") - F.col("lo") > 1)).drop("count")
        large = scratch.save(sizes)
        if not large.limit(1).count():
            return _union([*done, live])
        done.append(live.join(large, list(BLOCK), "left_anti"))
        live = halved(live.join(large, list(BLOCK), "left_semi").drop("prefix", "suffix"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Scan:
    """Rows of one size, longer or not, whose blocks are whole: compares words within blocks, halving the long ones."""

    def __init__(self, size: int, longer: bool, words: list[str], n: np.ndarray, block_rows: int):
        self.size, self.longer, self.n, self.block_rows = size, longer, n, block_rows
        self.width = size + longer
        held = np.array(words, dtype=f"U{self.width}")
        self.length = np.array([len(w) for w in words])
        points = held.view(np.uint32).reshape(len(words), self.width) + np.uint32(1)
        self.points = np.where(np.arange(self.width) < self.length[:, None], points, 0)
        # Words are distinct but stand in several blocks; order of code points settles ties.
        order = np.lexsort(self.points.T[::-1])
        new = np.r_[True, (self.points[order[1:]] != self.points[order[:-1]]).any(axis=1)]
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.cumsum(new) - 1
        self.row_of = order[new]
        base = np.multiply.accumulate(np.full(self.width + 1, BASE, np.uint64), dtype=np.uint64)
        ahead = self.points.astype(np.uint64) * base[: self.width]
        zero = np.zeros((len(words), 1), np.uint64)
        self.prefix = np.c_[zero, np.cumsum(ahead, axis=1, dtype=np.uint64)]
        # The last code points, backwards: of a shorter word, column k is its k-th from the end.
        back = self.length[:, None] - 1 - np.arange(self.width)
        behind = np.where(back >= 0, np.take_along_axis(self.points, np.maximum(back, 0), axis=1), 0)
        self.suffix = np.c_[zero, np.cumsum(behind.astype(np.uint64) * base[: self.width], axis=1, dtype=np.uint64)]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Adds to ``pairs`` the rows of all pairs of near words whose first difference is from lo to before hi."""
        while len(row):
            key = mix(self.prefix[row, lo] + mix(self.suffix[row, self.width - hi] + mix(lo.astype(np.uint64) << np.uint64(32) | hi.astype(np.uint64))))
            order = np.argsort(key, kind="stable")
            row, lo, hi, key = row[order], lo[order], hi[order], key[order]
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[cuts, len(key)])
            long = np.repeat(count, count) > self.block_rows
            wide = long & (hi - lo > 1)
            self.compare(row[~wide], lo[~wide], hi[~wide], key[~wide])
            row, lo, hi = row[wide], lo[wide], hi[wide]
            mid = (lo + hi) // 2
            row, lo, hi = np.r_[row, row], np.r_[lo, mid], np.r_[mid, hi]

    def compare(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray) -> None:
        """Each word with the next one of its block, the one after that, and so on while there are any."""
        at, d = np.arange(len(row)), 1
        while len(at):
            at = at[at + d < len(row)]
            at = at[key[at] == key[at + d]]
            self.verify(row[at], row[at + d], lo[at], hi[at])
            d += 1

    def verify(self, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if self.longer:
            kept = self.length[a] != self.length[b]
            a, b, lo, hi = a[kept], b[kept], lo[kept], hi[kept]
            flip = self.length[a] > self.length[b]
            a, b = np.where(flip, b, a), np.where(flip, a, b)
        if not len(a):
            return
        differ = self.points[a] != self.points[b]
        first = differ.argmax(axis=1)
        if self.longer:
            shifted = self.points[a][:, :-1] != self.points[b][:, 1:]
            near = ~(shifted & (np.arange(self.size) >= first[:, None])).any(axis=1)
        else:
            near = differ.sum(axis=1) == 1
        near &= (first >= lo) & (first < hi)
        self.pairs.append((a[near], b[near]))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, neighbours, row of the most frequent one, ties to the smallest word) of the rows that have any."""
        none = np.zeros(0, np.int64)
        a = np.concatenate([none, *[x for x, _ in self.pairs], *[y for _, y in self.pairs]])
        b = np.concatenate([none, *[y for _, y in self.pairs], *[x for x, _ in self.pairs]])
        order = np.lexsort((self.rank[b], -self.n[b], self.rank[a]))
        a, b = self.rank[a[order]], b[order]
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else none
        return self.row_of[a[cuts]], np.diff(np.r_[cuts, len(a)]), b[cuts]


def scanned(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n, n_near, best_n, best): per word and scan, its near words there and the best of them."""
    dealt = rows.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK, "word")
    schema = "word string, n long, n_near long, best_n long, best string"

    def settle(part: pa.Table) -> Iterator[pa.RecordBatch]:
        size, longer = part["size"].to_numpy(), part["longer"].to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero((size[1:] != size[:-1]) | (longer[1:] != longer[:-1])) + 1, len(size)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            group = part.slice(x, y - x)
            words, n = group["word"].to_pylist(), group["n"].to_numpy()
            scan = Scan(int(size[x]), bool(longer[x]), words, n, block_rows)
            scan.run(np.arange(len(words)), group["lo"].to_numpy().astype(np.int64), group["hi"].to_numpy().astype(np.int64))
            row, count, best = scan.found()
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in row], pa.string()), pa.array(n[row]), pa.array(count, pa.int64()), pa.array(n[best]), pa.array([words[i] for i in best], pa.string())],
                ["word", "n", "n_near", "best_n", "best"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            while held is not None and held.num_rows > SCAN_ROWS:
                held = held.combine_chunks()
                last = held.num_rows - 1
                # Cut where a block ends, the last one that may go on stays.
                new = np.zeros(held.num_rows - 1, bool)
                for c in BLOCK:
                    values = held[c].combine_chunks() if isinstance(held[c], pa.ChunkedArray) else held[c]
                    new |= pc.not_equal(values.slice(1), values.slice(0, last)).to_numpy(zero_copy_only=False)
                ends = np.flatnonzero(new) + 1
                points = np.cumsum(held["size"].to_numpy().astype(np.int64) + 1)
                fit = ends[(ends <= SCAN_ROWS) & (points[ends - 1] <= SCAN_POINTS)]
                to = int(fit[-1]) if len(fit) else int(ends[0]) if len(ends) else 0
                if not to:
                    break
                yield from settle(held.slice(0, to))
                held = held.slice(to)
        while held is not None and held.num_rows:
            yield from settle(held)
            held = None

    return dealt.select("word", "n", *BLOCK).mapInArrow(run, schema)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form), null forms ending a way: ways halve each round. A way can't return, as counts rise."""
    live = scratch.save(forms.where("form IS NOT NULL").select("word", F.col("form").alias("at")))
    done = []
    while live.limit(1).count():
        further = live.select(F.col("word").alias("at"), F.col("at").alias("next"))
        moved = scratch.save(live.join(further, "at", "left").select("word", "at", "next"))
        done.append(moved.where("next IS NULL").select("word", F.col("at").alias("root")))
        settled = done[-1].select(F.col("word").alias("next"), F.col("root").alias("end"))
        ahead = moved.where("next IS NOT NULL").select("word", F.col("next").alias("at"))
        # Whoever came to a word that is settled now is settled with it; the others go on from where that one stands.
        live = scratch.save(ahead.join(settled.withColumnRenamed("next", "at"), "at", "left").select("word", F.coalesce("end", "at").alias("at")))
    return _union([forms.where("form IS NULL").select("word", F.col("word").alias("root")), *done])


def variants(words: DataFrame, scratch: Scratch, ratio: int = RATIO, task_rows: int = TASK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each distinct word of (word, n), of any script and length.

    Near words differ by one inserted, deleted or replaced code point; form is the most frequent near word (ties: the
    smallest in code-point order) where it is ratio times as frequent or more, else null, and form_n its count; root is
    the last word on the way of forms, the word itself without one. Rows of one word must be united before; null words
    drop out; an empty table gives no rows; extra columns are left out.
    """
    words = scratch.save(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    found = scanned(blocks(words, scratch, task_rows), block_rows).unionByName(alone)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))))
    near = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    near = scratch.save(near.select("word", "n", "n_near", F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n")))
    release(words.sparkSession)
    return near.join(roots(near.select("word", "form"), scratch), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")), Scratch(spark, "spelling"))
