"""The pipeline's stages, each against a plain version on its own input."""

import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from wayloom.llm.mixing import mix_sources  # noqa: E402
from wayloom.llm.quality import op10_quality  # noqa: E402
from wayloom.llm.sentencepieces import default_model  # noqa: E402

from .test_texts import brute_spans  # noqa: E402


def plain_representatives(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, low = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        low[i] = i
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if low[a] > low[b] and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    low[a], changed = low[b], True
    return {i for i in low if low[i] == i}


def test_stages(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "mixture", "tokens"]
    kept = corpus_pipeline.quality(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    want = {r.doc_id for r in op10_quality(spark, sf).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    first = corpus_pipeline.near_duplicates(spark, kept, sf).cache()
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == sorted(plain_representatives([(r.doc_id, r.text) for r in kept.collect()]))
    cut = corpus_pipeline.repeats(spark, first, sf).cache()
    rows = first.collect()
    plain = {}
    for r, spans in zip(rows, brute_spans([r.text for r in rows]), strict=True):
        data, at, out = (r.text or "").encode(), 0, b""
        for s, e in spans:
            out, at = out + data[at:s], e
        text = (out + data[at:]).decode("utf-8", "ignore")
        if text:
            plain[r.doc_id] = text
    assert {r.doc_id: r.text for r in cut.collect()} == plain
    mixed = corpus_pipeline.mixture(spark, cut, sf).cache()
    copies = Counter({r.doc_id: r.copies for r in mix_sources(cut).select("doc.doc_id", "copies").collect() if r.copies})
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == copies
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    coded = corpus_pipeline.tokens(spark, mixed, sf)
    assert {r.doc_id: list(r.token_ids) for r in coded.collect()} == {r.doc_id: library.encode(r.text) for r in mixed.collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid string, _parts string, _quality string, doc string, copies string"


def words(seed, n):
    return " ".join(f"{seed}w{i * 7919 % 1000}" for i in range(n))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ids that repeat with equal and other texts, clashing columns, an empty table."""
    x, y, z = words("x", 90), words("y", 80), words("z", 70)
    rows = [(2, x), (5, x), (5, y), (5, z), (7, y), (9, None), (9, ""), (None, x), (None, None), (11, words("l", 60_000)), (12, z), (12, z), (13, "one two"), (14, "ONE  two")]
    rows = [(i, t, "en", [None, "s"][k % 2], len(t or ""), "a", "b", "c", "d", "e") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(2, 1), (5, 1), (13, 0), (9, 0)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    near = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert near.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in near.collect())
    # x: 2; y: of (5, y), (7, y) the first; z: of (5, z), (12, z), (12, z) the first; 13 and 14 are one.
    assert got == Counter([(2, x), (5, y), (5, z), (9, None), (9, ""), (None, x), (None, None), (11, words("l", 60_000)), (13, "one two")])
    again = spark.createDataFrame([(12, z, "en", "s", 1, "a", "b", "c", "d", "e")] * 3, SCHEMA)
    assert corpus_pipeline.near_duplicates(spark, again, sf).count() == 1
    cut = corpus_pipeline.repeats(spark, near, sf)
    assert cut.columns == docs.columns and (2, x) not in {(r.doc_id, r.text) for r in cut.collect()}  # (null, x) holds it too
    mixed = corpus_pipeline.mixture(spark, docs, sf)
    assert mixed.columns == docs.columns
    coded = corpus_pipeline.tokens(spark, docs, sf)
    assert coded.columns == ["doc_id", "source", "token_ids", "n_tokens"] and coded.count() == len(rows)
    assert coded.where("n_tokens = 0").count() == 3
    for stage in (f for _, f in corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf).count() == 0
