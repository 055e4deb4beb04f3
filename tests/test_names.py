"""Folds and whole-word searches against plain versions of the rules."""

import contextlib
import hashlib
import io
import random
import unicodedata

import pytest

from wayloom.operators.names import Fold, _firsts, _listed, fold, folded, names_in_texts, words
from wayloom.plans import catalog
from wayloom.plans.literals import names as asked


def plain_fold(text):
    out, latin = [], False
    for c in unicodedata.normalize("NFKD", text):
        if latin and "̀" <= c <= "ͯ":
            continue
        latin = c.isalpha() and "LATIN" in unicodedata.name(c, "")
        out.append(c)
    said = unicodedata.normalize("NFC", "".join(out)).lower()
    return squeeze("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in said))


def squeeze(s):
    while "  " in s:
        s = s.replace("  ", " ")
    return s.strip(" ")


ALPHABET = ["a", "B", "é", "é", "ñ", "Å", "ﬁ", "Ｔ", "ガ", "カ゛", "ｶﾞ", "й", "й", "東", "京", "は", "가", "가", "ß", "İ", " ", "  ", "-", "’", "1", "²", "\n", "़", "ก", "😀"]


def test_fold_equals_the_rule_on_whole_texts():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12)))
        said, starts, ends = fold(text)
        assert said == plain_fold(text), text
        assert len(starts) == len(ends) == len(said) and starts == sorted(starts) and all(a < b for a, b in zip(starts, ends, strict=True))
        for k, c in enumerate(said):  # what a character comes from folds to it
            assert c == " " or c in folded(text[starts[k] : ends[k]]) or c in unicodedata.normalize("NFC", text).lower()


def test_fold_keeps_marks_where_they_tell_words_apart():
    assert folded("Luján") == "lujan" and folded("ガ") != folded("カ") and folded("й") != folded("и") and folded("Ｔｏｋｙｏ") == "tokyo"
    assert [folded("青山カフェは東京都")[a:b] for a, b in words(folded("青山カフェは東京都"))] == ["青山", "カフェ", "は", "東京都"]


def brute(texts, names):
    """Every name at every place of every text, with boundaries where words start and end."""
    out = set()
    wanted = {folded(n) for n in names if n and any(unicodedata.category(c)[0] in "LN" for c in folded(n))}
    for uid, text in texts:
        said, starts, ends = fold(text or "")
        spans = words(said)
        begin, stop = {a for a, _ in spans}, {b for _, b in spans}
        for name in wanted:
            at = [k for k in range(len(said)) if said.startswith(name, k) and k in begin and k + len(name) in stop]
            if at:
                out.add((uid, name, len(at), starts[at[0]], ends[at[0] + len(name) - 1]))
    return out


@pytest.mark.parametrize("few", [50_000, 0])
def test_names_equal_brute_force(spark, few):
    """Both ways of meeting; overlapping occurrences, scripts without spaces, nulls, empty and repeated texts and names."""
    rng = random.Random(4)
    pool = ["Café", "café", "CAFE", "del", "Sur", "la", "La", "東京", "カフェ", "は", "a", "b", "San Télmo"]
    texts = [(k, rng.choice([" ", " - ", ""]).join(rng.choices(pool, k=rng.randrange(14)))) for k in range(150)] + [(900, None), (901, ""), (902, "a a a a"), (903, "青山カフェは東京都渋谷区にあります")]
    names = ["cafe", "Café del Sur", "la", "東京", "カフェは", "青山カフェ", "山カフェ", "a a", "san telmo", "b la", "", None, "--", "Cafe", "cafe a"]
    docs = spark.createDataFrame(texts, "uid long, text string").repartition(3)
    got = names_in_texts(docs, spark.createDataFrame([(n,) for n in names], "name string"), few).collect()
    want = brute(texts, names)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert not any(w[0] == 903 and w[1] == "山カフェ" for w in want) and any(w[0] == 903 and w[1] == "青山カフェ" for w in want)
    assert names_in_texts(docs.limit(0), docs.limit(0).selectExpr("text as name"), few).count() == 0


def test_queries_equal_brute_force(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(texts, [r.name for r in asked(spark, sf).collect()])
    got = {(r.doc_id, r.name, r.n, r.start, r.end) for r in catalog.QUERIES["op_str_03_whole_words"](spark, sf).collect()}
    assert got == want and len(want) > 500
    by_id = dict(texts)
    spans = catalog.QUERIES["op_str_04_located_spans"](spark, sf).collect()
    assert len(spans) == len(want) and all(r.quoted == by_id[r.doc_id][r.start : r.end] and folded(r.quoted) == r.name for r in spans)
    folds = {(r.doc_id, r.folded_sha256, r.n_chars) for r in catalog.QUERIES["op_str_02_literal_fold"](spark, sf).collect()}
    assert folds == {(i, hashlib.sha256(plain_fold(t).encode()).hexdigest(), len(plain_fold(t))) for i, t in texts}


def test_fold_and_search_equal_character_by_character():
    """Whole texts at once, with marks that join, letters that become several, scripts without spaces and names that overlap."""
    rng = random.Random(6)
    pool = [*ALPHABET, "́", "̈́", "½", "ﷺ", "´", "ᅡ", "ᆨ", "゙", "…", "a a", " a a a ", "는"] + [chr(c) for c in rng.sample(range(0x80, 0xD800), 3000)]
    names = ["a", "a a", "a a a", "b", "東", "京", "1 a"]
    for n in range(3000):
        text = "".join(rng.choice(pool[: 42 if n % 2 else None]) for _ in range(rng.randrange(30)))
        f, (said, starts, ends) = Fold(text), fold(text)
        assert f.said == said == plain_fold(text), text
        got = {(name, m, *f.span(a, b)) for name, (m, a, b) in _firsts(f.said, _listed(names)).items()}
        assert got == {w[1:] for w in brute([(0, text)], names)}, text
        assert all(f.span(k, k + 1) == (starts[k], ends[k]) for k, c in enumerate(said) if c != " ")


def test_spans_are_read_where_they_are_found(spark, sf):
    """Neither texts nor names are shuffled to quote what stands there, and a doc_id that repeats is quoted from its own text."""
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        catalog.QUERIES["op_str_04_located_spans"](spark, sf).explain()
    assert "Exchange" not in told.getvalue() and "Join" not in told.getvalue()
    docs = spark.createDataFrame([(1, "x Café"), (1, "CAFÉ"), (2, None)], "uid long, text string")
    got = names_in_texts(docs, spark.createDataFrame([("cafe",)], "name string"), quoted=True)
    assert sorted((r.start, r.quoted) for r in got.collect()) == [(0, "CAFÉ"), (2, "Café")]
