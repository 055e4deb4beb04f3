"""Resampling, byte-level BPE and spelling variants against plain versions and the library that defines the ids."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wayloom.llm import bytebpe, resampling, spelling
from wayloom.llm.bytebpe import PerfectHash, codec, decode_column, encode_column, op12_bytebpe
from wayloom.llm.common import Scratch
from wayloom.llm.html import extract_pages
from wayloom.llm.resampling import op11_resampling, resample
from wayloom.llm.spelling import op13_spelling, variants, word_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns named like results."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Über", "naïve", "x2", "Ünit-7", "日本", "don't", "we'll"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 90))) for _ in range(60)]
    texts += ["", None, "   \n\t ", "a", "word " * 4000, "x" * 3000, texts[0], texts[0].upper(), "İstanbul ſ K"]
    rows = [(i, t, "en", None if i % 7 == 0 else 3, "r", 1.5, None) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, 9, "r", 2.5, 7), (None, texts[5], None, None, None, None, None), (None, None, "de", 1, "s", 0.0, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, RANK long, token_ids string, weight double, n long").repartition(5)


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resampling(rows, targets):
    """Counter of (doc_id, n_features, weight, score, rank) by the definition."""
    found = [(i, *brute_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in targets for b in brute_features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10000.0) / ((s[b] + 1.0) * (n_t + 10000.0)))) for b in range(10000)]
    out = []
    for i, n_words, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = Counter()
    for rank, x in enumerate(able[: 5 * len(able) // 100], 1):
        drawn[(*x[:4], rank)] += 1
    for x in able[5 * len(able) // 100 :] + [x for x in out if x[4] < 20]:
        drawn[(*x[:4], None)] += 1
    return drawn


def test_resampling_equals_brute_force_on_odd_rows(spark, odd):
    targets = ["w1 w2 w3 Über w4", None, "", "w1 w1 w1"]
    frame = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resample(odd, frame, Scratch(spark, "t"))
    assert {"lang", "token_ids", "n", "rank", "weight"} <= set(got.columns) and "text" not in got.columns and "RANK" not in got.columns
    want = brute_resampling([(r.doc_id, r.text) for r in odd.collect()], targets)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == want
    assert sum(n for x, n in want.items() if x[4]) == 2
    assert resample(odd.limit(0), frame, Scratch(spark, "t")).count() == 0
    assert resample(odd, frame.limit(0), Scratch(spark, "t")).count() == odd.count()


def test_resampling_query_equals_brute_force(spark):
    """sf0.01: 1,000 documents, dealt over several partitions."""
    sf = "/root/testdata/sf0.01"
    docs, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_resampling([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in targets.collect()])
    assert Counter(tuple(r) for r in op11_resampling(spark, sf).collect()) == want


def test_ring_goes_on_over_runs_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = Counter(np.concatenate([b for _, b in resampling.scan(text, 3, 10000)]).tolist())
    monkeypatch.setattr(resampling, "SPAN", 50)
    assert len(list(resampling.scan(text, 3, 10000))) > 100
    assert Counter(np.concatenate([b for _, b in resampling.scan(text, 3, 10000)]).tolist()) == whole == Counter(brute_features(text)[1])
    for n in (1, 2, 5):
        assert sum(len(b) for _, b in resampling.scan(text, n, 7)) == sum(5000 - k for k in range(n))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ids, offs = codec(open(RANKS, "rb").read()).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]


def test_bytebpe_equals_the_library_on_random_texts(library):
    rng = random.Random(1)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "m", "d", "l", " ", "  ", "\n", "\xa0", "　", "!", "?", "1", "²", "é", "ß", "漢", "😀", "Z", "'S", "\x1c", "\x85", "​", "\t", "́", "_", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(20000)]
    texts += ["", None, "a" * 3000, " " * 500, "'s" * 100, "'", " '", "it's", "it'", "''ll", "\n's"]
    assert encoded(texts) == [library.encode_ordinary(t or "") for t in texts]


def test_bytebpe_knows_every_code_point_as_the_library_does(library):
    texts = [f"a{chr(k)}1 {chr(k)}" for k in range(0x110000) if not 0xD800 <= k <= 0xDFFF and (k < 0x30000 or k % 64 == 0)]
    for a in range(0, len(texts), 20000):
        assert encoded(texts[a : a + 20000]) == [library.encode_ordinary(t) for t in texts[a : a + 20000]]


def test_bytebpe_long_texts_in_spans(library, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word", "'s", " ", " ", "\n", "!!", "é", "12", "  "]) for _ in range(20000))
    want = library.encode_ordinary(text)
    monkeypatch.setattr(bytebpe, "SPAN", 200)
    assert len(list(bytebpe.spans(text))) > 50
    assert encoded([text, None, "x", text]) == [want, [], library.encode_ordinary("x"), want]
    assert encoded(["y" * 5000]) == [library.encode_ordinary("y" * 5000)]


def test_bytebpe_of_a_text_longer_than_a_batch(spark, library):
    text = "Some words, and ünïcode 12345!\n" * 40000
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.token_ids for r in encode_column(rows, RANKS).collect()}
    assert got == {1: library.encode_ordinary(text), 2: []}


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(1 << 63, size=5000).astype(np.uint64)
    keys = np.unique(keys)
    held = PerfectHash(keys)
    assert sorted(held(keys).tolist()) == list(range(len(keys)))
    assert len(PerfectHash(keys[:0])(keys)) == len(keys) and (PerfectHash(keys[:0])(keys) == -1).all()


def test_bytebpe_columns_round_trip_odd_rows(spark, odd, library):
    there = encode_column(odd, RANKS)
    assert sorted(there.columns) == sorted(odd.columns)
    rows = decode_column(there, RANKS).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert encode_column(odd.limit(0), RANKS).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "token_ids array<int>")
    assert [bytes(r.decoded) for r in decode_column(nulls, RANKS).collect()] == [b"", b""]


def test_bytebpe_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    sha = lambda data: hashlib.sha256(data).hexdigest()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for r in texts:
        ids = library.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))] += 1
    assert Counter(tuple(r) for r in op12_bytebpe(spark, sf).collect()) == want


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out = set()
    about = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in about.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(about[w]), words[form[w]] if form[w] else None))
    return out


def brute_words(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("task_rows,block_rows", [(4096, 24), (30, 3), (2, 2)])
def test_spelling_equals_brute_force(spark, task_rows, block_rows):
    """Dense words over few letters, of other scripts, one end shared by a third, chains of forms; small limits cut blocks on
    Spark and in tasks."""
    rng = random.Random(task_rows)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 9))) for _ in range(400)}
    words |= {"shared" + "".join(rng.choices("xy漢", k=rng.randrange(1, 6))) for _ in range(150)}
    words |= {"".join(rng.choices("pq", k=rng.randrange(3, 6))) + "ending" for _ in range(40)}
    words |= {"chain"[:5] + "z" * k for k in range(12)} | {"lonely", "😀😀😀", "😀😀", "z\x00", "z", "z\x00\x00"}
    counts = {w: rng.choice([3, 3, 4, 6, 8, 20, 50]) for w in words} | {"chain" + "z" * k: 3 * 2**k for k in range(12)}
    frame = spark.createDataFrame([*counts.items(), (None, 3)], "word string, n int").repartition(4)
    got = variants(frame, Scratch(spark, "t"), task_rows=task_rows, block_rows=block_rows).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == brute_variants(counts)


def test_spelling_long_words_and_empty_tables(spark):
    long = "ab" * 4000
    counts = {long: 9, long[:-1]: 4, long[:4000] + long[4001:]: 3, long + "c": 2, "c" + long[1:]: 50}
    got = variants(spark.createDataFrame([*counts.items()], "word string, n long"), Scratch(spark, "t")).collect()
    assert {tuple(r) for r in got} == brute_variants(counts)
    assert variants(spark.createDataFrame([], "word string, n long"), Scratch(spark, "t")).count() == 0


def test_spelling_counts_words_of_odd_rows(spark, odd, monkeypatch):
    want = brute_words([(r.doc_id, r.text) for r in odd.collect()])
    got = lambda: {r.word: r.n for r in word_counts(odd).collect()}
    assert got() == want and "über" not in want
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    assert got() == want
    assert word_counts(odd.limit(0)).count() == 0


def test_spelling_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in rows]))
    got = op13_spelling(spark, sf).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def html_rows(spark, pages):
    return {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_html_keeps_text_beside_the_region(spark):
    """Leads, sections, titles, stories and second articles in containers of their own; several hosts, also of one page."""
    rng = random.Random(7)
    box = '<div class="right"><p>Our town in short, every day the same words.</p></div><div class="latest"><a href="/a">one</a> <a href="/b">two</a></div>'
    forms = {
        "lead": "<div class=lead><p>{a}</p></div><div class=post><p>{b}</p><p>{c}</p></div>",
        "sections": "<section class=one><p>{a}</p></section><section class=two><p>{b}</p><p>{c}</p></section>",
        "title": "<div class=title><h1>{a}</h1></div><div class=post><p>{b}</p><p>{c}</p></div>",
        "teaser": "<article class=teaser><p>{a}</p></article><div class=story><p>{b}</p><p>{c}</p></div>",
        "marked": "<article><div class='note comment-free'><p>{a}</p></div><div class=related-work><p>{b}</p></div><p id=share>{c}</p><div class=related-posts><p>no</p></div><div id=comment-list><p>no</p></div><div class='ad slot'><p>no</p></div></article>",
        "quote": "<article><p>{a}</p><aside class=pullquote><p>{b}</p></aside><p>{c}</p><aside><p>see also</p></aside></article>",
    }
    sizes = {"lead": (20, 40, 40), "sections": (10, 20, 20), "title": (3, 60, 30), "teaser": (45, 30, 25), "marked": (30, 30, 30), "quote": (30, 9, 30)}
    pages, want = [], {}
    for h, (name, form) in enumerate(forms.items()):
        for k in range(8):
            said = dict(zip("abc", (prose(rng, n) for n in sizes[name]), strict=True))
            pages.append((100 * h + k, f"https://{name}.org/{k}", f"<body><div id=wrap>{form.format(**said)}{box}</div></body>"))
            want[100 * h + k] = "\n".join(said.values())
        said = dict(zip("abc", (prose(rng, n) for n in sizes[name]), strict=True))
        for k in (90, 91):  # one page alone on its host, stored twice
            pages.append((100 * h + k, f"https://only-{name}.org/{k}", f"<body>{form.format(**said)}</body>"))
            want[100 * h + k] = "\n".join(said.values())
    assert html_rows(spark, pages) == want


def test_html_a_hosts_usual_path_takes_no_other_text(spark):
    rng = random.Random(8)
    pages = [(k, f"http://n.org/{k}", f"<body><div class=news><p>{prose(rng, 40)}</p></div></body>") for k in range(20)]
    teaser, story = prose(rng, 20), prose(rng, 40)
    pages += [(99, "http://n.org/99", f"<body><div class=news><p>{teaser}</p></div><div class=story><p>{story}</p></div></body>")]
    got = html_rows(spark, pages)
    assert got[99] == f"{teaser}\n{story}" and all(f"<p>{got[k]}</p>" in pages[k][2] for k in range(20))


def test_html_side_boxes_go_by_consensus_of_the_host(spark):
    """The same box beside different texts goes, within the region of a short page as well; ties between winners of equal
    votes change nothing; a title that recurs goes, one that doesn't stays."""
    rng = random.Random(9)
    texts = [prose(rng, 30) for _ in range(6)]
    side = "<div class=side><p>Said by the house on every page of this host.</p></div>"
    pages = [(k, f"http://s.org/{k}", f"<body><div class={'ab'[k % 2]}><p>{t}</p></div>{side}</body>") for k, t in enumerate(texts)]
    pages += [(50, "http://s.org/x", f"<body><div class=a><p>tiny</p></div>{side}</body>")]
    pages += [(60 + k, f"http://t.org/{k}", f"<body><h2>Town news</h2><div class=c><p>{t}</p></div><div class=d>own {k}</div></body>") for k, t in enumerate(texts)]
    want = {k: t for k, t in enumerate(texts)} | {50: "tiny"} | {60 + k: f"{t}\nown {k}" for k, t in enumerate(texts)}
    assert html_rows(spark, pages) == want
