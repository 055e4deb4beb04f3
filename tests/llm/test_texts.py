"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm.chat import format_chats, op3_chat, parse, read_back, segment
from wayloom.llm.common import Scratch
from wayloom.llm.html import blocks, extract, extract_pages, region, winning_paths
from wayloom.llm.jaccard import jaccard_components
from wayloom.llm.licenses import known_files, scan_licenses
from wayloom.llm.mixing import emit, mix_sources
from wayloom.llm.quality import fit_quality, held_out, lasso, op10_quality, score_quality, statistics
from wayloom.llm.sentencepieces import Codec, decode_column, default_model, encode_column
from wayloom.llm.suffixes import WIDTH, dedup_repeats, intervals, maximal_repeats, op8_suffixes, repeated_spans, spans_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string"


def rng_text(rng, n, words=400):
    return " ".join(f"w{rng.integers(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(4)
    base = [rng_text(rng, 120, 5000) for _ in range(6)]
    near = [" ".join(w if i not in (7, 60) else "changed" for i, w in enumerate(base[0].split())), base[0].upper(), base[0]]
    texts = [*base, *near, "", None, "one two", "ONE  two", "a b c d e", "\t\n ", base[1] + " " + rng_text(rng, 3000, 9000), "x" * 700, "x" * 150 + "é" * 300, base[2] + base[3][:260]]
    rows = [(i, t, "en", ["s1", None, "s0"][i % 3], len(t or ""), 5, "clash") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s1", 1, 5, "clash"), (None, texts[0], None, None, None, None, None), (99, texts[0], "de", "s1", 2, 2, "")]
    return spark.createDataFrame(rows, DOCS)


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] > low[b]:
                low[a], changed = low[b], True
    return Counter((i, len(s), low[i]) for i, s in sets)


def test_jaccard_equals_brute_force(spark, odd):
    want = brute_components([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    got = jaccard_components(odd, Scratch(spark, "t")).collect()
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_components(odd.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_settles_groups_of_near_copies(spark, seed):
    """Copies of a few texts with up to a tenth of the words changed, to rare or to common words, some cut short."""
    rng = np.random.default_rng(seed)
    bases = [rng_text(rng, int(n), 3000).split() for n in (150, 90, 40)]
    bases.append(bases[0][:75] + bases[1][:75])
    texts = []
    for k in range(240):
        words = list(bases[rng.integers(len(bases))])
        for at in rng.integers(len(words), size=rng.integers(max(2, len(words) // 10))):
            words[at] = f"own{k}x{at}" if rng.random() < 0.6 else f"often{rng.integers(3)}"
        texts.append(" ".join(words[: len(words) - rng.integers(12)]))
    rows = list(enumerate([*texts, *texts[:20]]))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Scratch(spark, "t")).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_counts_shared_shingles_outside_the_index(spark, seed):
    """Small texts with one of a few more or fewer words, around a head that is too far from some of them."""
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(60):
        head = [f"g{g}w{i}" for i in range(rng.integers(12, 44))]
        texts.append(" ".join(head))
        for _ in range(4):
            own = [f"own{rng.integers(1 << 40)}" for _ in range(rng.integers(1, 3))]
            texts += [" ".join([*head, *own][: len(head) + k]) for k in range(1, len(own) + 1)]
            texts += [" ".join([*head[cut:], *own]) for cut in rng.integers(1, 4, 2)]
    rows = list(enumerate(texts))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Scratch(spark, "t")).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def brute_spans(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + WIDTH] for b in data for p in range(len(b) - WIDTH + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - WIDTH + 1):
            if seen[b[p : p + WIDTH]] > 1:
                cover[p : p + WIDTH] = True
        edge = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(int)))
        out.append(edge.reshape(-1, 2).tolist())
    return out


def test_suffixes_equal_brute_force(spark, odd):
    found = repeated_spans(odd, Scratch(spark, "t")).collect()
    want = brute_spans([r.text for r in found])
    got = [spans_of(r._parts).tolist() for r in found]
    assert got == want
    cut = dedup_repeats(odd, Scratch(spark, "t"))
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert repeated_spans(odd.limit(0), Scratch(spark, "t")).count() == 0


def brute_maximal(texts):
    """{repeated bytes: occurrences (document, start)} of all maximal repeats of WIDTH bytes or more."""
    places = {}
    for d, b in enumerate(texts):
        for p in range(len(b) - WIDTH + 1):
            places.setdefault(b[p : p + WIDTH], []).append((d, p))
    found = {}
    for where in places.values():
        left = {texts[d][p - 1] if p else -1 for d, p in where}
        if len(where) < 2 or len(left) == 1 and -1 not in left:
            continue
        tails = sorted((texts[d][p:], d, p) for d, p in where)
        for k in range(len(tails) - 1):
            a, b = tails[k][0], tails[k + 1][0]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            own = {(d, p) for t, d, p in tails if t[:n] == a[:n]}
            left = {texts[d][p - 1] if p else -1 for d, p in own}
            if len(left) > 1 or -1 in left:
                found[a[:n]] = own
    return found


def passages(spark):
    """Passages of 1,177 bytes and more in two or three documents, one inside another, twice in one, at both ends."""
    rng = np.random.default_rng(9)
    long, inner = rng_text(rng, 260, 90_000)[:1177], rng_text(rng, 160, 90_000)[:700]
    own = [rng_text(rng, 70, 90_000) for _ in range(12)]
    texts = [own[0] + long + own[1], long + own[2], own[3] + long[300:900] + own[4], own[5] + inner, own[6] + inner[:450] + own[7] + inner[:450], inner[:449] + "!", own[8], "z" * 420, own[9] + "z" * 260, None, "", own[8]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_maximal_repeats_equal_brute_force(spark, odd):
    for docs in (passages(spark), odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").where("length(text) < 5000 or text is null")):
        rows = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("u"), "text").collect()
        data = [(r.text or "").encode() for r in rows]
        number, want = {r.u: k for k, r in enumerate(rows)}, brute_maximal(data)
        got = {}
        for r in maximal_repeats(docs, Scratch(spark, "t")).collect():
            got.setdefault(data[number[r.uid]][r.start : r.start + r.length], []).append((number[r.uid], r.start))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert max(map(len, brute_maximal([(r.text or "").encode() for r in passages(spark).collect()]))) >= 1177
    assert maximal_repeats(odd.limit(0), Scratch(spark, "t")).count() == 0


def test_suffixes_of_a_common_line(spark, monkeypatch):
    """A line of 150 bytes between ever other neighbours, some of which recur; its gram is dealt window by window."""
    from wayloom.llm import suffixes

    rng = np.random.default_rng(6)
    line = rng_text(rng, 40, 90_000)[:150]
    sides = [rng_text(rng, 12, 90_000) for _ in range(90)]
    rows = [(k, f"{sides[k % 80]} {line} {sides[(k * 7 + 1) % 90]} {line}{'' if k % 5 else sides[3]}") for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", 20)
    few = docs.select("doc_id", "text")
    assert len(suffixes._hot_grams(few))
    found = repeated_spans(docs, Scratch(spark, "t")).collect()
    assert [spans_of(r._parts).tolist() for r in found] == brute_spans([r.text for r in found])


def test_suffixes_query(spark, sf):
    got = {r.doc_id: r for r in op8_suffixes(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for r, spans in zip(rows, brute_spans([r.text for r in rows]), strict=True):
        data, at, kept = (r.text or "").encode(), 0, b""
        for s, e in spans:
            kept, at = kept + data[at:s], e
        kept += data[at:]
        q = got[r.doc_id]
        assert (q.n_bytes, q.n_removed, q.n_spans, q.kept_sha256) == (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert len(got) == len(rows)


def test_intervals_of_a_small_array():
    assert sorted(intervals([0, 3, 5, 3, 0, 4], 3)) == [(3, 0, 3), (4, 4, 5), (5, 1, 2)]


def test_mixture_reaches_targets(spark, odd):
    rng = np.random.default_rng(2)
    rows = [(i, rng_text(rng, int(rng.integers(0, 60))), "en", f"s{min(i % 7, 3)}", 1, 1, "") for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mix_sources(docs).select("doc.*", F.col("size").alias("words"), "source_size", "target", "copies").toPandas()
    assert len(mixed) == 1500 and mixed["copies"].between(0, 3).all()
    for _, g in mixed.groupby("source"):
        assert abs((g["copies"] * g["words"]).sum() - g["target"].iloc[0]) <= 120
    assert abs(mixed.groupby("source")["target"].first().sum() - mixed["words"].sum()) < 1e-6
    again = mix_sources(docs.repartition(5)).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert again == (mixed["copies"] * mixed["words"]).sum()
    assert emit(mix_sources(docs)).columns == docs.columns
    assert mix_sources(odd).count() == odd.count()
    assert mix_sources(odd.limit(0)).count() == 0


def test_licenses(spark, odd):
    rows = [(1, "Released under the mit licence"), (2, "text\nLicensed under CC BY-NC 4.0.\n\nmore"), (3, None), (4, ""), (4, "(c) 2020 Me"), (None, "Licensed under the ISC License!")]
    got = sorted(map(tuple, scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "MIT", 1, "MIT"), (2, None, 1, "CC-BY-NC-4.0"), (3, None, 0, ""), (4, None, 0, ""), (4, None, 0, ""), (None, "ISC", 1, "ISC")], key=str)
    assert scan_licenses(odd).count() == odd.count() and scan_licenses(odd.limit(0)).count() == 0


def test_chat_round_trip_and_sharing(spark):
    texts = ["plain", r"\### </turn> ok", "<turn>user\n</turn>\n", "a\\l<", "", "ends <", "\\"]
    for role in ("user", "ro\nle", "<turn>"):
        for t in texts:
            whole = segment(role, t)[0] + segment("assistant", t)[0]
            assert parse(whole) == [(role, t), ("assistant", t)]
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", "same" if k < 2 else f"own {c} {k}") for c in range(12) for k in range(5)]
    rows += [(50, 0, None, None), (None, 3, "user", "x"), (51, 1, "assistant", "t"), (51, 1, "assistant", "t")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments, index = format_chats(data, Scratch(spark, "t"))
    got = segments.collect()
    assert len(got) == 2 + 12 * 3 + 1 + 1 + 2  # shared turns once
    spans = sorted((r.stream_start, r.stream_end) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    by_node = {r.node: r for r in got}
    for r in got:
        ancestors, at = [], r
        while at.parent is not None:
            at = by_node[at.parent]
            ancestors.append((at.stream_start, at.stream_end))
        assert sum(b - a for a, b in r.attends) == sum(b - a for a, b in ancestors) == r.position_start
        assert all(any(x.a <= a and b <= x.b for x in r.attends) for a, b in ancestors)
    assert index.count() == len(rows)
    assert format_chats(data.limit(0), Scratch(spark, "t"))[0].count() == 0


def test_long_chats_and_clashing_columns(spark):
    """A conversation of 3,000 turns and one very long text, in a table with columns named like the operator's own."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}", "clash", 1) for k in range(3000)] + [(2, k, "assistant", "x" * (1_500_000 if k else 3), "clash", 1) for k in range(2)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, path int")
    segments, index = format_chats(docs, Scratch(spark, "t"))
    back = {r.conv_id: r for r in read_back(segments, index).collect()}
    assert parse(back[1].formatted) == [(r, t) for _, _, r, t, _, _ in rows[:3000]]
    assert [len(x) for x in back[2].loss] == [3, 1_500_000]
    ends = segments.orderBy("stream_start").collect()
    assert all(a.stream_end == b.stream_start for a, b in zip(ends, ends[1:], strict=False))
    assert all(sum(b - a for a, b in r.attends) == r.position_start for r in ends)


def test_license_files(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own Licence\n\nCopyright (c) 1999 Someone\nDo as you like, non-infringement aside.")
    (tmp_path / "empty.txt").write_text("")
    docs = spark.createDataFrame([(1, "OWN LICENSE: do as you like; noninfringement aside"), (2, "Own Licence"), (3, "Licensed under the MIT License.")], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in scan_licenses(docs, known_files(spark, str(tmp_path))).collect()}
    assert got == {1: "Own-1.0", 2: None, 3: None}


def test_rules_as_expressions_equal_numpy(spark):
    """The Spark expression, the rules in numpy and the statistics by plain Python agree, also on odd and very long texts."""
    rng = np.random.default_rng(5)
    texts = [rng_text(rng, int(n), 300) + "!?.," * int(n % 3) for n in rng.integers(0, 90, 300)] + ["", None, " \n\t", "É" * 9, "A b\nc", "x" * 300_000, "one " * 60_000]
    rows = [(i, t, "clash", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stat_row string, score double")
    labels = spark.createDataFrame([(i, int(len(t or "") % 2)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert model.rules
    names = list(model.names)
    x = docs.select("doc_id", *[c.alias(f"s_{n}") for n, c in statistics(F.col("text")).items()]).orderBy("doc_id").toPandas()[[f"s_{n}" for n in names]].to_numpy(float)
    want = 1 / (1 + np.exp(-(model.intercept + sum(w * r.holds(x) for w, r in model.rules))))
    scored = score_quality(docs, model)
    assert scored.columns == ["doc_id", "text", "_stat_row", "score"]
    got = np.array([r.score for r in scored.orderBy("doc_id").collect()])
    assert np.allclose(got, want, atol=1e-12)
    for k, t in enumerate(texts[:306:7]):
        t, k = t or "", 7 * k
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        plain = {"digits": sum(c in "0123456789" for c in t) / max(len(t), 1), "log_words": np.log1p(len(words)), "distinct": len(set(words)) / max(len(words), 1), "stops": sum(c in ".,;:" for c in t) / max(len(t), 1)}
        assert all(abs(x[k, names.index(n)] - v) < 1e-12 for n, v in plain.items())


def test_lasso_settles_where_its_conditions_hold():
    """At the optimum the gradient is within the penalty, and opposite to the weight where there is one."""
    rng = np.random.default_rng(1)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 3])))).astype(float)
    w, b = lasso(z, y, 0.01, steps=4000)
    g = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / 400
    assert abs((1 / (1 + np.exp(-(z @ w + b))) - y).mean()) < 1e-6
    assert (np.abs(g) <= 0.01 + 1e-6).all() and np.allclose(g[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-6)
    assert w[0] > 0.3 and w[3] < -0.3


def test_held_out_is_the_plain_checksum(spark):
    ids = [*range(-30, 200), 10**12, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_tokens_replace_columns_and_tell_lossy_texts(spark):
    docs = spark.createDataFrame([(1, "a b", "old", "old"), (2, None, "old", "old"), (3, "a▁b", "old", "old")], "doc_id long, text string, token_ids string, decoded string")
    back = decode_column(encode_column(docs, default_model()), default_model())
    assert sorted(back.columns) == sorted(docs.columns)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "a b", 2: "", 3: "a b"}


def test_html_extraction(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>n</a></nav><div class='sidebar'>s</div><article><h1>A &amp; B</h1><p>one<br>two   three<p>four <b>five</b></article><div id=comments><p>no</div><footer>f</footer>"
    assert extract(blocks(page), []) == "A & B\none two three\nfour five"
    rows = [(i, f"https://h{i % 2}.org/{i}", page) for i in range(4)] + [(9, None, None), (10, "x", ""), (11, "http://h0.org", "<nav>only</nav>"), (0, "https://h0.org/0", page)]
    got = {(r.page_id, r.url): r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0, "https://h0.org/0"].startswith("A & B") and got[9, None] == "" and got[10, "x"] == "" and got[11, "http://h0.org"] == ""
    assert extract(blocks("<p>" + "long " * 50000), [])
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TEMPLATES = {
    "article": '<body><nav><a href="/">n</a></nav><div class="ad">buy</div><article>{}</article><footer>f</footer>',
    "aria": '<body><header class="site-header">top</header><article aria-hidden="false" data-id="ad">{}</article><div id="comments"><p>no</p></div>',
    "post": '<body><div id="wrap"><div class="site-header"><p>Site</p></div><div class="post">{}</div><div class="right"><ul><li><a href="/a">one link of many</a></li></ul><p>short</p></div></div>',
    "main": '<body><main class="page"><div role="navigation"><p>skip</p></div>{}<aside><p>see also</p></aside><form><p>mail?</p></form></main><p>end of site</p>',
    "plain": "<body>{}",
    "two": '<body><article class="lead">{}</article><article class="comment"><p>first!</p></article><div class="cookie-banner">We use cookies</div>',
}


def test_html_gold_pages(spark):
    """Known articles in the templates of several hosts, each text compared whole."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for h, (name, template) in enumerate(TEMPLATES.items()):
        for k in range(7):
            title, lead, end = (rng_text(rng, n, 9000) for n in (5, 20, 9))
            longer, quote, item = (rng_text(rng, n, 9000) for n in (150, 60, 7))
            body = f'<header class="entry-header"><h1 class="section-header">{title}</h1></header>' if name in ("article", "two", "aria") else f'<div class="entry-header"><h1>{title}</h1></div>'
            body += f'<p>{lead} &amp; co<br>next</p><section data-class="ad"><p class="share-price">{longer}</p></section><blockquote>{quote}</blockquote><ul><li>{item}</li></ul><div aria-hidden="false"><p>{end}</p></div>'
            want[10 * h + k] = "\n".join([title, f"{lead} & co next", longer, quote, item, end])
            rows.append((10 * h + k, f"https://{name}.org/{k}", template.format(body), "clash", "clash"))
    rows += [(90, "https://post.org/x", TEMPLATES["post"].format("<p>tiny</p>"), "", ""), (91, None, "<body><div><p>a b</p></div>", "", ""), (91, None, "<body><div><p>a b</p></div>", "", "")]
    want |= {90: "tiny", 91: "a b"}
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string, winners string").repartition(5)
    got = extract_pages(docs).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def plain_winners(pages):
    """Votes per host by a loop over all pages."""
    votes = {}
    for url, html in pages:
        at = region(blocks(html))
        if at is not None:
            votes.setdefault(url.split("/")[2], Counter())[at] += 1
    return {h: [p for p, n in sorted(v.items(), key=lambda x: (-x[1], x[0])) if n >= 0.1 * v.total()] for h, v in votes.items()}


def test_html_votes_equal_a_plain_count(spark):
    pages = [(k, f"http://h{k % 3}.net/{k}", f'<body><div class="c{"abcd"[k % 4 if k % 3 else 0]}"><p>{"word " * (k % 5 + 2)}</p></div><div class="x"><p>w</p></div>') for k in range(60)]
    pages += [(70, "http://tie.net/1", "<body><div class='b'>one</div>"), (71, "http://tie.net/2", "<body><div class='a'>one</div>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r.host: list(r.winners) for r in winning_paths(frame).collect()}
    assert got == plain_winners([(u, h) for _, u, h in pages]) and got["tie.net"] == [">body>div.a", ">body>div.b"]


def brute_viterbi(codec, unit):
    s = unit.replace(" ", "▁")
    ids = codec.lattice(np.array([[ord(c) for c in s]], np.uint32))[0]
    best = [(0.0, None)] + [(-np.inf, None)] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - codec.longest), j):
            x = codec.scores[ids[i, j - i - 1]] if ids[i, j - i - 1] >= 0 else (codec.unk_score if j - i == 1 else -np.inf)
            best[j] = max(best[j], (best[i][0] + x, i), key=lambda p: p[0])
    return best[-1][0]


def test_sentencepieces(spark, odd, sf):
    import sentencepiece

    codec, library = Codec(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["", " two  spaces ", "日本語\t☃\n\n", "a" * 500, None]
    (ids, offs), (best, at) = codec.encode(texts, ("auto", "viterbi"))
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [library.encode(t or "") for t in texts]
    assert codec.decode(ids, offs) == codec.decode(best, at) == [t or "" for t in texts]
    units = [" the", " interesting", "xyzzy", " q☃q", " aaaa"]
    (t, o), = codec.encode_units(units, ("viterbi",))
    for k, u in enumerate(units):
        if "☃" not in u:
            assert abs(codec.scores[t[o[k] : o[k + 1]]].sum() - brute_viterbi(codec, u)) < 1e-6
    coded = encode_column(odd, default_model())
    back = decode_column(coded, default_model())
    assert all((r.text or "") == r.decoded for r in back.collect())
    assert encode_column(odd.limit(0), default_model()).count() == 0


def test_quality_holds_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    none = fit_quality(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert score_quality(odd, none).where("score = 0.5").count() == odd.count()
    one = fit_quality(odd, spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 0), (3, None)], "doc_id long, quality int"))
    assert score_quality(odd, one).where("score > 0.5").count() == odd.count()
    assert odd.select(held_out(F.col("doc_id"))).count() == odd.count()


def test_chat_query_has_the_odd_conversation(spark, sf):
    r = op3_chat(spark, sf).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
