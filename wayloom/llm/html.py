"""Main text of web pages by consensus of container paths per host.

Each page's containers are scored by the text outside links of their whole subtrees. Its articles, or else the deepest
container that holds nearly all of the text outside furniture, are its region. Regions and all containers that hold text
of their own vote, by generalised tag-class paths: Spark counts per host which paths are regions, and on how many pages a
container says what it says beside other text, too. Then every page is read again. Winning regions and its own stay; so
does whatever stands in or beside them, unless the host's pages agree that it is a side box, whose text recurs, or it is a
list of links outside them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, table

# Names of HTML and of page furniture.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("body div section article main td blockquote details figure".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
#: Words of a class or id that mark an element as furniture: as the whole name, with words that say nothing else, or, but
#: for those that article text is named by as well, in any name outside articles.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent popup modal overlay newsletter subscribe sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies respond related recommended sharing social widget toolbar pagination pager login signup".split())
TEXTUAL = frozenset("sponsor promotion consent comment comments replies respond related recommended sharing social login subscribe".split())
WHOLE = MARKS | frozenset("banner notice notices alert menu header reply share search".split())
#: Words that make a name with one of the others furniture, outside articles: site-header, share-buttons, top-menu.
SITE = frozenset("site page top main global web blog primary secondary mobile buttons bar box form links list icons cookie".split())
#: Words that say nothing beside a mark: comment-list, related-posts, ad-slot.
NEUTRAL = SITE | WHOLE | frozenset("area article articles block bottom container content group holder inline inner item items left module outer panel post posts reader right row section slot stories thread unit user wrap wrapper".split())
#: Elements that the parts of a name don't make furniture.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 body html main pre blockquote figure".split())
CLOSES = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
GAP = re.compile(r"\s+")

#: A region wins on a host with at least this share of the votes there; so a host has at most 1 / share of them.
WIN_SHARE = 0.1
#: Share of a container's text that one inside it holds if it takes its place, share that then may stand in it directly,
#: share of the page's text that its articles hold if they are its region.
NEARLY_ALL, HARDLY_ANY, MOSTLY = 0.75, 0.03, 0.4
#: Different texts beside which a container must say the same.
WITNESSES = 3
#: The hosts' paths are broadcast up to this many hosts and characters; beyond, pages are shuffled by host.
BROADCAST_HOSTS, BROADCAST_CHARS = 20_000, 8 << 20


def furniture(tag: str, attrs: str, within: bool) -> tuple[bool, str]:
    """Whether an element is no part of the text, and the letters of its first class. within: it stands in an article."""
    off, first, names, classes = False, "", [], []
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names += value.split()
            if name == "class" and value.split():
                classes += value.split()
                first = first or re.sub(r"[^a-z]+", "", classes[0])
        elif name == "hidden" or name == "role" and value in ROLES or name == "style" and UNSEEN.search(value):
            off = True
    if tag in PLAIN and within:
        names = classes
    for name in names:
        parts = [w for w in re.split(r"[^a-z]+", name) if w]
        if tag in ("body", "html", "main"):
            break
        if "".join(parts) in WHOLE:
            off = True
        elif tag not in PLAIN and not (tag == "header" and within):
            marks = [w for w in parts if w in MARKS]
            off = off or bool(marks) and all(len(w) == 1 or w in NEUTRAL for w in parts)
            off = off or not within and (any(w not in TEXTUAL for w in marks) or any(w in WHOLE for w in parts) and any(w in SITE for w in parts))
    quoted = tag == "aside" and within and any("quote" in name for name in classes)
    return off or tag in FURNITURE and not (tag == "header" and within) and not quoted, first


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(container path, characters in links, text) of each block outside furniture, in page order; texts are clean."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, container path, furniture
    buffer: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if buffer:
            if not (stack and stack[-1][2]) and (text := GAP.sub(" ", html.unescape("".join(buffer))).strip()):
                out.append((stack[-1][1] if stack else "", min(links, len(text)), text))
            buffer.clear()
        links = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            said = page[at : m.start()]
            buffer.append(said)
            links += len(said) if in_link else 0
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"] and m["raw"].lower() in ("textarea", "select", "title"):
                flush()
            continue
        tag, closing, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in BLOCKS and not (tag in FURNITURE and not closing) and not (closing and any(t == tag for t, _, _ in stack)):
            continue  # inline
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "body":
            while stack and stack[-1][0] != "html":
                stack.pop()
        while stack and tag in CLOSES.get(stack[-1][0], ()):
            stack.pop()
        if tag in VOID:
            continue
        _, path, off = stack[-1] if stack else ("", "", False)
        if not off:
            off, first = furniture(tag, attrs, any(t in MAIN for t, _, _ in stack))
            if tag in CONTAINERS:
                path = f"{path}>{tag}.{first}" if first else f"{path}>{tag}"
        stack.append((tag, path, off))
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return out


def region(found: list[tuple[str, int, str]]) -> str | None:
    """The paths, one per line, of the page's outermost articles if they hold a fair share of its text, else of its main
    element likewise, else of the deepest container that holds nearly all of it; null if there is no text."""
    own: dict[str, float] = {}
    for path, links, text in found:
        own[path] = own.get(path, 0.0) + max(0, len(text) - 2 * links)
    if not own:
        return None
    total = sum(own.values())
    for tag in ("article", "main"):
        tops: dict[str, float] = {}
        for path, weight in own.items():
            steps = path.split(">")
            at = next((k for k, step in enumerate(steps) if step.partition(".")[0] == tag), None)
            if at is not None:
                top = ">".join(steps[: at + 1])
                tops[top] = tops.get(top, 0.0) + weight
        if tops and sum(tops.values()) >= MOSTLY * total:
            return "\n".join(sorted(tops))
    whole: dict[str, float] = {}
    for path, weight in own.items():
        steps = path.split(">")
        for k in range(len(steps)):
            at = ">".join(steps[: k + 1])
            whole[at] = whole.get(at, 0.0) + weight
    at = ""
    while own.get(at, 0.0) <= HARDLY_ANY * whole[at]:
        inner = [p for p in whole if p.startswith(at + ">") and ">" not in p[len(at) + 1 :]]
        best = min(inner, key=lambda p: (-whole[p], p), default=None)
        if best is None or whole[best] < NEARLY_ALL * whole[at]:
            break
        at = best
    return at


def inside(path: str, paths: list[str]) -> bool:
    return any(path == p or path.startswith(p + ">") for p in paths)


def branch(path: str, paths: list[str]) -> str:
    """Where a block outside the paths leaves them: the container that parts from all of them, or, of one that holds some of
    them, its own blocks (``*``)."""
    steps, common = path.split(">"), 0
    for other in paths:
        held = other.split(">")
        same = next((k for k, (a, b) in enumerate(zip(steps, held)) if a != b), min(len(steps), len(held)))  # noqa: B905
        common = max(common, same)
    return ">".join(steps[: common + 1]) if common < len(steps) else path + ">*"


def beside(found: list[tuple[str, int, str]], paths: list[str]) -> dict[str, list[tuple[int, str]]]:
    """(characters in links, text) of the blocks of each branch outside the paths."""
    out: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for path, links, text in found:
        if not inside(path, paths):
            out[branch(path, paths)].append((links, text))
    return out


def linked(said: list[tuple[int, str]]) -> bool:
    return 2 * sum(n for n, _ in said) >= sum(len(t) for _, t in said)


def extract(found: list[tuple[str, int, str]], winners: list[str] = (), off: list[str] = ()) -> str:
    """The text of a page whose host has those winning regions and side boxes (paths whose own blocks go); of a region that
    holds nothing else, all."""
    at = region(found)
    if at is None:
        return ""
    own = at.split("\n")
    safe = own + [p for name in winners for p in name.split("\n")]
    lists = {b for b, said in beside(found, own).items() if linked(said)}
    boxes = set(off)
    kept = [t for p, _, t in found if p not in boxes and (inside(p, safe) or branch(p, own) not in lists)]
    return "\n".join(kept or [t for p, _, t in found if inside(p, own)])


def host(url: F.Column) -> F.Column:
    """The host of a URL in lower case; null and other strings share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


VOTE = "host string, path string, said long, beside long, most boolean"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page of its region (said is null), and one per path with blocks of its own: digests (sums modulo 2 ** 63 of
    those of the blocks) of what they say and of what the rest of the page does, and whether they are half of the page's text."""
    for part in pieces(batches, "html", 8 << 20):
        rows: list[tuple[str, str, int | None, int, bool]] = []
        for where, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
            found = blocks(page or "")
            at = region(found)
            if at is None:
                continue
            own, chars = defaultdict(int), defaultdict(int)
            for path, _, text in found:
                own[path] += _digest(text)
                chars[path] += len(text)
            total, length = sum(own.values()), sum(chars.values())
            rows.append((where, at, None, 0, True))
            rows += [(where, path, said % (1 << 63), (total - said) % (1 << 63), 2 * chars[path] >= length) for path, said in own.items()]
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "said", "beside", "most"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "html", 8 << 20):
        columns = (part.column(c).to_pylist() for c in ("html", "winners", "off"))
        texts = [extract(blocks(x or ""), w or [], b or []) for x, w, b in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame, share: float = WIN_SHARE) -> DataFrame:
    """(host, winners, off): regions with the share of the host's votes, most voted first, ties by path; and the paths
    that are side boxes.

    A path is one if on half of its pages or more its own blocks are the smaller part of the text and say what they say
    beside WITNESSES different texts at least, so pages stored twice are no witnesses. A host of one page has one vote,
    which wins, and no side boxes.
    """
    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_votes, VOTE)
    counts = votes.groupBy("host", "path", "said", "beside").agg(F.count("*").alias("n"), F.count_if(~F.col("most")).alias("less"))
    counts = counts.groupBy("host", "path", "said").agg(F.sum("n").alias("n"), F.when(F.count("*") >= WITNESSES, F.sum("less")).otherwise(0).alias("again"))
    paths = counts.groupBy("host", "path", F.col("said").isNull().alias("is_region")).agg(F.sum("n").alias("n"), F.sum("again").alias("again"))
    of_host = Window.partitionBy("host", "is_region")
    fair = paths.withColumn("all", F.sum("n").over(of_host)).withColumn("box", ~F.col("is_region") & (2 * F.col("again") >= F.col("n")))
    fair = fair.where(F.col("box") | F.col("is_region") & (F.col("n") >= share * F.col("all")))
    lists = fair.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_region"), F.struct((-F.col("n")).alias("n"), "path")))).alias("x"),
        F.sort_array(F.collect_list(F.when(F.col("box"), F.col("path")))).alias("off"),
    )
    return lists.select("host", F.col("x.path").alias("winners"), "off")


def extract_pages(pages: DataFrame, share: float = WIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    Null and empty html, and pages of furniture only, give an empty text. Rows that repeat a page_id each give one. Only
    page_id, url and html are read, so other columns can't clash. Regions of equal votes all win. A host's votes are
    pre-aggregated before the shuffle, so a hot host costs no more than another; pages aren't shuffled while the hosts
    and their paths are few enough to broadcast.
    """
    paths = Scratch(pages.sparkSession, "html").save(winning_paths(pages, share))
    size = F.length(F.array_join(F.concat("winners", "off"), " "))
    held = paths.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")).first()
    few = held.hosts <= BROADCAST_HOSTS and held.chars <= BROADCAST_CHARS
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(F.broadcast(paths) if few else paths, "host", "left")
    return rows.select("page_id", "url", "html", "winners", "off").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
