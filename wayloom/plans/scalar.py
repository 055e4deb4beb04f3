"""Scalar functions: strings, dates, scores, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quality import log_share, notability_score, places_score
from ..functions.text import document_identity, name_match, norm_name, overlap_ratio, redact, token_jaccard, tokens
from ..operators.blocks import told_pairs
from ..sources import catalog as c
from ..sources.catalog import with_
from .registry import query

_NORM = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
_TOK = "list_distinct(list_filter(string_split({}, ' '), lambda x: x <> ''))"


@query("op_str_01_norm_name", f"SELECT doc_id, {_NORM.format('text')} AS name_key FROM documents")
def norm(spark, sf):
    return c.read(spark, sf, "documents").select("doc_id", norm_name(F.col("text")).alias("name_key"))


_NAME_PAIRS = f"""WITH t AS (SELECT p_partkey, p_brand, p_size, p_type, {_TOK.format(_NORM.format('p_name'))} AS a FROM part), p AS (SELECT x.p_partkey AS left_id, y.p_partkey AS right_id, x.a, y.a AS b, list_intersect(x.a, y.a) AS i FROM t x JOIN t y USING (p_brand, p_size, p_type) WHERE x.p_partkey < y.p_partkey)"""


def _name_pairs(spark, sf, told):
    """Names of the parts that agree in brand, size and type, each pair once, and what is told of their tokens."""
    t = c.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", "p_type", tokens(F.col("p_name")).alias("a"))
    return told_pairs(t, ["p_brand", "p_size", "p_type"], ["a"], lambda x, y: told(x("a"), y("a")))


@query("op_str_09_name_correspondence", f"""{_NAME_PAIRS}
SELECT left_id, right_id, CASE WHEN len(i) = 0 THEN 'NONE' WHEN len(i) = len(a) AND len(a) = len(b) THEN 'EQUIVALENT' ELSE 'OVERLAP' END AS relation FROM p""")
def name_correspondence(spark, sf):
    def relation(a, b):
        n = F.size(F.array_intersect(a, b))
        return F.when(n == 0, "NONE").when((n == F.size(a)) & (F.size(a) == F.size(b)), "EQUIVALENT").otherwise("OVERLAP")

    return _name_pairs(spark, sf, relation).withColumnRenamed("told", "relation")


@query("op_str_07_token_overlap", f"""{_NAME_PAIRS}, l AS (SELECT left_id, right_id, list_filter(a, lambda x: length(x) >= 4) AS a, list_filter(i, lambda x: length(x) >= 4) AS i FROM p)
SELECT left_id, right_id, len(i) * 2 >= len(a) AND len(list_filter(i, lambda x: length(x) >= 5)) > 0 AS overlaps FROM l""")
def token_overlap(spark, sf):
    long = lambda k: F.filter(k, lambda x: F.length(x) >= 4)

    def overlaps(a, b):
        i = long(F.array_intersect(a, b))
        return (F.size(i) * 2 >= F.size(long(a))) & F.exists(i, lambda x: F.length(x) >= 5)

    return _name_pairs(spark, sf, overlaps).withColumnRenamed("told", "overlaps")


@query("op_str_10_name_match", f"""WITH n AS (SELECT p_partkey, {_NORM.format('p_name')} AS a, {_NORM.format("split_part(p_name, ' ', 2)")} AS b FROM part) SELECT p_partkey, a <> '' AND b <> '' AND (a = b OR contains(a, b) OR contains(b, a)) AS matches FROM n""")
def names_match(spark, sf):
    return c.read(spark, sf, "part").select("p_partkey", name_match(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("matches"))


@query("op_str_12_house_number", "SELECT s_suppkey, CAST(regexp_extract(s_name, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS number FROM supplier")
def house_number(spark, sf):
    return c.read(spark, sf, "supplier").select("s_suppkey", F.element_at(F.regexp_extract_all(F.split_part("s_name", F.lit(","), F.lit(1)), F.lit("([0-9]+)")), -1).cast("long").alias("number"))


@query("op_str_14_qid", "SELECT p_partkey, CASE WHEN regexp_full_match('Q' || CAST(p_partkey AS VARCHAR), 'Q[1-9][0-9]*') THEN 'Q' || CAST(p_partkey AS VARCHAR) END AS qid FROM part")
def qid(spark, sf):
    q = F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))
    return c.read(spark, sf, "part").select("p_partkey", F.when(F.regexp_like(q, F.lit("^Q[1-9][0-9]*$")), q).alias("qid"))


@query("op_str_16_document_identity", "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS identity FROM pages")
def identity(spark, sf):
    return c.read(spark, sf, "pages").select("page_id", document_identity(F.col("url")).alias("identity"))


@query("op_str_17_redaction", r"SELECT event_id, regexp_replace(regexp_replace('token=' || event_type || ' Bearer ' || user_id, '(?i)bearer\s+[a-z0-9._-]+', 'Bearer [redacted]', 'g'), '(?i)(api[_-]?key|token|secret|password)=[^&\s]+', '\1=[redacted]', 'g') AS clean FROM events")
def redaction(spark, sf):
    e = c.read(spark, sf, "events")
    return e.select("event_id", redact(F.concat(F.lit("token="), "event_type", F.lit(" Bearer "), F.col("user_id").cast("string"))).alias("clean"))


@query("op_str_18_semantic_document", "SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Type: ' || p_type || chr(10) || 'Brand: ' || p_brand AS document FROM part")
def semantic_document(spark, sf):
    return c.read(spark, sf, "part").select("p_partkey", F.concat_ws("\n", F.concat(F.lit("Name: "), "p_name"), F.concat(F.lit("Type: "), "p_type"), F.concat(F.lit("Brand: "), "p_brand")).alias("document"))


@query("op_date_01_weekday", "SELECT o_orderkey, CAST(dayofweek(o_orderdate + INTERVAL 3 DAY) AS INTEGER) AS weekday FROM orders")
def weekday(spark, sf):
    return c.read(spark, sf, "orders").select("o_orderkey", (F.dayofweek(F.date_add(F.col("o_orderdate").cast("date"), 3)) - 1).alias("weekday"))


@query("op_date_02_planned_time", "SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate + to_days(l_linenumber) + to_minutes(540)) // 1000000 AS planned_s FROM lineitem")
def planned_time(spark, sf):
    at = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 86400 + 540 * 60
    return c.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", at.alias("planned_s"))


@query("op_date_04_open_during", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN true ELSE m >= 540 AND m + 90 <= 1140 END AS open FROM (SELECT event_id, user_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS m FROM events)")
def open_during(spark, sf):
    e = c.read(spark, sf, "events").select("event_id", "user_id", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    ranges = F.when(F.col("user_id") % 5 != 0, F.array(F.struct(F.lit(540).alias("start"), F.lit(1140).alias("end"))))
    return e.select("event_id", F.coalesce(F.exists(ranges, lambda r: (F.col("m") >= r["start"]) & (F.col("m") + 90 <= r["end"])), F.lit(True)).alias("open"))


@query("op_date_05_backoff", with_("outbox", "SELECT event_id, CAST(least(300, 2 * pow(2, attempts - 1)) AS DOUBLE) AS delay_s FROM outbox WHERE attempts > 0"))
def backoff(spark, sf):
    return c.outbox(spark, sf).where("attempts > 0").select("event_id", F.least(F.lit(300.0), 2 * F.pow(F.lit(2.0), F.col("attempts") - 1)).alias("delay_s"))


@query("op_math_01_log_share", "SELECT o_orderkey, round(least(1e0, greatest(0e0, log10(1e0 + o_totalprice) / log10(1e0 + 1e6))), 6) AS share FROM orders")
def log_shares(spark, sf):
    return c.read(spark, sf, "orders").select("o_orderkey", F.round(log_share(F.col("o_totalprice"), 1e6), 6).alias("share"))


@query("op_math_02_05_quality", with_("experience", "SELECT experience_id, round(places_score, 6) AS places, round(notability_score, 6) AS notability, round(quality, 6) AS quality FROM experience"))
def quality(spark, sf):
    e = c.experience(spark, sf)
    return e.select("experience_id", F.round(places_score(F.col("rating"), F.col("reviews")), 6).alias("places"), F.round(notability_score(F.col("notability")), 6).alias("notability"), F.round("quality", 6).alias("quality"))


@query("op_math_08_travel_estimate", "SELECT l_orderkey, l_linenumber, CASE WHEN m <= 1000 THEN 'walking' WHEN m <= 2500 THEN 'cycling' ELSE 'driving' END AS mode, greatest(1, ceil(m * 1.3::DOUBLE / 1000 / CASE WHEN m <= 1000 THEN 4.5::DOUBLE WHEN m <= 2500 THEN 13::DOUBLE ELSE 25::DOUBLE END * 60))::BIGINT AS minutes FROM (SELECT *, l_extendedprice / 10 AS m FROM lineitem)")
def travel_estimate(spark, sf):
    m = F.col("l_extendedprice") / 10
    mode = F.when(m <= 1000, "walking").when(m <= 2500, "cycling").otherwise("driving")
    speed = F.when(m <= 1000, 4.5).when(m <= 2500, 13.0).otherwise(25.0)
    return c.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", mode.alias("mode"), F.greatest(F.lit(1), F.ceil(m * 1.3 / 1000 / speed * 60)).cast("long").alias("minutes"))


@query("op_math_10_evidence_score", f"""WITH t AS (SELECT p_partkey, p_brand, p_type, {_TOK.format(_NORM.format('p_name'))} AS a, p_size FROM part), p AS (SELECT x.p_partkey AS left_id, y.p_partkey AS right_id, x.a, y.a AS b, abs(x.p_size - y.p_size) AS d, len(list_intersect(x.a, y.a)) AS i FROM t x JOIN t y USING (p_brand, p_type) WHERE x.p_partkey < y.p_partkey)
SELECT left_id, right_id, round(0.22::DOUBLE * i / (len(a) + len(b) - i) + 0.15::DOUBLE * i / greatest(len(a), len(b)) + CASE WHEN d <= 5 THEN 8e-2 WHEN d <= 15 THEN 4e-2 ELSE 0e0 END, 6) AS score FROM p""")
def evidence_score(spark, sf):
    """All pairs of one brand and type: what names say is told once per pair of names, with each bonus for the distance of the
    sizes; a pair of parts picks one of the three."""
    t = c.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", tokens(F.col("p_name")).alias("a"), "p_size")

    def scores(x, y):
        names = 0.22 * token_jaccard(x("a"), y("a")) + 0.15 * overlap_ratio(x("a"), y("a"))
        return F.struct(*[F.round(names + bonus, 6).alias(n) for n, bonus in (("near", 0.08), ("around", 0.04), ("far", 0.0))])

    def picked(told, p, q):
        d = F.abs(p - q)
        return F.when(d <= 5, told["near"]).when(d <= 15, told["around"]).otherwise(told["far"])

    return told_pairs(t, ["p_brand", "p_type"], ["a"], scores, own="p_size", then=picked, size=8).withColumnRenamed("told", "score")


@query("op_math_12_lexical_relevance", """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), q(term) AS (VALUES ('the'), ('of'), ('die'), ('que')),
h AS (SELECT doc_id, term FROM d JOIN q ON list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id, round(sum(ln(1e0 + n / df)), 6) AS relevance FROM h JOIN f USING (term), (SELECT count(*) AS n FROM documents) GROUP BY 1""")
def lexical_relevance(spark, sf):
    terms = ["the", "of", "die", "que"]
    d = c.read(spark, sf, "documents").select("doc_id", F.explode(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), F.array(*map(F.lit, terms)))).alias("term"))
    n = c.read(spark, sf, "documents").count()
    df = d.groupBy("term").agg(F.count("*").alias("df"))
    return d.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.round(F.sum(F.log(1 + n / F.col("df"))), 6).alias("relevance"))  # one row per query term


@query("op_arr_02_zip_filter", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS kept FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def zip_filter(spark, sf):
    g = c.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    kept = F.transform(F.filter("x", lambda r: r["l_quantity"] > 10), lambda r: r["l_partkey"].cast("string"))
    return g.select("l_orderkey", F.array_join(kept, ",").alias("kept")).where("kept <> ''")


@query("op_arr_03_sorted_union", "SELECT o_custkey, string_agg(DISTINCT lower(o_orderpriority), '|' ORDER BY lower(o_orderpriority)) AS keys FROM orders GROUP BY 1")
def sorted_union(spark, sf):
    return c.read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(F.lower("o_orderpriority"))), "|").alias("keys"))


@query("op_arr_04_richer_label", "SELECT p_brand, p_type, arg_max(p_name, (length(p_name), p_partkey)) AS label FROM part GROUP BY 1, 2")
def richer_label(spark, sf):
    return c.read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max_by("p_name", F.struct(F.length("p_name"), "p_partkey")).alias("label"))


@query("op_json_04_guarded_reader", "SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def guarded_reader(spark, sf):
    return c.read(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))
