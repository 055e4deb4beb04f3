"""Leases as a stream against the batch form and against a plain clock, with shuffled, repeated and late deliveries and a
restart."""

import random

from pyspark.sql import functions as F

from wayloom.plans import catalog
from wayloom.plans.streams import LOOK_MS, deliveries
from wayloom.streaming.leases import DELIVERY, lease_stream, lease_table, standing
from wayloom.streaming.outbox import run_available


def clock(rows, now):
    """One millisecond-exact walk over everything that can happen, lease ends among it."""
    todo = sorted(r for r in rows if r[0] <= now)
    state = dict(status="ABSENT", tries=0, undone=0, free=None, lease=None)

    def lose(at):
        state["undone"] += 1
        state["lease"] = None
        if state["tries"] >= 5:
            state["status"], state["free"] = "FAILED", None
        else:
            state["status"], state["free"] = "PENDING", at + 1000 * min(300, 2**state["tries"])

    while True:
        at = todo[0][0] if todo else now
        if state["status"] == "PROCESSING" and state["lease"] < at:
            lose(state["lease"])
            continue
        if not todo:
            break
        at, _, kind = todo.pop(0)
        if kind == "APPEND" and state["status"] == "ABSENT":
            state["status"], state["free"] = "PENDING", at
        if kind == "CLAIM" and state["status"] == "PENDING" and at >= state["free"]:
            state["status"], state["lease"], state["free"] = "PROCESSING", at + 30000, None
            state["tries"] += 1
        elif state["status"] == "PROCESSING":
            if kind == "HEARTBEAT":
                state["lease"] = at + 30000
            elif kind == "DONE":
                state["status"], state["lease"] = "PROCESSED", None
            elif kind == "ERROR":
                lose(at)
    return state["status"], state["tries"], state["undone"], state["lease"] if state["status"] == "PROCESSING" else state["free"]


def random_rows(rng):
    """Deliveries of one event, in any order of kinds; times collide."""
    rows, at = {(0, 0, "APPEND")}, 0
    for s in range(1, rng.randrange(2, 30)):
        at += rng.choice([0, 1000, 5000, 29000, 30000, 30001, 45000, 200000])
        rows.add((at, s, rng.choice(["CLAIM", "CLAIM", "HEARTBEAT", "DONE", "ERROR", "ERROR", "APPEND"])))
    return rows


def test_standing_equals_a_clock():
    rng, seen = random.Random(4), set()
    for _ in range(4000):
        rows = random_rows(rng)
        now = rng.choice([max(rows)[0], max(rows)[0] + 10**7])
        got = standing(sorted(r for r in rows if r[0] <= now), now)
        assert got == clock(rows, now)
        seen.add(got[0])
    assert seen == {"PENDING", "PROCESSING", "PROCESSED", "FAILED"}


def test_table_equals_the_clock_on_all_events(spark, sf):
    rows = {}
    for r in deliveries(spark.read.parquet(f"{sf}/events.parquet")).select("event_id", "seq", "kind", (F.unix_micros(F.col("at").cast("timestamp")) / 1000).cast("long").alias("ms")).collect():
        rows.setdefault(r.event_id, set()).add((r.ms, r.seq, r.kind))
    got = {r.event_id: (r.status, r.attempts, r.compensations, r.due_ms) for r in catalog.QUERIES["op_stm_05_lease_table"](spark, sf).collect()}
    assert got == {k: clock(v, LOOK_MS) for k, v in rows.items()} and {v[0] for v in got.values()} >= {"PENDING", "PROCESSED"} and max(v[1] for v in got.values()) >= 3


def test_stream_equals_the_table_after_a_restart(spark, tmp_path):
    """Two runs over one folder and one checkpoint: rows of the second part come late, twice and in any order."""
    rng = random.Random(9)
    rows = [(k, s, kind, 10**12 + at) for k in range(120) for at, s, kind in random_rows(rng)]  # epoch 0 is behind any watermark
    rng.shuffle(rows)
    last = max(r[3] for r in rows) + 10**8  # brings the watermark past all leases
    first, second = rows[: len(rows) // 2], rows[len(rows) // 2 :] + rows[::5] + [(-1, 0, "APPEND", last), (-1, 1, "CLAIM", last)]

    def put(part, n):
        frame = spark.createDataFrame([(k, s, kind, at) for k, s, kind, at in part], "event_id long, seq int, kind string, ms long")
        frame.select("event_id", "seq", "kind", F.timestamp_millis("ms").alias("at")).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        stream = spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return {r.event_id: r for r in run_available(lease_stream(stream, "26 hours"), ["event_id"], str(tmp_path / "run")).collect()}

    put(first, 1)
    half = drain()
    put(second, 2)
    got = drain()
    assert set(half) <= set(got)
    water = last - 26 * 3600 * 1000
    table = lease_table(spark.createDataFrame(first + second, "event_id long, seq int, kind string, ms long").select("event_id", "seq", "kind", F.timestamp_millis("ms").alias("at")), last)
    want = {r.event_id: (r.status, r.attempts, r.compensations, r.due_ms, r.deliveries) for r in table.collect()}
    assert water > max(r[3] for r in rows) + 30000
    assert {k: (r.status, r.attempts, r.compensations, r.due_ms, r.deliveries) for k, r in got.items()} == want


def test_stream_query_equals_the_table(spark, sf):
    streamed = {r.event_id: (r.status, r.attempts, r.compensations, r.deliveries) for r in catalog.QUERIES["op_stm_01_lease_stream"](spark, sf).collect()}
    table = {r.event_id: (r.status, r.attempts, r.compensations, r.deliveries) for r in catalog.QUERIES["op_stm_05_lease_table"](spark, sf).collect()}
    # A lease that ran out after the last delivery is told once the watermark is past it.
    differ = {k for k in table if table[k] != streamed[k]}
    assert set(streamed) == set(table) and all(streamed[k][0] == "PROCESSING" for k in differ) and len(differ) < len(table)
