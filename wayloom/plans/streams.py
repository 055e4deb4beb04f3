"""The event queue, as batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog as c
from ..sources.catalog import with_
from ..streaming.leases import lease_stream, lease_table
from ..streaming.outbox import latest, next_action, run_available, status_counts
from .registry import query

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("op_stm_03_next_action", with_("outbox", f""", a AS (SELECT *, CAST((epoch_us({_NOW}) - epoch_us(created_at)) // 1000000 AS BIGINT) AS age FROM outbox)
SELECT event_id, CASE WHEN status IN ('PROCESSED', 'FAILED') THEN 'NONE' WHEN status = 'PENDING' AND (attempts = 0 OR age >= least(300e0, 2e0 * pow(2e0, attempts - 1))) THEN 'CLAIM'
 WHEN status = 'PROCESSING' AND age > 30 AND attempts >= 5 THEN 'FAIL' WHEN status = 'PROCESSING' AND age > 30 THEN 'RETRY' ELSE 'WAIT' END AS action FROM a"""))
def actions(spark, sf):
    age = F.floor((F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000000)
    return c.outbox(spark, sf).select("event_id", next_action(F.col("status"), F.col("attempts"), age).alias("action"))


@query("op_stm_06_idempotent", "SELECT DISTINCT event_id FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 2 = 0)")
def idempotent(spark, sf):
    e = c.outbox(spark, sf).select("event_id", "status")
    return latest(e.unionByName(e.where("event_id % 2 = 0"))).select("event_id")


def deliveries(events):
    """What happens to each queued event: appended at its time, then claimed up to six times, each time kept alive or not,
    and done, failed or left; by formula of the key, for tables and streams alike. One in three comes twice."""
    k = F.col("event_id")
    second = lambda s: F.col("ts") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    one = lambda seq, kind, at: F.struct(seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), at.alias("at"))

    def attempt(a):
        claim = 1 + a * (40 + k % 50)
        end = claim + (k * 7 + a * 13) % 60
        last = F.when((k + a) % 4 == 0, F.array(one(3 * a + 3, "ERROR", second(end)))).when((k + a) % 4 >= 2, F.array(one(3 * a + 3, "DONE", second(end)))).otherwise(F.array().cast("array<struct<seq:int,kind:string,at:timestamp>>"))
        return F.concat(F.array(one(3 * a + 1, "CLAIM", second(claim)), one(3 * a + 2, "HEARTBEAT", second(claim + 10 + k % 25))), last)

    every = F.concat(F.array(one(F.lit(0), "APPEND", F.col("ts"))), F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), k % 6), attempt)))
    return events.select("event_id", F.explode(F.when(k % 3 == 0, F.concat(every, F.slice(every, 1, 2))).otherwise(every)).alias("d")).select("event_id", "d.*")


#: When the batch form looks at the queue, in milliseconds (2024-02-01).
LOOK_MS = 1_706_745_600_000


@query("op_stm_05_lease_table")
def lease_standings(spark, sf):
    """Where every queued event stands once all has happened: attempts, compensations, what is due."""
    return lease_table(deliveries(c.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))), LOOK_MS)


@query("op_stm_01_lease_stream")
def lease_updates(spark, sf):
    """The same queue as a stream with keyed state and timers, drained: the last standing that it told of each event."""
    rows = events_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_available(lease_stream(deliveries(rows), "40 days"), ["event_id"])


@query("op_stm_09_status_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_stream(spark, sf):
    stream = events_stream(spark, sf).select(F.col("event_type").alias("status"))
    return run_available(status_counts(stream), ["status"]).select(F.col("status").alias("event_type"), "n")


def events_stream(spark, sf):
    schema = c.read(spark, sf, "events").schema
    # A table is a file or a folder; a stream reads folders, so a file is told by its name there.
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(schema)
    return source.parquet(f"{sf}/events.parquet") if folder else source.option("pathGlobFilter", "events.parquet").parquet(sf)


@query("op_stm_12_push_routing", with_("outbox", "SELECT event_id FROM outbox WHERE status IN ('PROCESSED', 'FAILED') AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)"))
def push_routing(spark, sf):
    live = c.read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return c.outbox(spark, sf).where("status in ('PROCESSED', 'FAILED')").join(live, "user_id", "left_anti").select("event_id")
