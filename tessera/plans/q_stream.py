"""Streaming queries, each run to the end of what is there now: rates, replay with state, rows once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ledger import RUN_STATES
from tessera.plans.registry import query
from tessera.sources import model, store
from tessera.streaming import ledger


def drained(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Rows that a stream gives for all that is there, with the number of their batch; a repeated batch overwrites itself."""
    spark = stream.sparkSession
    root = f"{store.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/rows/n={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{root}/rows")


def events(spark, sf: str) -> DataFrame:
    return spark.readStream.schema(model.ledger(spark, sf).schema).parquet(f"{sf}/events.parquet*")


@query(
    "stream_rates",
    """WITH e AS (SELECT event_type, value, epoch_us(ts) // 1000000 AS s FROM events), w AS (SELECT event_type, value, (s - s % 30) - 30 * unnest([0, 1]) AS start FROM e)
SELECT start, event_type, count(*) AS requests, round(sum(value), 4) AS amount FROM w GROUP BY ALL""",
)
def stream_rates(spark, sf):
    rows = drained(ledger.rates(events(spark, sf)), "rates")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("requests", "amount"), "batch").alias("r"))
    return last.select(F.unix_seconds("start").alias("start"), "event_type", "r.requests", F.round("r.amount", 4).alias("amount"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("stream_live_rates", "SELECT event_type AS key, event_id AS sequence, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS amount FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def stream_live_rates(spark, sf):
    """The last minute before each event, from state by key that timers clear."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        # a mark behind the last event, under a key of its own, lets the watermark pass all of them
        last = model.ledger(spark, sf).agg(F.max("ts")).first()[0]
        e = events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
        mark = F.struct(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"))
        e = e.select(F.explode(F.when(F.col("ts") == F.lit(last), F.array(F.struct(*e.columns), mark)).otherwise(F.array(F.struct(*e.columns)))).alias("e")).select("e.*")
        rows = drained(ledger.live_rates(e, "event_type", "event_id", "ts", "value"), "live", "append").filter("key <> ''")
    finally:
        spark.conf.set(PROVIDER, before)
    return rows.select("key", "sequence", "requests", F.round("amount", 4).alias("amount"))


_STEP = f"(r.state = '' AND o.state = 'planned' OR r.state || '>' || o.state IN ({', '.join(repr(f'{a}>{b}') for a, b in sorted(RUN_STATES))}))"


@query(
    "stream_replay",
    f"""WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS run_id, event_id + 1 AS sequence, ['running', 'paused', 'stopped', 'planned', 'running', 'completed', 'planned'][event_id % 7 + 1] AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT DISTINCT run_id, 0::BIGINT AS n, '' AS state, 0::BIGINT AS last, 0::BIGINT AS refused FROM o UNION ALL
  SELECT o.run_id, o.n, CASE WHEN {_STEP} THEN o.state ELSE r.state END, o.sequence, r.refused + CASE WHEN {_STEP} THEN 0 ELSE 1 END FROM r JOIN o ON o.run_id = r.run_id AND o.n = r.n + 1)
SELECT run_id, state, last, refused FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1""",
)
def stream_replay(spark, sf):
    """The state of each user's run after a replay; the states are made of the events' numbers."""
    names = F.array(*[F.lit(x) for x in ("running", "paused", "stopped", "planned", "running", "completed", "planned")])
    e = events(spark, sf).select(F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") + 1).alias("sequence"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("state"))
    rows = drained(ledger.replay(e), "replay")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("state", "last", "refused"), "batch").alias("r")).select("run_id", "r.*")


@query("stream_once", "SELECT user_id, count(*) > 0 AS seen FROM events GROUP BY user_id")
def stream_once(spark, sf):
    e = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(ledger.once(e, "user_id", "ts", "3650 days"), "once", "append").select("user_id", F.lit(True).alias("seen"))
