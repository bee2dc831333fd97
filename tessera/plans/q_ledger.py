"""Queries over the event ledger: replay, rates, transitions, attempts, budgets, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars
from tessera.operators import ledger
from tessera.plans.registry import query
from tessera.sources import model, store

ORDER = ["ts", "event_id"]


def _states(spark, sf):
    """Each user's events as states of a run: the first is planned, others by the event's number."""
    e = model.ledger(spark, sf).select("event_id", "ts", "user_id")
    names = F.array(*[F.lit(x) for x in ("running", "paused", "stopped", "running", "completed", "planned", "running")])
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) == 1
    return e.withColumn("state", F.when(first & (F.col("user_id") % 9 != 0), "planned").otherwise(F.get(names, (F.col("event_id") % 7).cast("int"))))


STATES_SQL = """st AS (SELECT event_id, ts, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND user_id % 9 <> 0 THEN 'planned'
  ELSE ['running', 'paused', 'stopped', 'running', 'completed', 'planned', 'running'][event_id % 7 + 1] END AS state FROM events)"""
ALLOWED_SQL = ", ".join(f"'{a}>{b}'" for a, b in sorted(ledger.RUN_STATES))


@query(
    "run_violations",
    f"""WITH {STATES_SQL}, b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM st)
SELECT user_id, event_id, before, state, CASE WHEN before IS NULL THEN 'no genesis' WHEN state = 'planned' THEN 'second genesis' ELSE 'not allowed' END AS reason FROM b
WHERE (before IS NULL AND state <> 'planned') OR (before IS NOT NULL AND (state = 'planned' OR before || '>' || state NOT IN ({ALLOWED_SQL})))""",
)
def run_violations(spark, sf):
    return ledger.violations(_states(spark, sf), "user_id", ORDER, "state", ledger.RUN_STATES, "planned").drop("ts")


@query("run_final_state", f"WITH {STATES_SQL} SELECT user_id, arg_max(state, {{'t': ts, 'e': event_id}}) AS state, count(*) AS events, arg_max(event_id, {{'t': ts, 'e': event_id}}) AS last_event_id FROM st GROUP BY user_id")
def run_final_state(spark, sf):
    return ledger.final_state(_states(spark, sf), "user_id", ORDER, "state").drop("last_ts")


@query("rate_window", "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS amount FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def rate_window(spark, sf):
    r = ledger.rate_window(model.ledger(spark, sf), "event_type", "ts", "value")
    return r.select("event_id", "requests", F.round("amount", 4).alias("amount"))


@query("clock_violations", "WITH c AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) SELECT event_id, user_id FROM c WHERE ts < high")
def clock_violations(spark, sf):
    return ledger.clock_violations(model.ledger(spark, sf), "user_id", "event_id", "ts").select("event_id", "user_id")


def _attempts(spark, sf):
    e = model.ledger(spark, sf).select("event_id", "user_id", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    phases = F.array(*[F.lit(p) for p in ledger.PHASES])
    skip = F.when(F.col("event_id") % 23 == 0, 1).otherwise(0)
    return e.select(F.col("user_id").alias("task"), (F.floor(n / 5) + 1 + F.when(F.col("user_id") % 31 == 0, 1).otherwise(0)).alias("attempt"), F.col("event_id").alias("seq"), F.get(phases, F.least((n % 5 + skip).cast("int"), F.lit(4))).alias("phase"))


@query(
    "attempt_phases",
    """WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
a AS (SELECT user_id AS task, n // 5 + 1 + CASE WHEN user_id % 31 = 0 THEN 1 ELSE 0 END AS attempt, event_id AS seq, least(n % 5 + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END, 4) + 1 AS step FROM n),
b AS (SELECT *, coalesce(lag(step) OVER (PARTITION BY task, attempt ORDER BY seq), 0) AS before FROM a),
f AS (SELECT task, attempt, min(seq) AS seq FROM a GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS expected FROM f)
SELECT task, attempt, seq, 'phase' AS reason FROM b WHERE step <> before + 1 UNION ALL SELECT task, attempt, seq, 'number' FROM x WHERE attempt <> expected""",
)
def attempt_phases(spark, sf):
    return ledger.attempts(_attempts(spark, sf))


def _spend(spark, sf):
    k = F.col("o_orderkey")
    d = lambda c: F.floor(c).cast("decimal(38,0)")
    return model.table(spark, sf, "orders").select(
        k.alias("attempt"),
        F.when(k % 5 == 0, "settled").when(k % 5 == 1, "released").otherwise("received").alias("state"),
        F.when(k % 3 == 0, "EUR").otherwise("USD").alias("currency"),
        F.when(k % 7 != 0, d(F.col("o_totalprice"))).alias("reserved"),
        F.when(k % 4 != 0, d(F.col("o_totalprice") * 1.1)).alias("observed"),
        d(F.col("o_totalprice") * 0.9).alias("actual"),
    )


SPEND_SQL = """sp AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'settled' WHEN 1 THEN 'released' ELSE 'received' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice) END AS reserved, CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice * 1.1) END AS observed, floor(o_totalprice * 0.9) AS actual FROM orders),
rc AS (SELECT currency, sum(CASE WHEN state = 'settled' THEN actual ELSE 0 END)::BIGINT AS settled, sum(CASE WHEN state IN ('settled', 'released') THEN 0 ELSE greatest(coalesce(reserved, 0), coalesce(observed, 0)) END)::BIGINT AS held, count(*) AS attempts,
  count(*) FILTER (state = 'received' AND reserved IS NULL AND observed IS NULL) AS unknown FROM sp GROUP BY currency)"""


@query("budget_recount", f"WITH {SPEND_SQL} SELECT * FROM rc")
def budget_recount(spark, sf):
    r = ledger.recount(_spend(spark, sf))
    return r.select("currency", F.col("settled").cast("long").alias("settled"), F.col("held").cast("long").alias("held"), "attempts", "unknown")


@query("budget_single_cost", f"WITH {SPEND_SQL} SELECT CASE WHEN count(*) <= 1 THEN sum(settled + held)::BIGINT END AS cost, count(*) AS currencies FROM rc")
def budget_single_cost(spark, sf):
    r = ledger.single_cost(ledger.recount(_spend(spark, sf)))
    return r.select(F.col("cost").cast("long").alias("cost"), "currencies")


@query("budget_allowance", f"WITH {SPEND_SQL} SELECT sum(settled + held)::BIGINT AS used, sum(settled + held) + 1000 <= 1000000000 AS fits FROM rc")
def budget_allowance(spark, sf):
    a = ledger.allowance(ledger.recount(_spend(spark, sf)), 1_000_000_000, 1000)
    return a.select(F.col("used").cast("long").alias("used"), "fits")


@query("usage_merged", "SELECT user_id, arg_max(event_id, event_id) FILTER (event_type = 'click') AS clicks, arg_max(round(value, 4), event_id) FILTER (event_id % 3 = 0) AS amount FROM events GROUP BY user_id")
def usage_merged(spark, sf):
    e = model.ledger(spark, sf).select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("event_id")).alias("clicks"), F.when(F.col("event_id") % 3 == 0, F.round("value", 4)).alias("amount"))
    return ledger.merge_usage(e, "user_id", ["event_id"], ["clicks", "amount"])


@query(
    "tasks_ready",
    """WITH t AS (SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'running' END AS state, left(o_orderpriority, 1) AS priority FROM orders),
d AS (SELECT o_orderkey AS key, o_orderkey // 2 AS needs FROM orders WHERE o_orderkey % 3 <> 0)
SELECT key, priority FROM t WHERE state = 'pending' AND key NOT IN (SELECT d.key FROM d LEFT JOIN t ON needs = t.key WHERE t.state IS DISTINCT FROM 'completed')""",
)
def tasks_ready(spark, sf):
    o = model.table(spark, sf, "orders")
    tasks = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    deps = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), F.floor(F.col("o_orderkey") / 2).alias("needs"))
    return ledger.ready(tasks, deps)


@query(
    "journal_violations",
    f"""WITH j AS (SELECT l_orderkey AS change, l_linenumber AS seq, ['prepared', 'applying', 'files_applied', 'indexed', 'committed', 'aborted', 'conflict'][1 + (l_linenumber - 1 + CASE WHEN l_suppkey % 8 = 0 THEN 1 ELSE 0 END) % 7] AS status FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) = 1),
b AS (SELECT *, lag(status) OVER (PARTITION BY change ORDER BY seq) AS before FROM j)
SELECT change, seq, before, status, CASE WHEN before IS NULL THEN 'no genesis' WHEN status = 'prepared' THEN 'second genesis' ELSE 'not allowed' END AS reason FROM b
WHERE (before IS NULL AND status <> 'prepared') OR (before IS NOT NULL AND (status = 'prepared' OR before || '>' || status NOT IN ({", ".join(f"'{a}>{b}'" for a, b in sorted(ledger.JOURNAL))})))""",
)
def journal_violations(spark, sf):
    li = model.table(spark, sf, "lineitem")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_partkey")).alias("s"))
    names = F.array(*[F.lit(x) for x in ("prepared", "applying", "files_applied", "indexed", "committed", "aborted", "conflict")])
    at = (F.col("l_linenumber") - 1 + F.when(F.col("s.l_suppkey") % 8 == 0, 1).otherwise(0)) % 7
    j = one.select(F.col("l_orderkey").alias("change"), F.col("l_linenumber").alias("seq"), F.get(names, at.cast("int")).alias("status"))
    return ledger.violations(j, "change", ["seq"], "status", ledger.JOURNAL, "prepared")


@query("tombstones_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'click'")
def tombstones_latest(spark, sf):
    e = model.ledger(spark, sf).select("user_id", "event_id", "event_type", (F.col("event_type") == "click").alias("gone"))
    return store.latest(e, "user_id", "event_id", "gone").drop("gone")


@query("append_once", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def append_once(spark, sf):
    sink = model.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"))
    return store.append_once(sink, model.table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("retry_delays", "SELECT event_id, CASE WHEN [429, 500, 404, 503, 200][event_id % 5 + 1] IN (429, 500, 502, 503, 504) THEN least(1000 * pow(2, least(user_id % 9, 5)), 30000)::BIGINT END AS delay FROM events")
def retry_delays(spark, sf):
    codes = F.array(*[F.lit(x) for x in (429, 500, 404, 503, 200)])
    return model.ledger(spark, sf).select("event_id", scalars.retry_delay(F.col("user_id") % 9 + 1, F.get(codes, (F.col("event_id") % 5).cast("int"))).alias("delay"))


@query("prices", "SELECT o_orderkey, (((o_orderkey * 37 + 11)::HUGEINT * (o_custkey + 5) + 999) // 1000)::BIGINT AS nanos FROM orders")
def prices(spark, sf):
    return model.table(spark, sf, "orders").select("o_orderkey", scalars.price(F.col("o_orderkey") * 37 + 11, F.col("o_custkey") + 5, F.lit(1000)).cast("long").alias("nanos"))
