"""The run ledger: replay of ordered events, transitions, attempts, budgets, rates and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Allowed changes of a run's state, of an attempt's phase and of a change's journal.
RUN_STATES = frozenset({("planned", "running"), ("planned", "stopped"), ("running", "paused"), ("running", "stopped"), ("running", "completed"), ("running", "failed"), ("paused", "running"), ("stopped", "running"), ("paused", "stopped")})
PHASES = ("reserved", "dispatch_intent", "received", "output_committed", "settled")
JOURNAL = frozenset({("prepared", "applying"), ("applying", "files_applied"), ("files_applied", "indexed"), ("indexed", "committed"), ("prepared", "aborted"), ("applying", "aborted"), ("prepared", "conflict"), ("applying", "conflict")})


def violations(events: DataFrame, key: str, order: list[str], state: str, allowed: frozenset, genesis: str) -> DataFrame:
    """Events that don't follow: a first event that isn't the genesis, a genesis that isn't first, a change that isn't allowed."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("before", F.lag(state).over(w))
    fine = F.concat_ws(">", "before", state).isin(*[f"{a}>{b}" for a, b in allowed])
    reason = F.when(F.col("before").isNull() & (F.col(state) != genesis), "no genesis").when(F.col("before").isNotNull() & (F.col(state) == genesis), "second genesis").when(F.col("before").isNotNull() & ~fine, "not allowed")
    return rows.withColumn("reason", reason).filter("reason is not null").select(key, *order, "before", state, "reason")


def final_state(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(key, state, events, last): a fold that keeps the last state, by partial aggregation."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("events"), F.max(F.struct(*order)).alias("last")).select(key, state, "events", *[F.col(f"last.{c}").alias(f"last_{c}") for c in order])


def clock_violations(events: DataFrame, key: str, sequence: str, ts: str) -> DataFrame:
    """Events that are older than the highest time before them."""
    w = Window.partitionBy(key).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("high", F.max(ts).over(w)).filter(F.col(ts) < F.col("high"))


def rate_window(events: DataFrame, key: str, ts: str, value: str, seconds: int = 60) -> DataFrame:
    """Requests and value of the seconds up to each event, its own included and the instant `seconds` ago not.

    Events are dealt by key and span of `seconds`; each also goes to the span behind its own, which may look back at it. So a
    task has two spans of a key and not its history.
    """
    micros, wide = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    rows = events.withColumn("_at", micros).withColumn("_own", F.floor(F.col("_at") / wide)).withColumn("_span", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(key, "_span").orderBy("_at").rangeBetween(-wide + 1, 0)
    out = rows.withColumn("requests", F.count("*").over(w)).withColumn("amount", F.sum(value).over(w))
    return out.filter("_own = _span").drop("_at", "_own", "_span")


def attempts(events: DataFrame) -> DataFrame:
    """Attempt events (task, attempt, seq, phase) that are out of turn: phases in order, attempts numbered from 1 without gaps."""
    number = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    w = Window.partitionBy("task", "attempt").orderBy("seq")
    rows = events.withColumn("step", number).withColumn("before", F.coalesce(F.lag("step").over(w), F.lit(0)))
    first = events.groupBy("task", "attempt").agg(F.min("seq").alias("seq"))
    numbered = first.withColumn("expected", F.row_number().over(Window.partitionBy("task").orderBy("seq")))
    bad = rows.filter("step <> before + 1").select("task", "attempt", "seq", F.lit("phase").alias("reason"))
    return bad.unionByName(numbered.filter("attempt <> expected").select("task", "attempt", "seq", F.lit("number").alias("reason")))


def recount(attempts_: DataFrame) -> DataFrame:
    """(currency, settled, held, attempts, unknown) from rows (attempt, state, currency, reserved, observed, actual).

    Settled attempts count actuals; released ones that were not sent nothing; every other one holds the larger of
    what was reserved and observed. unknown counts attempts of which neither is known.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    held = F.when(F.col("state").isin("settled", "released"), zero).otherwise(F.greatest(F.coalesce("reserved", zero), F.coalesce("observed", zero)))
    unknown = (F.col("state") != "settled") & (F.col("state") != "released") & F.col("reserved").isNull() & F.col("observed").isNull()
    return attempts_.groupBy("currency").agg(F.sum(F.when(F.col("state") == "settled", F.coalesce("actual", zero)).otherwise(zero)).alias("settled"), F.sum(held).alias("held"), F.count("*").alias("attempts"), F.count_if(unknown).alias("unknown"))


def single_cost(by_currency: DataFrame) -> DataFrame:
    """One row: the cost if there is one currency, null if there are several."""
    total = F.sum(F.col("settled") + F.col("held"))
    return by_currency.agg(F.when(F.count("*") <= 1, total).alias("cost"), F.count("*").alias("currencies"))


def merge_usage(events: DataFrame, key: str, order: list[str], classes: list[str]) -> DataFrame:
    """Each class's last known value: an unknown (null) one never erases a known one."""
    return events.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in classes])


def allowance(spent: DataFrame, limit: int, proposed: int) -> DataFrame:
    """(used, fits): settled and outstanding amounts, and whether a proposal still fits a lifetime allowance."""
    used = F.coalesce(F.sum(F.coalesce("settled", F.lit(0)) + F.coalesce("held", F.lit(0))), F.lit(0)).cast("decimal(38,0)")
    return spent.agg(used.alias("used")).withColumn("fits", F.col("used") + proposed <= limit)


def ready(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, priority, position): pending tasks whose dependencies are all completed, by priority, then key."""
    open_ = deps.join(tasks.select(F.col("key").alias("needs"), "state"), "needs", "left").filter("state is null or state <> 'completed'").select("key").distinct()
    return tasks.filter("state = 'pending'").join(open_, "key", "left_anti").select("key", "priority")
