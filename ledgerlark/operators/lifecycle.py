"""Alert escalation and the block list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, count_if, stamp

ENTRY_TYPES = ["ip", "country", "entity", "email", "account"]
LIST_TYPES = ["black", "yellow", "white"]


def _stale(as_of: str, hours: int) -> Column:
    return (F.col("status") == "open") & (F.col("created_at") < ago(as_of, hours=hours)) & (F.col("severity") != "critical")


def _high(as_of: str, hours: int) -> Column:
    return F.col("status").isin("open", "under_review") & (F.col("severity") == "high") & (F.col("created_at") < ago(as_of, hours=hours))


def repeat_offenders(alerts: DataFrame, as_of: str, days: int = 7, least: int = 3) -> DataFrame:
    recent = alerts.filter((F.col("created_at") >= ago(as_of, days=days)) & (F.col("status") != "false_positive"))
    return recent.groupBy("customer_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _changed(alerts: DataFrame, test: Column, status: str | None, severity: str | None) -> DataFrame:
    hit = F.coalesce(test, F.lit(False))
    return alerts.withColumns({
        "_hit": hit, "status": F.when(hit & F.lit(status is not None), F.lit(status)).otherwise(F.col("status")),
        "severity": F.when(hit & F.lit(severity is not None), F.lit(severity)).otherwise(F.col("severity")),
    })


def escalate_stale(alerts: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    return _changed(alerts, _stale(as_of, hours), "escalated", "critical")


def escalate_high(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return _changed(alerts, _high(as_of, hours), None, "critical")


def escalate_repeat(alerts: DataFrame, as_of: str) -> DataFrame:
    often = repeat_offenders(alerts, as_of).select("customer_id", F.lit(True).alias("_often"))
    return _changed(alerts.join(often, "customer_id", "left"), F.col("_often") & (F.col("status") == "open"), "escalated", None).drop("_often")


def run_escalation(alerts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(alerts after all three, log of actions). Each step sees the result of the one before."""
    log, now = [], alerts
    for action, step in (("stale", escalate_stale), ("high", escalate_high), ("repeat", escalate_repeat)):
        after = step(now, as_of)
        log.append(after.filter("_hit").select("alert_id", F.lit(action).alias("action"), "status", "severity"))
        now = after.drop("_hit")
    return now, log[0].unionByName(log[1]).unionByName(log[2])


def escalation_candidates(alerts: DataFrame, as_of: str) -> DataFrame:
    often = repeat_offenders(alerts, as_of).agg(F.count("*").alias("repeat_customers"))
    return alerts.agg(count_if(_stale(as_of, 48)).alias("stale"), count_if(_high(as_of, 24)).alias("high")).crossJoin(often)


def live(entries: DataFrame, as_of: str) -> DataFrame:
    return entries.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= stamp(as_of))))


def blacklist_screen_transactions(txns: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """One row per side of a transaction whose country has a live entry, of any list."""
    listed = live(entries, as_of).filter(F.col("entry_type") == "country").select(F.lower(F.trim("value")).alias("value"), "entry_id", "list_type", "severity")
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.lower(c).alias("value")) for n, c in (("originating", "originating_country"), ("destination", "destination_country")))))
    rows = txns.select(F.col("id").alias("txn_id"), sides.alias("s")).select("txn_id", "s.side", "s.value").filter(F.col("value").isNotNull())
    return rows.join(listed, "value").select("txn_id", "side", F.col("value").alias("country"), "entry_id", "list_type", "severity")


def blacklist_status(pairs: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """``entry_type, value`` pairs with the live entry of each, the first by id; nulls where there is none."""
    rank = F.row_number().over(Window.partitionBy("entry_type", "_v").orderBy("entry_id"))
    listed = live(entries, as_of).withColumn("_v", F.lower(F.trim("value"))).withColumn("_k", rank).filter("_k = 1").select("entry_type", "_v", "list_type", "reason", "severity")
    return pairs.withColumn("_v", F.lower(F.trim("value"))).join(listed, ["entry_type", "_v"], "left").drop("_v")


def blacklist_merge(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to add, their first movement rows): valid types, one active row per type and value, the first wins."""
    value = F.lower(F.trim("value"))
    valid = new.withColumn("value", value).filter(F.col("entry_type").isin(ENTRY_TYPES) & F.col("list_type").isin(LIST_TYPES) & F.col("value").isNotNull())
    once = valid.withColumn("_k", F.row_number().over(Window.partitionBy("entry_type", "value").orderBy("entry_id"))).filter("_k = 1").drop("_k")
    active = entries.filter("is_active").select("entry_type", F.lower(F.trim("value")).alias("value"))
    added = once.join(active, ["entry_type", "value"], "left_anti")
    return added, added.select("entry_id", F.lit("none").alias("from_list"), F.col("list_type").alias("to_list"), "reason")


def blacklist_moves(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Current list and number of moves per entry: the last move's list, else the entry's own."""
    last = log.groupBy("entry_id").agg(F.max_by("to_list", F.struct("created_at", "log_id")).alias("to_list"), F.count("*").alias("moves"), F.max("created_at").alias("moved_at"))
    return entries.join(last, "entry_id", "left").select("entry_id", F.coalesce("to_list", "list_type").alias("current_list"), F.coalesce("moves", F.lit(0)).alias("moves"), "moved_at")


def blacklist_history(log: DataFrame) -> DataFrame:
    newest = Window.partitionBy("entry_id").orderBy(F.desc("created_at"), F.desc("log_id"))
    return log.withColumn("place", F.row_number().over(newest)).select("entry_id", "place", "from_list", "to_list", "reason", "created_at")


def blacklist_stats(entries: DataFrame) -> DataFrame:
    """Active entries in all, by type and by list; zeros are kept."""
    kinds = [("total", "all"), *(("type", v) for v in ENTRY_TYPES), *(("list", v) for v in LIST_TYPES)]
    frame = entries.sparkSession.createDataFrame(kinds, "kind string, name string")
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in (("total", F.lit("all")), ("type", F.col("entry_type")), ("list", F.col("list_type"))))))
    found = entries.filter("is_active").select(keys.alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("n"))
    return frame.join(found, ["kind", "name"], "left").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))
