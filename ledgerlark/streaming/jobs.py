"""Structured Streaming: alerts on arrival, sliding velocity windows, sessions of micro amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.functions.columns import money
from ledgerlark.functions.storage import materialize
from ledgerlark.operators.rules import active_rules, evaluate_rules, window_hours


KEY = ["txn_id", "rule_id"]


def stream_alerts(arriving: DataFrame, customers: DataFrame, rules: DataFrame, history_path: str, alerts_path: str, checkpoint: str, changes_path: str | None = None, hours: int | None = None) -> StreamingQuery:
    """Evaluates all rules on each micro-batch and writes its matches; with the changes, they equal the batch job however
    late a transaction arrives (``current_alerts``).

    A batch is joined with what its customers did within the longest window of the active rules (or ``hours``) around it,
    read from the history that earlier batches wrote, of those days alone. Transactions after a late one that share a
    customer with it are judged twice: on the history as it was and as it is now. Matches that are new go to ``alerts_path``;
    to ``changes_path``, if there is one, go those that no longer hold (``withdraw``) and those whose score or reason is
    another one (``update``). Earlier alerts are never read, so the cost of a batch doesn't grow with their number. All
    tables are partitioned by batch id, the history by day first; a batch that is tried again overwrites its own rows.
    Rules have to stay the same while a stream runs, and ids have to tell transactions apart."""
    reach = hours or max([1, *map(window_hours, active_rules(rules))])

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            span = F.make_interval(hours=F.lit(reach))
            first, last = (x.cast("timestamp") for x in map(F.lit, batch.agg(F.min("created_at"), F.max("created_at")).first()))
            days = batch.select(F.explode(F.sequence(F.to_date(first - span), F.to_date(last + span)))).distinct()
            held = [path for (day,) in sorted(days.collect()) if _exists(spark, path := f"{history_path}/day={day}")]
            seen = batch.limit(0)
            if held:
                stored = spark.read.schema(f"{_ddl(batch)}, day date, batch_id long").option("basePath", history_path).parquet(*held)
                seen = stored.filter((F.col("batch_id") < batch_id) & (F.col("created_at") >= first - span) & (F.col("created_at") <= last + span)).select(*batch.columns)
            touched = _customers(batch)
            # Transactions from the batch's first time on may match otherwise now; they need all of their customers' rows.
            again = _of(seen.filter(F.col("created_at") >= first), touched)
            past = materialize(_of(seen, touched.unionByName(_customers(again)).distinct()), "past")
            ids = again.select(F.col("id").alias("txn_id"))
            new = _judged(batch.unionByName(past), customers, rules, batch.select(F.col("id").alias("txn_id")).unionByName(ids))
            old = _judged(past, customers, rules, ids)
            new.join(old, KEY, "left_anti").write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")
            if changes_path:
                was = old.select(*KEY, F.struct("risk_score", "reason", "details").alias("_was"))
                update = new.join(was, KEY).filter(~F.struct("risk_score", "reason", "details").eqNullSafe(F.col("_was"))).drop("_was").withColumn("change", F.lit("update"))
                withdraw = old.join(new, KEY, "left_anti").withColumn("change", F.lit("withdraw"))
                update.unionByName(withdraw).write.mode("overwrite").parquet(f"{changes_path}/batch_id={batch_id}")
            parts = batch.withColumn("day", F.to_date("created_at")).withColumn("batch_id", F.lit(batch_id).cast("long"))
            parts.write.partitionBy("day", "batch_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(history_path)
        finally:
            batch.unpersist()

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _judged(txns: DataFrame, customers: DataFrame, rules: DataFrame, ids: DataFrame) -> DataFrame:
    return materialize(evaluate_rules(txns, customers, rules).join(ids.distinct(), "txn_id", "left_semi").dropDuplicates(KEY), "matches")


def current_alerts(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Matches that hold after all batches, each as the last batch that touched it left it. Both frames are what
    ``stream_alerts`` wrote, with their ``batch_id``."""
    told = alerts.withColumn("change", F.lit("add")).unionByName(changes)
    columns = [c for c in told.columns if c not in KEY]
    last = told.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "batch_id").alias("_l")).filter(F.col("_l.change") != "withdraw")
    return last.select(*KEY, *(F.col(f"_l.{c}").alias(c) for c in columns if c not in ("change", "batch_id"))).select(*(c for c in alerts.columns if c != "batch_id"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _customers(txns: DataFrame) -> DataFrame:
    return txns.select(F.explode(F.array("from_customer_id", "to_customer_id")).alias("_c")).filter(F.col("_c").isNotNull()).distinct()


def _of(txns: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions that one of the customers sends or receives, each once."""
    sides = [txns.join(customers.withColumnRenamed("_c", c), c, "left_semi") for c in ("from_customer_id", "to_customer_id")]
    return sides[0].unionByName(sides[1]).dropDuplicates(["id"])


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_velocity_windows(txns: DataFrame, late: str = "1 hour", length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Sliding counts and sums per sender; rows later than the watermark are dropped."""
    rows = txns.withWatermark("created_at", late).groupBy(F.window("created_at", length, step), F.col("from_customer_id").alias("customer_id"))
    return rows.agg(F.count("*").alias("n"), F.sum(money(F.col("amount"))).cast("double").alias("volume")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "customer_id", "n", "volume")


def customer_sessions(txns: DataFrame, most: float = 100.0, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Bursts of micro amounts of a sender with gaps of less than ``gap``; on a stream with a watermark, in batch without."""
    rows = txns.filter((F.col("amount") <= most) & F.col("from_customer_id").isNotNull())
    rows = rows.withWatermark("created_at", late) if late else rows
    found = rows.groupBy(F.session_window("created_at", gap), F.col("from_customer_id").alias("customer_id")).agg(F.count("*").alias("n"), F.sum(money(F.col("amount"))).cast("double").alias("volume"))
    return found.select("customer_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "volume")
