"""A crawl queue and event windows as Structured Streaming jobs.

The queue's state (claims, attempts, leases) follows from its event log; the same rules hold for a batch of the log and for a
stream of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Minutes after which a claim without an answer is free again, and attempts before an item has failed for good.
LEASE_MINUTES, ATTEMPTS = 30, 3


def queue_state(items: DataFrame, log: DataFrame, now: str | Column) -> DataFrame:
    """(id) items and their (id, ts, what: claim, done, error) log to status, attempts and whether they can be claimed now.

    done is final. After ATTEMPTS claims without success an item has failed. A claim younger than the lease holds the item.
    """
    told = log.groupBy("id").agg(
        F.count_if(F.col("what") == "claim").alias("attempts"),
        F.bool_or(F.col("what") == "done").alias("done"),
        F.max(F.when(F.col("what") == "claim", F.col("ts"))).alias("claimed_at"),
        F.max(F.when(F.col("what") == "error", F.col("ts"))).alias("error_at"),
    )
    at = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    held = (F.col("claimed_at") > at - F.make_interval(mins=F.lit(LEASE_MINUTES))) & F.coalesce(F.col("error_at") < F.col("claimed_at"), F.lit(True))
    status = F.when(F.col("done"), "done").when(held, "claimed").when(F.col("attempts") >= ATTEMPTS, "failed").otherwise("pending")
    joined = items.join(told, "id", "left").withColumns({"attempts": F.coalesce("attempts", F.lit(0)), "done": F.coalesce("done", F.lit(False))})
    return joined.withColumn("status", status).withColumn("free", F.col("status") == "pending")


def claim(state: DataFrame, n: int) -> DataFrame:
    """The next n free items by id."""
    return state.where("free").orderBy("id").limit(n)


def follow_queue(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, handle, ledger: str | None = None) -> StreamingQuery:
    """Work through a folder of items as they land: each micro-batch goes to ``handle`` (a DataFrame function) and its result to ``target``.

    An item is handled once by id, however often it lands and in whichever batch: handled ids go to a ``ledger`` (by default
    beside the checkpoint) with their batch, and a batch leaves out those of earlier ones. Of rows that share an id within a
    batch, the one of smallest content is taken. A restart goes on from the checkpoint; a batch that was cut off repeats and
    replaces what it had written, in ``target`` and in the ledger alike, as it ignores its own entries.
    """
    told = ledger or f"{checkpoint.rstrip('/')}-ledger"

    def work(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rest = [F.col(c) for c in batch.columns if c != "id"]
        new = batch.groupBy("id").agg(F.min(F.struct(*rest)).alias("row")).select("id", "row.*") if rest else batch.distinct()
        if number and _written(own, told):
            before = own.read.schema("id string, batch long").parquet(told).where(F.col("batch") < number)
            new = new.join(before, new["id"].cast("string") == before["id"], "left_anti")
        new = new.persist()  # handled and entered: read from the batch once
        try:
            handle(new).write.mode("overwrite").parquet(f"{target}/batch={number}")
            new.select(F.col("id").cast("string").alias("id")).write.mode("overwrite").parquet(f"{told}/batch={number}")
        finally:
            new.unpersist()

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def resumed(runs: DataFrame, caps: DataFrame) -> DataFrame:
    """Runs (run, source, status, capped, error, max_pages, max_places) ready to go on: capped and failed sources are pending
    again and lose their marks; a cap given in ``caps`` (run, max_pages, max_places) replaces the run's, a null leaves it."""
    again = F.col("status").isin("capped", "failed")
    given = caps.select("run", F.col("max_pages").alias("_pages"), F.col("max_places").alias("_places"))
    return runs.join(given, "run", "left").select(
        "run", "source", F.when(again, "pending").otherwise(F.col("status")).alias("status"),
        F.when(~F.coalesce(again, F.lit(False)), F.col("capped")).alias("capped"), F.when(~F.coalesce(again, F.lit(False)), F.col("error")).alias("error"),
        F.coalesce("_pages", "max_pages").alias("max_pages"), F.coalesce("_places", "max_places").alias("max_places"),
    )


def over_cap(runs: DataFrame) -> DataFrame:
    """Runs with ``stop``: why one must pause before its next item (pages first, then places), null if it may go on."""
    hit = lambda cap, done, name: F.when((F.col(cap) > 0) & (F.col(done) >= F.col(cap)), F.format_string(f"{name}=%d hit with %d item(s) still pending", cap, "pending"))
    stop = F.coalesce(hit("max_pages", "pages", "max_pages"), hit("max_places", "places", "max_places"))
    return runs.withColumn("stop", F.when(F.col("pending") > 0, stop))


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events and their value by type and tumbling window; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no farther apart than the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


def latest_positions(log: DataFrame) -> DataFrame:
    """The last log row of each item by time, then by order of kinds; a state store's view as a batch."""
    last = Window.partitionBy("id").orderBy(F.col("ts").desc(), F.col("what").asc())
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
