"""Structured Streaming: a ledger fed by micro-batches, and windowed event counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspan.operators import ap
from fernspan.session import keep, scratch_path
from fernspan.sources.stores import KeyedTable

LEDGER = "case_id string, invoice_id string, supplier string, invoice_ref string, amount_usd double, po_id string, status string, priority string, control_flags string, received_at timestamp"


def stream_triage(invoices: DataFrame, po: DataFrame, ledger: KeyedTable, checkpoint: str, now: dt.datetime):
    """Each micro-batch is judged against the ledger as the batches before left it, then appended; one query serialises them.

    A batch that is run again after a failure is judged against the version before its own rows, and committed once.
    """

    def one(batch: DataFrame, number: int) -> None:
        seen = ledger.rows(ledger.before(number + 1))
        cases = keep(ap.triage(batch, po, seen, now + dt.timedelta(minutes=number)), "stream_cases")
        ledger.insert(cases.select(*[f.split()[0] for f in LEDGER.split(", ")]), number + 1, "case_id")

    return invoices.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type, rows later than the watermark dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_once(stream: DataFrame, spark: SparkSession, mode: str = "complete", arrivals: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table of the shared folder.

    Complete results replace each other batch by batch; appended ones gather.  arrivals are called one after the other, each to bring
    more rows: what one brings, in however many files, is one micro-batch, and the next comes when its state is written.
    """
    out, check = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_check")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    for arrive in arrivals or (lambda: None,):
        arrive()
        q = stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)
