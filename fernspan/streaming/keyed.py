"""Invoice memory as keyed streaming state: what a supplier has sent before, and what it sent in the last days.

The state of a supplier are the references seen, and by point in time the number and sum of its small invoices; timers drop those that
have left the window.  A micro-batch touches the suppliers that it has rows of and nothing else: no ledger is read.
Rows later than the watermark are dropped before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fernspan.session import ship

#: Rows that a supplier's state answers: the row's number, whether its reference was seen, earlier small invoices of the window, and the sum with this one.
ANSWERS = "supplier string, seq long, received_at timestamp, duplicate boolean, siblings long, split_total double, split boolean"


class SupplierMemory(StatefulProcessor):
    """Rows need supplier, seq, received_at, invoice_ref, amount; within a micro-batch they are taken by (received_at, seq)."""

    def __init__(self, limit: float, days: int):
        self.limit, self.window = limit, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "invoice_ref string", "seq long")
        self.small = handle.getMapState("small", "at long", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["received_at", "seq"])
        recent = {k[0]: (v[0], v[1]) for k, v in self.small.iterator()}
        out, fresh = [], set()
        for seq, at, ref, amount in zip(batch["seq"], batch["received_at"], batch["invoice_ref"], batch["amount"], strict=True):
            ms = at.value // 1_000_000
            duplicate = self.seen.containsKey((ref,))
            if not duplicate:
                self.seen.updateValue((ref,), (int(seq),))
            inside = [v for t, v in recent.items() if t >= ms - self.window]
            n, total = sum(v[0] for v in inside), sum(v[1] for v in inside) + amount
            high = amount > self.limit
            out.append((key[0], seq, at, duplicate, n, total, bool(n > 0 and total > self.limit and not high)))
            if not duplicate and not high:
                old = recent.get(ms, (0, 0.0))
                recent[ms] = (old[0] + 1, old[1] + amount)
                fresh.add(ms)
        for ms in fresh:
            self.small.updateValue((ms,), recent[ms])
            self.handle.registerTimer(ms + self.window + 1)
        yield pd.DataFrame(out, columns=["supplier", "seq", "received_at", "duplicate", "siblings", "split_total", "split"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs() - self.window - 1
        if self.small.containsKey((ms,)):
            self.small.removeKey((ms,))
        return iter(())

    def close(self) -> None:
        pass


def remembered(invoices: DataFrame, limit: float, days: int, late: str = "1 hour") -> DataFrame:
    """ANSWERS for a stream of invoices (supplier, seq, received_at, invoice_ref, amount)."""
    spark = invoices.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = invoices.select("supplier", "seq", "received_at", "invoice_ref", F.col("amount").cast("double").alias("amount")).withWatermark("received_at", late)
    return rows.groupBy("supplier").transformWithStateInPandas(statefulProcessor=SupplierMemory(limit, days), outputStructType=ANSWERS, outputMode="Append", timeMode="EventTime")
