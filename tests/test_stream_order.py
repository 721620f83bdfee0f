"""A part of a stream that several tasks wrote is one micro-batch, so none of its rows is late."""

import datetime as dt

from pyspark.sql import functions as F

from fernspan.plans.q_io import in_order
from fernspan.session import scratch_path
from fernspan.streaming import keyed, ledger


def test_parts_of_several_files(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("S", i, start + dt.timedelta(days=i), f"R{i % 35}", 100.0) for i in range(40)]
    inv = spark.createDataFrame(rows, "supplier string, seq long, received_at timestamp, invoice_ref string, amount double").repartition(3, F.col("seq"))
    stream, arrivals = in_order(inv, "received_at", scratch_path(spark, "order_test"), 2)
    out = ledger.run_once(keyed.remembered(stream, 10_000, 7), spark, "append", arrivals)
    got = {r["seq"]: (r["duplicate"], r["siblings"]) for r in out.collect()}
    assert got == {i: (i >= 35, sum(j < 35 for j in range(max(0, i - 7), i))) for i in range(40)}
