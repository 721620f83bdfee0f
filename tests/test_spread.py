"""Sliding windows cost the same however dense they are, rows without an order don't meet, texts are normalised once, shards are read in place."""

import io
import random
from contextlib import redirect_stdout

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fernspan.operators import ap, sgd, windows
from fernspan.plans import q_ap, q_similarity

SF = "/root/testdata/sf0.001"


def test_trailing_equals_a_range_window(spark):
    r = random.Random(6)
    rows = [(r.choice("aaab"), r.choice([None, *range(0, 300, 3)]), r.choice([None, 0.1, 0.2, 1.25, -3.5])) for _ in range(400)] + [("c", 5, None), ("d", 1, float("-inf")), ("d", 2, 1.0), ("d", 60, 1.0), (None, 7, 2.0)]
    d = spark.createDataFrame(rows, "k string, at long, v double")
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-40, 0)
    key = lambda x: (str(x[0]), -1 if x[1] is None else x[1])
    want = d.select("k", "at", F.count("v").over(w).alias("n"), F.round(F.sum("v").over(w), 6).alias("total")).groupBy("k", "at").agg(F.count("*").alias("rows"), F.max("n").alias("n"), F.max("total").alias("total"))
    got = windows.trailing(d, "k", "at", 40, "v").select("k", "at", "rows", "n", F.round("total", 6).alias("total"))
    assert [tuple(x) for x in sorted(got.collect(), key=key)] == [tuple(x) for x in sorted(want.collect(), key=key)]


def test_split_windows_are_running_sums(spark):
    with redirect_stdout(io.StringIO()) as out:
        q_ap.ap_split_window(spark, SF).explain("extended")
    assert "RangeFrame" not in out.getvalue()


def test_rows_without_an_order_are_spread_in_joins(spark, monkeypatch):
    rows = [(i, "T", f"I{i}", f"S{i % 3}", f"R{i}", "5.0", "", "no", "api") for i in range(50)]
    inv = spark.createDataFrame(rows, "seq long, team_id string, invoice_id string, supplier string, invoice_ref string, amount_usd string, po_id string, bank_changed string, channel string")
    po = spark.createDataFrame([(1, "P1", "S1", 5.0, "open")], "load_seq long, po_id string, supplier string, amount_usd double, status string")
    seen = spark.createDataFrame([], "invoice_id string, supplier string, invoice_ref string, amount_usd double, po_id string, status string, received_at timestamp")
    plans, plain = [], windows.with_first

    def seen_by(d, *rest):
        with redirect_stdout(io.StringIO()) as out:
            d.explain()
        plans.append(out.getvalue())
        return plain(d, *rest)

    monkeypatch.setattr(ap.windows, "with_first", seen_by)
    c = ap.triage(inv, po, seen, q_ap.NOW)
    joins = [x for x in plans[0].splitlines() if "Join" in x and "LeftOuter" in x]
    assert len(joins) == 4 and not any("[po_id#" in x for x in joins)
    assert {x["status"] for x in c.select("status").collect()} == {"REVIEW_MISSING_PO"} and c.count() == 50


@pytest.mark.parametrize("name", ["group_split", "split_overlap", "pinned_roles"])
def test_templates_are_made_once(spark, name):
    with redirect_stdout(io.StringIO()) as out:
        q_similarity.QUERIES[name](spark, SF).explain("extended")
    assert "regexp_replace" not in out.getvalue().lower()


def test_rows_of_a_shard_are_views():
    lists = pa.chunked_array([pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), pa.array([[4, 5]], pa.list_(pa.int32()))])
    got = sgd._views(lists)
    assert [x.tolist() for x in got] == [[1, 2], [], [3], [4, 5]] and not any(x.flags.owndata for x in got)
