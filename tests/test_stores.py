"""The keyed table under several writers, and streams over it and over keyed state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fernspan.session import scratch_path
from fernspan.sources.stores import Conflict, KeyedTable
from fernspan.streaming import keyed, ledger

SCHEMA = "k long, v string"


def rows(t, number=None):
    return sorted((r["k"], r["v"]) for r in t.rows(number).collect())


def frame(spark, *pairs):
    return spark.createDataFrame([*pairs], SCHEMA)


def test_of_two_writers_one_is_refused(spark):
    path = scratch_path(spark, "stores")
    a, b = KeyedTable(spark, path, SCHEMA), KeyedTable(spark, path, SCHEMA)
    assert rows(a) == [] and a.version() == 0
    a.insert(frame(spark, (1, "a"), (2, "b")), 1, "k")
    seen = b.version()
    a.commit(frame(spark, (1, "a2")), 2, "k", base=seen)
    with pytest.raises(Conflict):
        b.commit(frame(spark, (1, "b2")), 3, "k", base=seen)
    assert rows(b) == [(1, "a2"), (2, "b")]
    b.commit(frame(spark, (1, "b2")), 3, "k", base=b.version())
    assert rows(a) == [(1, "b2"), (2, "b")] and rows(a, 1) == [(1, "a"), (2, "b")]  # older versions stay readable
    with pytest.raises(Conflict):
        a._put({"number": a.version(), "batches": [], "folders": []})


def test_a_blind_writer_goes_on_top(spark, monkeypatch):
    t = KeyedTable(spark, scratch_path(spark, "stores"), SCHEMA)
    t.insert(frame(spark, (1, "a")), 1, "k")
    put, raced = t._put, []

    def late(manifest):
        if not raced:  # another writer comes between reading the log and the rename
            raced.append(1)
            KeyedTable(spark, t.path, SCHEMA).insert(frame(spark, (2, "other")), 7, "k")
        put(manifest)

    monkeypatch.setattr(t, "_put", late)
    t.insert(frame(spark, (3, "mine")), 2, "k")
    assert rows(t) == [(1, "a"), (2, "other"), (3, "mine")] and t.version() == 3


def test_deletes_compaction_and_vacuum(spark):
    t = KeyedTable(spark, scratch_path(spark, "stores"), SCHEMA)
    t.insert(frame(spark, *((i, "x") for i in range(10))), 1, "k")
    t.delete(spark.range(3).select(F.col("id").alias("k")), 2, "k")
    t.insert(frame(spark, (0, "again"), (5, "new")), 3, "k")
    want = [(0, "again"), *((i, "new" if i == 5 else "x") for i in range(3, 10))]
    assert rows(t) == want
    t.compact()
    assert rows(t) == want and len(t.manifest()["folders"]) == 1
    live = t.manifest()["folders"][0]["folder"]
    assert all(live in f for f in t.rows().inputFiles())  # reads touch live files only
    t.vacuum()
    assert rows(t) == want and t._log() == [4]
    t.insert(frame(spark, (0, "late")), 3, "k")
    assert rows(t) == want  # a batch that was committed is not committed again, compacted or not
    t.reset()
    assert rows(t) == []


def test_many_changes_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(KeyedTable, "MOST_CHANGES", 3)
    t = KeyedTable(spark, scratch_path(spark, "stores"), SCHEMA)
    for n in range(7):
        t.insert(frame(spark, (n % 2, f"v{n}")), n, "k")
    assert rows(t) == [(0, "v6"), (1, "v5")] and len(t.manifest()["folders"]) <= 4


def test_a_retried_batch_sees_what_it_saw_before(spark):
    t = KeyedTable(spark, scratch_path(spark, "stores"), SCHEMA)
    t.insert(frame(spark, (1, "old")), 1, "k")
    t.insert(frame(spark, (1, "mine"), (2, "mine")), 2, "k")
    assert rows(t, t.before(2)) == [(1, "old")] and rows(t, t.before(3)) == [(1, "mine"), (2, "mine")]


def test_keyed_state_over_many_batches(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=n)
    data = [  # supplier, seq, at, reference, amount
        [("S", 1, day(0), "r1", 6000.0), ("S", 2, day(0), "r1", 100.0), ("T", 3, day(0), "r1", 9000.0)],
        [("S", 5, day(3), "r3", 1.0), ("S", 4, day(3), "r2", 4500.0)],
        [("S", 6, day(7), "r4", 5000.0), ("T", 7, day(7, 1), "r2", 2000.0)],
        [("S", 8, day(30), "r1", 5000.0), ("T", 9, day(30), "r9", 20_000.0)],
        [("S", 10, day(2), "late", 5000.0)],  # later than the watermark: dropped
    ]
    schema = "supplier string, seq long, received_at timestamp, invoice_ref string, amount double"
    folder = scratch_path(spark, "memory")
    for n, rows_ in enumerate(data):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{folder}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    out = ledger.run_once(keyed.remembered(stream, 10_000, 7), spark, "append")
    got = {r["seq"]: (r["duplicate"], r["siblings"], r["split_total"], r["split"]) for r in out.collect()}
    assert got == {
        1: (False, 0, 6000.0, False), 2: (True, 1, 6100.0, False), 3: (False, 0, 9000.0, False), 4: (False, 1, 10_500.0, True), 5: (False, 2, 10_501.0, True),
        6: (False, 3, 15_501.0, True), 7: (False, 0, 2000.0, False), 8: (True, 0, 5000.0, False), 9: (False, 0, 20_000.0, False),
    }
