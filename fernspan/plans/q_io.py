"""Queries: sources, sinks and streams. Tables are written in a foreign format to the shared folder and loaded back."""

from __future__ import annotations

import datetime as dt
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fernspan.plans import q_ap
from fernspan.session import scratch_path, table
from fernspan.sources import loaders, stores
from fernspan.streaming import keyed as K
from fernspan.streaming import ledger as L


def _labelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    flat = F.regexp_replace("text", r"[\t\r\n]+", " ")
    return d.select("doc_id", flat.alias("text"), F.when(F.col("toxic") == 1, "phishing").when(F.col("quality") == 0, "1").otherwise("legit").alias("label"))


def _summary(df):
    return df.groupBy("source", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def source_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    _labelled(spark, sf).select("label", "text").write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").csv(path)
    return _summary(loaders.load_tsv(spark, path))


def source_csv_roles(spark, sf):
    path = scratch_path(spark, "csv")
    d = _labelled(spark, sf)
    d.select(F.col("doc_id").alias("no"), F.col("label").alias("category"), F.col("text").alias("body")).write.option("header", "true").option("escape", '"').csv(path)
    return _summary(loaders.load_csv(spark, path))


def source_xml(spark, sf):
    path = scratch_path(spark, "xml")
    c = table(spark, sf, "conversations")
    country = F.when(F.col("conv_id") % 2 == 0, " sg ").otherwise("MY")
    c.select(F.regexp_replace("text", r"[<>&]", "").alias("text"), F.struct(F.struct(country.alias("country")).alias("userProfile")).alias("source")).write.format("xml").option("rowTag", "message").option("rootTag", "corpus").save(path)
    return _summary(loaders.load_xml(spark, path)).select("source", "label", "n")


def source_rate_feed(spark, sf):
    """Average order prices by day and priority as a feed of nested cubes, loaded back."""
    path = scratch_path(spark, "feed")
    o = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.round(F.avg("o_totalprice"), 4).alias("r"))
    cube = F.concat(F.lit('<Cube currency="c'), "p", F.lit('" rate="'), F.col("r").cast("string"), F.lit('"/>'))
    day = o.groupBy("d").agg(F.concat_ws("", F.collect_list(cube)).alias("cubes")).select(F.concat(F.lit('<Cube time="'), F.col("d").cast("string"), F.lit('">'), "cubes", F.lit("</Cube>")).alias("x"))
    day.agg(F.concat(F.lit("<Envelope><Cube>"), F.concat_ws("", F.collect_list("x")), F.lit('<Cube time="n/a"><Cube currency="USD" rate="1"/></Cube></Cube></Envelope>')).alias("value")).write.text(path)
    return loaders.load_rate_feed(spark, path).withColumn("rate_date", F.col("rate_date").cast("string"))


def source_invoices(spark, sf):
    """Customers as a CSV of open invoices: blanks trimmed, currencies in upper case, unreadable amounts and dates null."""
    path = scratch_path(spark, "invoices")
    c = table(spark, sf, "customer")
    amount = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.format_string(" %.2f", F.col("c_acctbal")))
    due = F.when(F.col("c_custkey") % 5 == 0, "soon").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 90).cast("int")).cast("string"))
    c.select(F.format_string(" INV-%d ", F.col("c_custkey")).alias("invoice_id"), F.when(F.col("c_custkey") % 2 == 0, " usd").otherwise("Eur ").alias("currency"), amount.alias("amount"), due.alias("due_date")).write.option("header", "true").csv(path)
    return loaders.load_invoices(spark, path).select("invoice_id", "currency", F.round("amount", 2).alias("amount"), F.col("due_date").cast("string").alias("due_date"))


def source_all(spark, sf):
    """Registry: available sources are united, a missing one is skipped."""
    path = scratch_path(spark, "tsv")
    _labelled(spark, sf).select("label", "text").write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").csv(path)
    every = loaders.load_all(spark, {"a": lambda: loaders.load_tsv(spark, path, "a"), "gone": lambda: loaders.load_tsv(spark, path + "_gone"), "b": lambda: loaders.load_tsv(spark, path, "b")})
    return loaders.require_target(every, "smishing").groupBy("source", "label").agg(F.count("*").alias("n"))


def source_binary(spark, sf):
    """Files in class folders, as images come: class from the folder, digest of the bytes."""
    path = scratch_path(spark, "files")
    b = table(spark, sf, "benchmark")
    # one text file for each class folder
    b.select(F.when(F.col("item_id") % 2 == 0, "NORMAL").otherwise("PNEUMONIA").alias("cls"), "text").write.partitionBy("cls").text(path)
    f = loaders.load_images(spark, path, ("txt",))
    return f.groupBy(F.regexp_replace("cls", "cls=", "").alias("cls")).agg(F.countDistinct("md5").alias("digests"), (F.sum("size") > 0).alias("filled"))


def _png(label: pd.Series, vector: pd.Series) -> pd.Series:
    """Vectors as small pictures, grey or in colour by the label: eight cells a row."""
    out = []
    for n, v in zip(label, vector, strict=True):
        cells = np.clip(np.asarray(v, float) * 128 + 128, 0, 255).astype(np.uint8).reshape(-1, 8)
        deep = np.repeat(cells, 3, axis=1) if n % 2 else cells
        raw = b"".join(b"\0" + r.tobytes() for r in deep)
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, len(cells), 8, 2 if n % 2 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    return pd.Series(out)


def image_table(spark, sf):
    """Embeddings as PNG pictures in class folders: size, colour mode, class and patient of every one."""
    _png.__annotations__ = {"label": pd.Series, "vector": pd.Series, "return": pd.Series}
    e = table(spark, sf, "embeddings").filter(F.size("embedding") % 8 == 0)
    where = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("x/PNEUMONIA/person"), F.col("vec_id").cast("string"), F.lit("_virus_1.png"))).otherwise(F.concat(F.lit("x/NORMAL/IM-"), F.lpad(F.col("vec_id").cast("string"), F.greatest(F.lit(4), F.length(F.col("vec_id").cast("string"))), F.lit("0")), F.lit("-01.png")))
    r = loaders.image_rows(e.select(where.alias("path"), F.pandas_udf(_png, "binary")("label", "embedding").alias("content")))
    return r.select("file", "cls", "patient", "width", "height", "mode", "aspect")


def sink_json(spark, sf):
    """Counts of documents by language and source as JSON objects with a nested list, read back."""
    path = scratch_path(spark, "results")
    d = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.max(F.when(F.col("n_chars") > 100_000, F.col("n_chars"))).alias("huge"))
    by = d.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.max("huge").alias("huge"))
    stores.write_json(by, path)
    back = spark.read.schema(by.schema).json(path)
    return back.select("lang", "huge", F.explode("sources").alias("s")).select("lang", "huge", "s.source", "s.n")


def sink_splits(spark, sf):
    path = scratch_path(spark, "splits")
    d = table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", r"[\r\n]", " ").alias("text"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    stores.write_splits(d, path)
    back = spark.read.option("basePath", path).csv(path, header=True, escape='"', schema="doc_id long, lang string, text string, split string")
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"), F.sum(F.length("text")).alias("chars"))


def sink_append(spark, sf):
    """Two appends of quoted text with commas, quotes and line breaks come back whole."""
    path = scratch_path(spark, "append")
    c = table(spark, sf, "conversations").select("conv_id", F.concat(F.lit('say "'), F.col("text"), F.lit('", then,\nend')).alias("message"))
    for k in (0, 1):
        stores.append_csv(c.filter(F.col("conv_id") % 2 == k), path)
    return stores.read_csv(spark, path, "conv_id long, message string").agg(F.count("*").alias("n"), F.sum("conv_id").alias("id_sum"), F.sum(F.length("message")).alias("chars"))


def keyed_table(spark, sf):
    """Insert all suppliers, update some, delete some and insert one of them again, write all anew, read what there is."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    t = stores.KeyedTable(spark, scratch_path(spark, "keyed"), "s_suppkey long, s_name string, s_acctbal double").ensure()
    t.insert(s, 1, "s_suppkey")
    t.update(s.filter(F.col("s_suppkey") % 3 == 0).withColumn("s_acctbal", F.lit(0.0)), 2, "s_suppkey")
    t.delete(s.filter(F.col("s_suppkey") % 7 == 0).select("s_suppkey"), 3, "s_suppkey")
    t.compact()
    t.insert(s.filter(F.col("s_suppkey") % 14 == 0), 4, "s_suppkey")
    t.insert(s, 4, "s_suppkey")  # a batch that comes again changes nothing
    return t.rows().select("s_suppkey", "s_name", "s_acctbal", "version")


def _stream(spark, sf, name):
    """A table's file as a stream: the folder, filtered by the file's name."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_daily(spark, sf):
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = L.run_once(L.windowed_counts(e, "1 day", "1 hour"), spark)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_ledger(spark, sf):
    """Orders as a stream of invoices into a ledger."""
    live = _stream(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    inv = live.select(k.alias("seq"), F.lit("T").alias("team_id"), F.concat(F.lit("I"), k.cast("string")).alias("invoice_id"), F.concat(F.lit("S"), (c % 50).cast("string")).alias("supplier"), F.concat(F.lit("R"), (k % 999).cast("string")).alias("invoice_ref"), F.col("o_totalprice").cast("string").alias("amount_usd"), F.lit("").alias("po_id"), F.lit("no").alias("bank_changed"), F.lit("api").alias("channel"))
    po = q_ap.po_master(spark, sf)
    t = stores.KeyedTable(spark, scratch_path(spark, "ledger"), L.LEDGER)
    q = L.stream_triage(inv, po, t, scratch_path(spark, "ledger_check"), dt.datetime(2024, 1, 31))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return t.rows().groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("supplier").alias("suppliers"))


def stream_sliding(spark, sf):
    """Events by type in windows of two days that begin every day."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = L.run_once(L.windowed_counts(e, "2 days", "1 hour", "1 day"), spark)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf):
    """Sessions of each user, ended by six hours without an event."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = L.run_once(L.sessions(e, "6 hours", "1 hour"), spark)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", text("start").alias("start"), text("end").alias("end"), "n")


def in_order(rows, at, folder, parts=6):
    """A stream of rows and its arrivals by time; a part has as many files as tasks wrote it, so none of them is a batch of its own."""
    cuts = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    part = sum(((F.col(at) > c).cast("int") for c in cuts), F.lit(0))
    rows.limit(0).write.parquet(f"{folder}/none")
    arrivals = [lambda k=k: rows.filter(part == k).write.parquet(f"{folder}/{k}") for k in range(parts)]
    return rows.sparkSession.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder), arrivals


def stream_memory(spark, sf):
    """Orders as a stream of invoices in time order, each told by its supplier's keyed state: reference seen, small invoices of seven days."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    inv = table(spark, sf, "orders").select(F.concat(F.lit("S"), (c % 97).cast("string")).alias("supplier"), k.alias("seq"), F.col("o_orderdate").cast("timestamp").alias("received_at"), F.concat(F.lit("R"), (k % 499).cast("string")).alias("invoice_ref"), (F.floor(F.col("o_totalprice") * 100 / 30) / 100).alias("amount"))
    stream, arrivals = in_order(inv, "received_at", scratch_path(spark, "memory_in"))
    out = L.run_once(K.remembered(stream, 10_000, 7), spark, "append", arrivals)
    return out.select("supplier", "seq", "duplicate", "siblings", F.round("split_total", 2).alias("split_total"), "split")


QUERIES = {f.__name__: f for f in (source_tsv, source_csv_roles, source_xml, source_rate_feed, source_invoices, source_all, source_binary, image_table, sink_json, sink_splits, sink_append, keyed_table, stream_daily, stream_ledger, stream_sliding, stream_sessions, stream_memory)}

_L = "WITH l AS (SELECT regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g') AS text, CASE WHEN toxic = 1 THEN 'smishing' WHEN quality = 0 THEN 'spam' ELSE 'ham' END AS label FROM documents JOIN labels USING (doc_id))"
ORACLES = {
    "image_table": "SELECT CASE WHEN vec_id % 3 = 0 THEN 'person' || vec_id || '_virus_1.png' ELSE 'IM-' || lpad(vec_id::VARCHAR, greatest(4, length(vec_id::VARCHAR))::INT, '0') || '-01.png' END AS file, CASE WHEN vec_id % 3 = 0 THEN 'PNEUMONIA' ELSE 'NORMAL' END AS cls, CASE WHEN vec_id % 3 = 0 THEN 'person' || vec_id ELSE 'IM-' || lpad(vec_id::VARCHAR, greatest(4, length(vec_id::VARCHAR))::INT, '0') END AS patient, 8 AS width, (len(embedding) // 8)::INT AS height, CASE WHEN label % 2 = 1 THEN 'RGB' ELSE 'L' END AS mode, round(8 / (len(embedding) // 8), 2) AS aspect FROM embeddings WHERE len(embedding) % 8 = 0",
    "sink_json": "SELECT lang, max(max(CASE WHEN n_chars > 100000 THEN n_chars END)) OVER (PARTITION BY lang) AS huge, source, count(*) AS n FROM documents GROUP BY lang, source",
    "source_tsv": _L + " SELECT 'tsv' AS source, label, count(*) AS n, cast(sum(length(text)) AS BIGINT) AS chars FROM l GROUP BY label",
    "source_csv_roles": _L + " SELECT 'csv' AS source, label, count(*) AS n, cast(sum(length(text)) AS BIGINT) AS chars FROM l GROUP BY label",
    "source_xml": "SELECT 'xml' AS source, 'ham' AS label, count(*) AS n FROM conversations WHERE conv_id % 2 = 0",
    "source_rate_feed": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS rate_date, 'C' || left(o_orderpriority, 1) AS currency, round(avg(o_totalprice), 4) AS eur_rate FROM orders GROUP BY 1, 2",
    "source_invoices": "SELECT 'INV-' || c_custkey AS invoice_id, CASE WHEN c_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal::DOUBLE, 2) END AS amount, CASE WHEN c_custkey % 5 <> 0 THEN strftime(DATE '2024-01-01' + (c_custkey % 90)::INT, '%Y-%m-%d') END AS due_date FROM customer",
    "source_all": _L + " SELECT s AS source, label, count(*) AS n FROM l, (VALUES ('a'), ('b')) v(s) GROUP BY ALL",
    "sink_splits": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, cast(sum(doc_id) AS BIGINT) AS id_sum, cast(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "sink_append": "SELECT count(*) AS n, cast(sum(conv_id) AS BIGINT) AS id_sum, cast(sum(length(text) + 17) AS BIGINT) AS chars FROM conversations",
    "keyed_table": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 14 <> 0 THEN 0.0 ELSE s_acctbal END::DOUBLE AS s_acctbal, CASE WHEN s_suppkey % 14 = 0 THEN 4 WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM supplier WHERE s_suppkey % 7 <> 0 OR s_suppkey % 14 = 0",
    "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS day, event_type, value FROM events) GROUP BY ALL",
    "stream_sessions": """WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS first FROM events),
        s AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_memory": """WITH i AS (SELECT 'S' || o_custkey % 97 AS supplier, o_orderkey AS seq, o_orderdate::DATE AS d, 'R' || o_orderkey % 499 AS ref, floor(o_totalprice * 100 / 30) / 100 AS amount FROM orders),
        j AS (SELECT *, row_number() OVER (PARTITION BY supplier, ref ORDER BY d, seq) > 1 AS duplicate FROM i),
        n AS (SELECT a.supplier, a.seq, a.amount, a.duplicate, count(b.seq) AS siblings, coalesce(sum(b.amount), 0) + a.amount AS total FROM j a LEFT JOIN j b ON b.supplier = a.supplier AND NOT b.duplicate AND b.amount <= 10000 AND b.d >= a.d - INTERVAL 7 DAY AND (b.d < a.d OR b.d = a.d AND b.seq < a.seq) GROUP BY a.supplier, a.seq, a.amount, a.duplicate)
        SELECT supplier, seq, duplicate, siblings, round(total, 2) AS split_total, siblings > 0 AND total > 10000 AND amount <= 10000 AS split FROM n""",
    "stream_ledger": "WITH i AS (SELECT o_custkey % 50 AS s, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 999 ORDER BY o_orderkey) > 1 AS dup FROM orders) SELECT CASE WHEN dup THEN 'HOLD_DUPLICATE' ELSE 'REVIEW_MISSING_PO' END AS status, count(*) AS n, count(DISTINCT s) AS suppliers FROM i GROUP BY 1",
}
