"""Queries: currency exposure. Daily averages of events by type play the rate series, orders play the open invoices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fernspan.functions import rules as R
from fernspan.operators import fx
from fernspan.session import table

REF = dt.date(2024, 1, 25)
RUN = dt.date(2024, 1, 27)
NAMES = {"view": "SGD", "click": "USD", "signup": "JPY", "error": "GBP", "purchase": "AUD"}


def rates(spark, sf):
    name = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("rate_date"), F.try_element_at(name, F.col("event_type")).alias("currency")).agg(F.avg("value").alias("eur_rate"))


def today(spark, sf):
    r = rates(spark, sf).filter(F.col("rate_date") == F.lit(REF)).select("currency", "eur_rate")
    return r.unionByName(spark.createDataFrame([("EUR", 1.0), ("CHF", 0.95)], "currency string, eur_rate double"))


def stats(spark, sf):
    return fx.stats(rates(spark, sf), today(spark, sf), REF, dod=1.0, off=2.0)


def invoices(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ccy = F.get(F.array(*map(F.lit, ["usd", "JPY ", "GBP", "AUD", "SGD", "EUR", "XYZ", "CHF"])), F.pmod(c, F.lit(8)).cast("int"))
    return o.select(F.concat(F.lit("INV-"), k.cast("string")).alias("invoice_id"), F.concat(F.lit("S"), c.cast("string")).alias("supplier"), ccy.alias("currency"), F.when(k % 97 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("amount"), F.date_add(F.lit(RUN), (F.pmod(k, F.lit(60)) - 10).cast("int")).alias("due_date"))


def exposure(spark, sf):
    return fx.exposure(invoices(spark, sf), stats(spark, sf), RUN, REF)


R4 = lambda c: F.round(c, 4).alias(c)


def fx_cross_rates(spark, sf):
    c = fx.cross_rates(rates(spark, sf))
    return c.select(F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), "currency", F.round("rate", 6).alias("rate"))


def fx_trailing_stats(spark, sf):
    t = fx.trailing(fx.cross_rates(rates(spark, sf)), 5)
    return t.select("currency", F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), *(F.round(c, 6).alias(c) for c in ("avg_n", "lo_n", "hi_n", "prev_rate")), "days", F.round("dod_pct", 4).alias("dod_pct"))


def fx_stats(spark, sf):
    s = stats(spark, sf)
    return s.select("currency", *(F.round(c, 6).alias(c) for c in ("today", "prev", "avg", "lo", "hi")), F.date_format("prev_date", "yyyy-MM-dd").alias("prev_date"), "days", R4("dod_pct"), R4("vs_avg_pct"), "alert")


def fx_exposure(spark, sf):
    e = exposure(spark, sf)
    return e.select("invoice_id", "supplier", "currency", "days_to_due", "payment_bucket", F.round("sgd_per_unit", 6).alias("sgd_per_unit"), *(F.round(c, 3).alias(c) for c in ("amount_sgd", "amount_sgd_at_1m_high", "fx_risk_sgd")), "status", F.regexp_replace("note", r"\(.*\)", "").alias("note"))


def fx_totals(spark, sf):
    t = fx.totals(exposure(spark, sf))
    return t.select("currency", "n", *(F.round(c, 2).alias(c) for c in ("amount", "sgd", "risk")))


def fx_run_log(spark, sf):
    t = fx.run_totals(exposure(spark, sf))
    return t.select("invoices", "exceptions", "overdue", *(F.round(c, 1).alias(c) for c in ("exposure_sgd", "fx_risk_sgd", "due_week_sgd")))


def fx_alerts(spark, sf):
    a = fx.alert_rows(stats(spark, sf), exposure(spark, sf))
    return a.groupBy("alert_type", "currency").agg(F.count("*").alias("n"), F.min("detail").alias("first_detail"), F.min(F.when(F.col("alert_type") != "FX_MOVE", F.col("message"))).alias("first_message"))


def fx_append_once(spark, sf):
    r = rates(spark, sf)
    have = r.filter(F.dayofmonth("rate_date") % 3 == 0)
    return fx.append_once(have, r).select(F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), "currency", F.round("eur_rate", 6).alias("eur_rate"))


def fx_reconcile(spark, sf):
    e = exposure(spark, sf)
    other = e.filter(F.col("days_to_due") != 5).withColumn("amount_sgd", F.col("amount_sgd") + F.when(F.col("days_to_due") == 7, 0.5).otherwise(0.001))
    return fx.reconcile(e, other, "invoice_id", "amount_sgd").groupBy("state").agg(F.count("*").alias("n"))


def fx_settings(spark, sf):
    """Nations as rows of a settings table: two of them set something, one is no number, the others are not known."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    name = F.when(k == 1, "dod_alert_pct").when(k == 10, " history_days ").when(k == 7, "avg_alert_pct").otherwise(F.col("n_name"))
    value = F.when(k == 7, F.col("n_name")).when(k == 10, F.concat(k.cast("string"), F.lit(".4"))).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return fx.settings(n.select(name.alias("setting"), value.alias("value")))


def fx_formats(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", R.signed_percent(F.floor(F.col("o_totalprice") - 250000) / 100).alias("pct"), F.date_format(R.long_date(F.date_format("o_orderdate", "d MMMM yyyy")), "yyyy-MM-dd").alias("day"))
    return d


QUERIES = {f.__name__: f for f in (fx_cross_rates, fx_trailing_stats, fx_stats, fx_exposure, fx_totals, fx_run_log, fx_alerts, fx_append_once, fx_reconcile, fx_settings, fx_formats)}

_R = "WITH r AS (SELECT cast(ts AS DATE) AS rate_date, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items()) + """ END AS currency, avg(value) AS eur_rate FROM events GROUP BY ALL),
b AS (SELECT rate_date, eur_rate AS base_rate FROM r WHERE currency = 'SGD'),
c AS (SELECT rate_date, currency, base_rate / eur_rate AS rate FROM r JOIN b USING (rate_date) WHERE currency <> 'SGD' UNION ALL SELECT rate_date, 'EUR', base_rate FROM b)"""
_S = _R + """,
td AS (SELECT currency, eur_rate FROM r WHERE rate_date = DATE '2024-01-25' UNION ALL SELECT 'EUR', 1.0 UNION ALL SELECT 'CHF', 0.95::DOUBLE),
nw AS (SELECT currency, CASE WHEN currency = 'EUR' THEN (SELECT eur_rate FROM td WHERE currency = 'SGD') ELSE (SELECT eur_rate FROM td WHERE currency = 'SGD') / eur_rate END AS today FROM td WHERE currency <> 'SGD'),
h AS (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY rate_date DESC) AS n FROM c WHERE rate_date <= DATE '2024-01-25'),
g AS (SELECT currency, count(*) FILTER (n <= 22) AS days, sum(rate) FILTER (n <= 22) AS total, min(rate) FILTER (n <= 22) AS lo0, max(rate) FILTER (n <= 22) AS hi0, max(rate_date) FILTER (rate_date < DATE '2024-01-25') AS prev_date, arg_max(rate, rate_date) FILTER (rate_date < DATE '2024-01-25') AS prev0 FROM h GROUP BY currency),
s0 AS (SELECT nw.currency, today, prev_date, coalesce(prev0, today) AS prev, coalesce(total / days, today) AS avg, least(today, lo0) AS lo, greatest(today, hi0) AS hi, coalesce(days, 0) AS days FROM nw LEFT JOIN g USING (currency)),
s1 AS (SELECT *, (today / prev - 1) * 100 AS dod_pct, (today / avg - 1) * 100 AS vs_avg_pct FROM s0),
s AS (SELECT *, concat_ws('|', CASE WHEN abs(dod_pct) >= 1 THEN 'DAILY_MOVE' END, CASE WHEN abs(vs_avg_pct) >= 2 THEN 'OFF_1M_AVERAGE' END, CASE WHEN days = 0 THEN 'NO_HISTORY' END) AS alert FROM s1
  UNION ALL SELECT 'SGD', 1, NULL, 1, 1, 1, 1, 0, 0, 0, ''),
i AS (SELECT 'INV-' || o_orderkey AS invoice_id, 'S' || o_custkey AS supplier, ['USD','JPY','GBP','AUD','SGD','EUR','XYZ','CHF'][o_custkey % 8 + 1] AS currency, CASE WHEN o_orderkey % 97 = 0 THEN 0.0 ELSE o_totalprice END AS amount, (o_orderkey % 60 - 10)::INT AS days_to_due FROM orders),
e AS (SELECT i.*, CASE WHEN days_to_due < 0 THEN 'OVERDUE' WHEN days_to_due <= 7 THEN 'DUE_THIS_WEEK' WHEN days_to_due <= 30 THEN 'DUE_30_DAYS' ELSE 'LATER' END AS payment_bucket, today IS NOT NULL AND amount > 0 AS good, today, hi, alert, dod_pct FROM i LEFT JOIN s USING (currency)),
x AS (SELECT *, CASE WHEN good THEN amount * today END AS amount_sgd, CASE WHEN good THEN amount * hi END AS amount_sgd_at_1m_high, CASE WHEN good THEN amount * hi - amount * today END AS fx_risk_sgd, CASE WHEN NOT good THEN 'EXCEPTION' WHEN alert <> '' THEN 'CONVERTED_FX_ALERT' ELSE 'CONVERTED' END AS status,
  CASE WHEN today IS NULL THEN 'No ECB reference rate for ' || currency || ' - check supplier master / convert manually' WHEN NOT good THEN 'Invalid amount' WHEN alert <> '' THEN currency || ' ' || regexp_replace(alert, '\\|', ' + ') || ' ' ELSE '' END AS note FROM e)
"""

ORACLES = {
    "fx_cross_rates": _R + " SELECT strftime(rate_date, '%Y-%m-%d') AS rate_date, currency, round(rate, 6) AS rate FROM c",
    "fx_trailing_stats": _R + """, t AS (SELECT currency, rate_date, rate, avg(rate) OVER l AS a, min(rate) OVER l AS lo, max(rate) OVER l AS hi, count(*) OVER l AS days, lag(rate) OVER (PARTITION BY currency ORDER BY rate_date) AS p FROM c WINDOW l AS (PARTITION BY currency ORDER BY rate_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT currency, strftime(rate_date, '%Y-%m-%d') AS rate_date, round(a, 6) AS avg_n, round(lo, 6) AS lo_n, round(hi, 6) AS hi_n, round(p, 6) AS prev_rate, days, round((rate / p - 1) * 100, 4) AS dod_pct FROM t""",
    "fx_stats": _S + "SELECT currency, round(today, 6) AS today, round(prev, 6) AS prev, round(avg, 6) AS avg, round(lo, 6) AS lo, round(hi, 6) AS hi, strftime(prev_date, '%Y-%m-%d') AS prev_date, days, round(dod_pct, 4) AS dod_pct, round(vs_avg_pct, 4) AS vs_avg_pct, alert FROM s",
    "fx_exposure": _S + "SELECT invoice_id, supplier, currency, days_to_due, payment_bucket, round(CASE WHEN good THEN today END, 6) AS sgd_per_unit, round(amount_sgd, 3) AS amount_sgd, round(amount_sgd_at_1m_high, 3) AS amount_sgd_at_1m_high, round(fx_risk_sgd, 3) AS fx_risk_sgd, status, note FROM x",
    "fx_totals": _S + "SELECT currency, count(*) AS n, round(sum(amount), 2) AS amount, round(sum(amount_sgd), 2) AS sgd, round(sum(fx_risk_sgd), 2) AS risk FROM x WHERE good GROUP BY currency",
    "fx_run_log": _S + "SELECT count(*) AS invoices, count(*) FILTER (NOT good) AS exceptions, count(*) FILTER (payment_bucket = 'OVERDUE') AS overdue, round(sum(amount_sgd), 1) AS exposure_sgd, round(sum(fx_risk_sgd), 1) AS fx_risk_sgd, round(sum(amount_sgd) FILTER (payment_bucket IN ('OVERDUE', 'DUE_THIS_WEEK')), 1) AS due_week_sgd FROM x",
    "fx_alerts": _S + """, a AS (SELECT 'FX_MOVE' AS alert_type, currency, alert AS detail, NULL AS message FROM s WHERE alert <> '' UNION ALL SELECT 'INVOICE_EXCEPTION', currency, invoice_id, note FROM x WHERE NOT good UNION ALL SELECT 'OVERDUE_INVOICE', currency, invoice_id, supplier || ' was due ' || strftime(DATE '2024-01-27' + days_to_due, '%Y-%m-%d') FROM x WHERE payment_bucket = 'OVERDUE')
  SELECT alert_type, currency, count(*) AS n, min(detail) AS first_detail, min(message) AS first_message FROM a GROUP BY ALL""",
    "fx_append_once": _R + " SELECT strftime(rate_date, '%Y-%m-%d') AS rate_date, currency, round(eur_rate, 6) AS eur_rate FROM r WHERE day(rate_date) % 3 <> 0",
    "fx_reconcile": _S + "SELECT CASE WHEN days_to_due = 5 THEN 'ONLY_LEFT' WHEN days_to_due = 7 AND good THEN 'DIFFERENT' ELSE 'OK' END AS state, count(*) AS n FROM x GROUP BY 1",
    "fx_settings": "SELECT max(CASE WHEN n_nationkey = 1 THEN n_nationkey + 0.5 END)::DOUBLE AS dod_alert_pct, 2.0::DOUBLE AS avg_alert_pct, max(CASE WHEN n_nationkey = 10 THEN n_nationkey END)::INTEGER AS history_days FROM nation",
    "fx_formats": "SELECT o_orderkey, format('{:+.2f}%', floor(o_totalprice - 250000) / 100) AS pct, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
}
