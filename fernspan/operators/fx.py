"""Foreign-currency exposure: cross rates, trailing statistics, alerts, conversion of open invoices, append-once history.

Rates come as (rate_date, currency, eur_rate), units of a currency for one euro.  Everything is relational: the cross
rate is a join of a currency's series with the base currency's on the date, trailing statistics are windows over a currency's
fixings, the previous fixing is the latest strictly before the reference date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspan.functions import rules as R

# Settings and their defaults.
DEFAULTS = {"dod_alert_pct": 0.5, "avg_alert_pct": 2.0, "history_days": 22.0}
BASE = "SGD"


def settings(rows: DataFrame) -> DataFrame:
    """Key/value rows (setting, value) over the defaults, as one row; values that are no numbers are ignored."""
    known = rows.groupBy().agg(*(F.max(F.when(F.trim("setting") == k, F.col("value").cast("string").try_cast("double"))).alias(f"__{k}") for k in DEFAULTS))
    return known.select(*(F.coalesce(f"__{k}", F.lit(v)).alias(k) for k, v in DEFAULTS.items())).withColumn("history_days", F.round("history_days").cast("int"))


def cross_rates(rates: DataFrame, base: str = BASE) -> DataFrame:
    """(rate_date, currency, rate): units of the base for one unit; the euro's rate is the base's own series."""
    b = rates.filter(F.col("currency") == base).select("rate_date", F.col("eur_rate").alias("base_rate")).filter("base_rate <> 0")
    other = rates.filter((F.col("currency") != base) & (F.col("currency") != "EUR")).join(b, "rate_date").select("rate_date", "currency", (F.col("base_rate") / F.col("eur_rate")).alias("rate"))
    return other.unionByName(b.select("rate_date", F.lit("EUR").alias("currency"), F.col("base_rate").alias("rate")))


def trailing(cross: DataFrame, n: int = 22) -> DataFrame:
    """Each fixing with average, lowest and highest of its last n, and the change since the one before."""
    w = Window.partitionBy("currency").orderBy("rate_date")
    last = w.rowsBetween(-(n - 1), 0)
    prev = F.lag("rate").over(w)
    return cross.select("currency", "rate_date", "rate", F.avg("rate").over(last).alias("avg_n"), F.min("rate").over(last).alias("lo_n"), F.max("rate").over(last).alias("hi_n"), F.count("*").over(last).alias("days"), prev.alias("prev_rate"), ((F.col("rate") / prev - 1) * 100).alias("dod_pct"))


def stats(rates: DataFrame, today: DataFrame, ref_date: dt.date, history_days: int = 22, dod: float = 0.5, off: float = 2.0, base: str = BASE) -> DataFrame:
    """Per currency at the reference date: today, previous fixing, trailing statistics, percentages and the alert.

    today: (currency, eur_rate) of the reference date. A currency without history has its own rate as statistics and says so.
    """
    ref = F.lit(ref_date)
    hist = cross_rates(rates, base).filter(F.col("rate_date") <= ref)
    w = Window.partitionBy("currency").orderBy(F.desc("rate_date"))
    last = hist.withColumn("n", F.row_number().over(w))
    s = last.groupBy("currency").agg(
        F.sum(F.when(F.col("n") <= history_days, F.col("rate"))).alias("total"), F.count_if(F.col("n") <= history_days).alias("days"), F.min(F.when(F.col("n") <= history_days, F.col("rate"))).alias("lo0"), F.max(F.when(F.col("n") <= history_days, F.col("rate"))).alias("hi0"),
        F.max_by("rate", "rate_date").alias("__any"), F.max(F.when(F.col("rate_date") < ref, F.struct("rate_date", "rate"))).alias("prev"),
    )
    base_row = today.filter(F.col("currency") == base).agg(F.max("eur_rate").alias("base_today"))
    now = today.filter(F.col("currency") != base).select("currency", "eur_rate")
    now = now.join(F.broadcast(base_row)).select("currency", F.when(F.col("currency") == "EUR", F.col("base_today")).otherwise(F.col("base_today") / F.col("eur_rate")).alias("today"))
    d = now.join(s, "currency", "left").withColumn("days", F.coalesce("days", F.lit(0)))
    d = d.withColumn("avg", F.coalesce(F.col("total") / F.nullif("days", F.lit(0)), F.col("today"))).withColumn("lo", F.least("today", "lo0")).withColumn("hi", F.greatest("today", "hi0"))
    d = d.withColumn("prev_date", F.col("prev.rate_date")).withColumn("prev", F.coalesce("prev.rate", "today"))
    d = d.withColumn("dod_pct", (F.col("today") / F.col("prev") - 1) * 100).withColumn("vs_avg_pct", (F.col("today") / F.col("avg") - 1) * 100)
    alert = F.concat_ws("|", F.when(F.abs("dod_pct") >= dod, "DAILY_MOVE"), F.when(F.abs("vs_avg_pct") >= off, "OFF_1M_AVERAGE"), F.when(F.col("days") == 0, "NO_HISTORY"))
    d = d.withColumn("alert", alert).select("currency", "today", "prev_date", "prev", "avg", "lo", "hi", "days", "dod_pct", "vs_avg_pct", "alert")
    own = d.sparkSession.createDataFrame([(base, 1.0, None, 1.0, 1.0, 1.0, 1.0, 0, 0.0, 0.0, "")], "currency string, today double, prev_date date, prev double, avg double, lo double, hi double, days long, dod_pct double, vs_avg_pct double, alert string")
    return d.withColumn("days", F.col("days").cast("long")).unionByName(own)


def exposure(invoices: DataFrame, st: DataFrame, run_date: dt.date, ref_date: dt.date) -> DataFrame:
    """Open invoices (invoice_id, supplier, currency, amount, due_date) converted at today's rate, with bucket, risk and status."""
    inv = invoices.withColumn("currency", F.upper(F.trim("currency")))
    d = inv.join(F.broadcast(st.select("currency", "today", "hi", "dod_pct", "alert")), "currency", "left")
    days = F.datediff("due_date", F.lit(run_date))
    good = F.col("today").isNotNull() & (F.coalesce("amount", F.lit(0.0)) > 0)
    note = F.when(F.col("today").isNull(), F.concat(F.lit("No ECB reference rate for "), "currency", F.lit(" - check supplier master / convert manually"))).when(~good, "Invalid amount").when(F.col("alert") != "", F.concat("currency", F.lit(" "), F.regexp_replace("alert", r"^([^|]*)\|", "$1 + "), F.lit(" ("), F.format_string("%.2f", "dod_pct"), F.lit("% d/d)"))).otherwise("")
    amount = lambda c: F.when(good, F.col("amount") * F.col(c))
    return d.select(
        "invoice_id", "supplier", "currency", "amount", "due_date", days.alias("days_to_due"), R.days_bucket(days).alias("payment_bucket"), F.when(good, F.col("today")).alias("sgd_per_unit"), F.when(good, F.lit(ref_date)).alias("rate_date"),
        amount("today").alias("amount_sgd"), amount("hi").alias("amount_sgd_at_1m_high"), (amount("hi") - amount("today")).alias("fx_risk_sgd"), F.when(~good, "EXCEPTION").when(F.col("alert") != "", "CONVERTED_FX_ALERT").otherwise("CONVERTED").alias("status"), note.alias("note"),
    )


def totals(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") != "EXCEPTION").groupBy("currency").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("amount_sgd").alias("sgd"), F.sum("fx_risk_sgd").alias("risk"))


def run_totals(rows: DataFrame) -> DataFrame:
    soon = F.col("payment_bucket").isin("OVERDUE", "DUE_THIS_WEEK")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.agg(F.count("*").alias("invoices"), F.count_if(F.col("status") == "EXCEPTION").alias("exceptions"), z("amount_sgd").alias("exposure_sgd"), z("fx_risk_sgd").alias("fx_risk_sgd"), z(F.when(soon, F.col("amount_sgd"))).alias("due_week_sgd"), F.count_if(F.col("payment_bucket") == "OVERDUE").alias("overdue"))


def alert_rows(st: DataFrame, rows: DataFrame) -> DataFrame:
    """Rate moves, exceptions and overdue invoices; an invoice may give two rows."""
    moves = st.filter("alert <> ''").select("currency", F.lit("FX_MOVE").alias("alert_type"), F.col("alert").alias("detail"), F.col("today").alias("sgd_per_unit"), F.concat(F.lit("SGD per "), "currency", F.lit(" moved "), F.format_string("%.2f", "dod_pct"), F.lit("%")).alias("message"))
    bad = rows.filter("status = 'EXCEPTION'").select("currency", F.lit("INVOICE_EXCEPTION").alias("alert_type"), F.col("invoice_id").alias("detail"), F.lit(None).cast("double").alias("sgd_per_unit"), F.col("note").alias("message"))
    late = rows.filter("payment_bucket = 'OVERDUE'").select("currency", F.lit("OVERDUE_INVOICE").alias("alert_type"), F.col("invoice_id").alias("detail"), F.lit(None).cast("double").alias("sgd_per_unit"), F.concat("supplier", F.lit(" was due "), F.date_format("due_date", "yyyy-MM-dd")).alias("message"))
    return moves.unionByName(bad).unionByName(late)


def append_once(history: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose (rate_date, currency) the history doesn't have yet."""
    return new.join(history.select("rate_date", "currency").distinct(), ["rate_date", "currency"], "left_anti")


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Two reports side by side: OK within the tolerance, DIFFERENT, or missing on one side; both null is OK."""
    x, y = a.select(key, F.col(value).alias("left_value"), F.lit(True).alias("__l")), b.select(key, F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    both = x.join(y, key, "full_outer")
    l, r = F.col("left_value"), F.col("right_value")
    state = F.when(F.col("__r").isNull(), "ONLY_LEFT").when(F.col("__l").isNull(), "ONLY_RIGHT").when(l.isNull() & r.isNull(), "OK").when(F.coalesce(F.abs(l - r) <= tolerance, F.lit(False)), "OK").otherwise("DIFFERENT")
    return both.select(key, "left_value", "right_value", state.alias("state"))
