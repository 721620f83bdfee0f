"""Invoice control over a batch, an order master and a persistent ledger.

The rules look back at earlier rows of the same batch, but not recursively: whether a row is valid is its own affair, and
whether it repeats a key depends on the order only.  So they are windows over flags of an earlier step and joins with
ledger keys, and nothing is processed row after row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspan.functions import rules as R
from fernspan.operators import windows

# Limits of the control policy and the posted-invoice fixture.
APPROVAL_LIMIT = 10_000
MOST_AMOUNT = 10_000_000
SPLIT_DAYS = 7
#: Head of a case message.
TITLE = "INVOICE CONTROL"
HISTORIC = ("ALPHA|A-776",)
REJECTED = ("HOLD_INVALID_DATA", "HOLD_DUPLICATE")


def latest_orders(po: DataFrame, load_order: str) -> DataFrame:
    """One row for each po_id, the last one loaded; before the join, which would fan out otherwise."""
    p = po.filter(F.coalesce(F.col("po_id").cast("string"), F.lit("")) != "")
    value = F.struct(R.upper_cut(F.col("supplier"), 60).alias("po_supplier"), R.number(F.col("amount_usd")).alias("po_amount"), R.upper_cut(F.when(F.coalesce(F.col("status"), F.lit("")) == "", "OPEN").otherwise(F.col("status")), 20).alias("po_status"))
    return p.groupBy(R.upper_cut(F.col("po_id"), 60).alias("po_id")).agg(F.max_by(value, load_order).alias("v")).select("po_id", "v.*", F.lit(True).alias("po_known"))


def normalised(invoices: DataFrame) -> DataFrame:
    """Trimmed, upper-case keys, a finite amount or null, and the row's own validity."""
    d = invoices.select(
        "seq", F.substring(F.trim(F.coalesce("team_id", F.lit(""))), 1, 20).alias("team_id"), *(R.upper_cut(F.col(c), 60).alias(c) for c in ("invoice_id", "supplier", "invoice_ref", "po_id")),
        R.number(F.col("amount_usd")).alias("amount_usd"), R.yes(F.col("bank_changed")).alias("changed"), F.coalesce("channel", F.lit("form")).alias("channel"),
    )
    amount = F.col("amount_usd")
    fine = (F.col("invoice_id") != "") & (F.col("supplier") != "") & (F.col("invoice_ref") != "") & (amount > 0) & (amount < MOST_AMOUNT)
    d = d.withColumn("valid", F.coalesce(fine, F.lit(False))).withColumn("high", F.coalesce(amount > APPROVAL_LIMIT, F.lit(False)))
    return d.withColumn("key", F.concat_ws("|", "supplier", "invoice_ref"))


def _ledger(ledger: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the batch needs of the ledger: keys seen, orders used, and by supplier the small invoices of the split window."""
    real = ledger.filter(F.coalesce(F.col("invoice_id").cast("string"), F.lit("")) != "")
    keys = real.select(F.concat_ws("|", R.upper_cut(F.col("supplier"), 60), R.upper_cut(F.col("invoice_ref"), 60)).alias("key")).distinct().withColumn("in_ledger", F.lit(True))
    live = real.filter(~F.coalesce(F.col("status").isin(*REJECTED), F.lit(False)))
    used = live.filter(F.coalesce(F.col("po_id").cast("string"), F.lit("")) != "").select(R.upper_cut(F.col("po_id"), 60).alias("po_id")).distinct().withColumn("po_in_ledger", F.lit(True))
    since = F.lit(now - dt.timedelta(days=SPLIT_DAYS))
    amount = R.number(F.col("amount_usd"))
    recent = live.filter((F.col("received_at") >= since) & (amount <= APPROVAL_LIMIT)).groupBy(R.upper_cut(F.col("supplier"), 60).alias("supplier")).agg(F.count("*").alias("old_n"), F.sum(amount).alias("old_sum"))
    return keys, used, recent


def triage(invoices: DataFrame, po: DataFrame, ledger: DataFrame, now: dt.datetime, load_order: str = "load_seq") -> DataFrame:
    """Cases: status, reason, flags, priority and the fixed authority columns of every invoice of the batch."""
    keys, used, recent = _ledger(ledger, now)
    # rows that lack an order or a part of a key get keys of their own, so they don't pile up in one, in joins neither
    alone = F.concat(F.lit("\n"), F.col("seq").cast("string"))
    d = normalised(invoices).withColumn("__po", F.when(F.col("po_id") == "", alone).otherwise(F.col("po_id")))
    of_po = lambda x: x.withColumnRenamed("po_id", "__po")
    d = d.join(keys, "key", "left").join(of_po(used), "__po", "left").join(recent, "supplier", "left").join(of_po(latest_orders(po, load_order)), "__po", "left")
    own_key = F.when((F.col("supplier") == "") | (F.col("invoice_ref") == ""), alone).otherwise(F.col("key"))
    d = windows.with_first(d, own_key, "seq", {"__first": F.lit(True)})
    d = d.withColumn("duplicate", F.coalesce("in_ledger", F.lit(False)) | F.col("key").isin(*HISTORIC) | (F.col("seq") > F.col("__first")))
    d = d.withColumn("counted", (F.col("valid") & ~F.col("duplicate")).cast("int"))
    d = windows.with_first(d, F.col("__po"), "seq",{"__po_first": F.col("counted") == 1})
    d = d.withColumn("po_used", F.coalesce("po_in_ledger", F.lit(False)) | F.coalesce(F.col("seq") > F.col("__po_first"), F.lit(False)))
    small = F.when((F.col("counted") == 1) & (F.col("amount_usd") <= APPROVAL_LIMIT), F.col("amount_usd"))
    d = windows.running(d, F.when(F.col("supplier") == "", alone).otherwise(F.col("supplier")), "seq", {"__n": F.when(small.isNotNull(), 1).otherwise(0), "__sum": F.coalesce(small, F.lit(0.0))})
    d = d.withColumn("siblings", F.coalesce("old_n", F.lit(0)) + F.col("__n")).withColumn("split_total", F.coalesce("old_sum", F.lit(0.0)) + F.col("__sum") + F.coalesce("amount_usd", F.lit(0.0)))
    d = d.withColumn("split", F.col("valid") & ~F.col("high") & (F.col("siblings") > 0) & (F.col("split_total") > APPROVAL_LIMIT))
    money = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c)))
    arms = [
        (~F.col("valid"), "HOLD_INVALID_DATA", "INVALID_DATA", F.lit("Required field missing or invalid amount")),
        (F.col("duplicate"), "HOLD_DUPLICATE", "DUPLICATE", F.when(F.col("key").isin(*HISTORIC), "Supplier and reference already in the historic posted-invoice fixture").otherwise("Supplier and reference already submitted (found in AP ledger table or earlier in this batch)")),
        (F.col("changed"), "HOLD_BANK_CHANGE", "BANK_CHANGE", F.lit("Bank details changed; call the supplier on a known number before paying")),
        (F.col("po_id") == "", "REVIEW_MISSING_PO", "MISSING_PO", F.lit("Purchase order missing")),
        (F.col("po_known").isNull(), "REVIEW_UNKNOWN_PO", "UNKNOWN_PO", F.concat("po_id", F.lit(" is not in the PO master table"))),
        (F.col("po_status") != "OPEN", "REVIEW_PO_CLOSED", "PO_CLOSED", F.concat("po_id", F.lit(" is "), "po_status", F.lit(", not OPEN"))),
        (F.col("po_supplier") != F.col("supplier"), "REVIEW_PO_SUPPLIER", "PO_SUPPLIER_MISMATCH", F.concat("po_id", F.lit(" belongs to "), "po_supplier", F.lit(", not "), "supplier")),
        (F.col("po_used"), "REVIEW_PO_ALREADY_INVOICED", "PO_ALREADY_INVOICED", F.concat("po_id", F.lit(" has already been invoiced under another reference (possible re-billing)"))),
        (F.abs(F.col("po_amount") - F.col("amount_usd")) > 0.01, "REVIEW_AMOUNT_MISMATCH", "AMOUNT_MISMATCH", F.concat(F.lit("PO amount is $"), money("po_amount"), F.lit(", invoice says $"), money("amount_usd"))),
        (F.col("split"), "REVIEW_SPLIT_SUSPECTED", "SPLIT_SUSPECTED", F.concat((F.col("siblings") + 1).cast("string"), F.lit(" invoices from "), "supplier", F.lit(f" in {SPLIT_DAYS} days, each <= $10,000 but $"), money("split_total"), F.lit(" together (approval-limit splitting?)"))),
        (F.col("high"), "REVIEW_MANAGER", "HIGH_VALUE", F.lit("Finance-manager approval required (amount > $10,000)")),
    ]

    def first(pick: int, other: str):
        e = None
        for arm in arms:
            value = F.lit(arm[pick]) if isinstance(arm[pick], str) else arm[pick]
            e = F.when(arm[0], value) if e is None else e.when(arm[0], value)
        return e.otherwise(other)

    d = d.withColumn("status", first(1, "READY_FOR_HUMAN_CHECK")).withColumn("reason0", first(3, "All V4 controls passed; human confirmation still required"))
    flags = F.array_distinct(F.array_compact(F.array(F.nullif(first(2, ""), F.lit("")), F.when(F.col("high"), "HIGH_VALUE"), F.when(F.col("split"), "SPLIT_SUSPECTED"))))
    manager = F.col("high") | F.col("split")
    extra = manager & ~F.col("status").isin("REVIEW_MANAGER", "REVIEW_SPLIT_SUSPECTED")
    day, ms = now.strftime("%Y%m%d"), int(now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    d = d.withColumn("control_flags", F.coalesce(F.nullif(F.concat_ws("|", flags), F.lit("")), F.lit("NONE"))).withColumn("manager_approval_required", manager)
    d = d.withColumn("reason", F.concat("reason0", F.when(extra, "; finance-manager approval also required").otherwise(""))).withColumn("priority", R.priority(F.col("status")))
    d = d.withColumn("case_id", R.case_id(ms, day, F.col("invoice_id"), F.col("seq")))
    icon = F.when(F.col("priority") == "P1", "\U0001f534 HOLD").when(F.col("priority") == "P2", "\U0001f7e0 REVIEW").otherwise("\U0001f7e2 READY")
    text = F.concat(
        F.lit(f"{TITLE} | "), icon, F.lit("\nCase: "), "case_id", F.lit("\nInvoice: "), "invoice_id", F.lit(" ("), "channel", F.lit(")\nSupplier: "), "supplier", F.lit("  Ref: "), "invoice_ref",
        F.lit("\nAmount: $"), F.coalesce(money("amount_usd"), F.lit("INVALID")), F.lit("  PO: "), F.when(F.col("po_id") == "", "-").otherwise(F.col("po_id")), F.lit("\nStatus: "), "status", F.lit("\nFlags: "), "control_flags", F.lit("\nReason: "), "reason",
        F.lit("\nHUMAN REVIEW REQUIRED. NO PAYMENT MADE."),
    )
    return d.select(
        "seq", "case_id", "channel", "priority", "team_id", "invoice_id", "supplier", "invoice_ref", "amount_usd", "po_id", F.when(F.col("changed"), "YES").otherwise("NO").alias("bank_changed"), "status", "reason", "control_flags",
        F.lit(now).alias("received_at"), "manager_approval_required", F.lit(True).alias("human_approval_required"), F.lit(False).alias("payment_authorized"), F.lit(False).alias("ai_can_override_status"), F.lit("").alias("ai_commentary"),
        F.when(F.col("priority") == "P2", "PENDING").otherwise("NOT_REQUIRED").alias("ai_guardrail"), text.alias("telegram_text"),
    )


def triage_fixed(invoices: DataFrame, po: DataFrame, posted: tuple[str, ...] = HISTORIC) -> DataFrame:
    """The earlier rule set: a fixed order list and posted keys, no ledger, no memory within the batch; nine statuses."""
    orders = latest_orders(po, "load_seq")
    d = normalised(invoices).join(orders, "po_id", "left")
    first = (
        F.when(~F.col("valid"), "HOLD_INVALID_DATA")
        .when(F.col("key").isin(*posted), "HOLD_DUPLICATE")
        .when(F.col("changed"), "HOLD_BANK_CHANGE")
        .when(F.col("po_id") == "", "REVIEW_MISSING_PO")
        .when(F.col("po_known").isNull(), "REVIEW_UNKNOWN_PO")
        .when(F.col("po_supplier") != F.col("supplier"), "REVIEW_PO_SUPPLIER")
        .when(F.abs(F.col("po_amount") - F.col("amount_usd")) > 0.01, "REVIEW_AMOUNT_MISMATCH")
        .when(F.col("high"), "REVIEW_MANAGER")
        .otherwise("READY_FOR_HUMAN_CHECK")
    )
    flag = F.create_map(*(F.lit(x) for kv in {"HOLD_INVALID_DATA": "INVALID_DATA", "HOLD_DUPLICATE": "HISTORIC_DUPLICATE", "HOLD_BANK_CHANGE": "BANK_CHANGE", "REVIEW_MISSING_PO": "MISSING_PO", "REVIEW_UNKNOWN_PO": "UNKNOWN_PO", "REVIEW_PO_SUPPLIER": "PO_SUPPLIER_MISMATCH", "REVIEW_AMOUNT_MISMATCH": "AMOUNT_MISMATCH", "REVIEW_MANAGER": "HIGH_VALUE"}.items() for x in kv))
    flags = F.array_distinct(F.array_compact(F.array(F.try_element_at(flag, F.col("status")), F.when(F.col("high"), "HIGH_VALUE"))))
    return d.withColumn("status", first).select("seq", "invoice_id", "supplier", "amount_usd", "po_id", "status", F.coalesce(F.nullif(F.concat_ws("|", flags), F.lit("")), F.lit("NONE")).alias("control_flags"), F.col("high").alias("manager_approval_required"))


def batch_rows(requests: DataFrame) -> DataFrame:
    """Invoices of JSON requests {team_id, invoices: [...]} or single invoices; 1 to 200 a request, else an error."""
    inv = "struct<team_id:string,invoice_id:string,supplier:string,invoice_ref:string,amount_usd:string,po_id:string,bank_changed:string>"
    body = F.from_json("body", f"struct<team_id:string,invoices:array<{inv}>>")
    single = F.array(F.from_json("body", inv))
    d = requests.withColumn("__b", body).withColumn("__l", F.coalesce(F.col("__b.invoices"), single))
    d = d.withColumn("__l", F.when(F.size("__l").between(1, 200), F.col("__l")).otherwise(F.raise_error(F.lit("Send 1-200 invoices per batch"))))
    e = d.select("request_id", F.col("__b.team_id").alias("__team"), F.posexplode("__l").alias("seq", "v"))
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return e.select("request_id", F.col("seq").cast("long").alias("seq"), F.coalesce(blank(F.col("v.team_id")), blank(F.col("__team")), F.lit("API")).alias("team_id"), *(F.col(f"v.{c}").alias(c) for c in ("invoice_id", "supplier", "invoice_ref", "amount_usd", "po_id", "bank_changed")), F.lit("api").alias("channel"))


def batch_response(cases: DataFrame) -> DataFrame:
    """One row: cases received, counts by priority and by status as maps, and the cases."""
    counts = lambda k: cases.groupBy(k).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, "n")))).alias(f"by_{k}"))
    total = cases.agg(F.count("*").alias("received"))
    return total.join(F.broadcast(counts("priority"))).join(F.broadcast(counts("status"))).withColumn("payment_authorized", F.lit(False))


def _recent(cases: DataFrame, now: dt.datetime) -> DataFrame:
    return cases.filter(F.col("case_id").isNotNull() & (F.col("received_at") >= F.lit(now - dt.timedelta(hours=24))))


def digest(cases: DataFrame, now: dt.datetime) -> DataFrame:
    """The last 24 hours in one row: counts by priority and status, sums, and the head of the message. The held cases are held()."""
    rows = _recent(cases, now)
    amount = F.coalesce("amount_usd", F.lit(0.0))
    p = lambda x: F.count_if(F.col("priority") == x)
    total = rows.agg(
        F.count("*").alias("cases"), p("P1").alias("p1"), p("P2").alias("p2"), p("P3").alias("p3"), F.round(F.coalesce(F.sum(F.when(F.col("priority") == "P1", amount)), F.lit(0.0)), 2).alias("on_hold_usd"),
        F.round(F.coalesce(F.sum(F.when(F.col("manager_approval_required"), amount)), F.lit(0.0)), 2).alias("needs_manager_usd"), F.count_if(F.col("ai_guardrail") == "BLOCKED").alias("ai_notes_blocked"),
    )
    status = rows.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    out = total.join(F.broadcast(status))  # one row each
    named = F.array_join(F.transform(F.map_entries("by_status"), lambda x: F.concat(x["key"], F.lit(" "), x["value"].cast("string"))), ", ")
    money = lambda c: F.format_string("%.2f", F.col(c))
    head = F.concat(
        F.lit(f"{TITLE} | DAILY DIGEST\nCases: "), F.col("cases").cast("string"), F.lit(" | P1 "), F.col("p1").cast("string"), F.lit(" / P2 "), F.col("p2").cast("string"), F.lit(" / P3 "), F.col("p3").cast("string"),
        F.lit("\nOn hold: $"), money("on_hold_usd"), F.lit(" | Needs manager: $"), money("needs_manager_usd"), F.lit("\nBy status: "), F.when(F.size("by_status") > 0, named).otherwise("none"),
    )
    return out.withColumn("header", head)


def held(cases: DataFrame, now: dt.datetime) -> DataFrame:
    """The cases on hold of the last 24 hours, a line each: invoice, supplier, amount and status."""
    amount = F.coalesce(F.regexp_replace(F.format_string("%.2f", F.col("amount_usd")), r"\.?0+$", ""), F.lit("null"))
    line = F.concat("invoice_id", F.lit(" "), "supplier", F.lit(" $"), F.when(F.col("amount_usd").isNull(), "null").otherwise(amount), F.lit(" "), "status")
    return _recent(cases, now).filter("priority = 'P1'").select("seq", line.alias("line"))


def guarded_notes(cases: DataFrame) -> DataFrame:
    """Review notes (column note): kept where nothing is wrong with them, else withheld in favour of the rule's reason."""
    problems = R.note_problems(F.col("note"), F.col("status"))
    d = cases.withColumn("__p", problems)
    ok = F.size("__p") == 0
    text = F.when(ok, F.substring(F.trim("note"), 1, 900)).otherwise(F.concat(F.lit("[withheld by guardrail: "), F.concat_ws("; ", "__p"), F.lit("] Rule reason: "), "reason"))
    return d.withColumn("ai_commentary", text).withColumn("ai_guardrail", F.when(ok, "PASSED").otherwise("BLOCKED")).drop("__p")


def guarded_briefing(df: DataFrame) -> DataFrame:
    """Briefings (raw, facts_text): every number must come from the facts, and no payment may be claimed."""
    raw = F.trim(F.coalesce("raw", F.lit("")))
    bad = R.invented_numbers(raw, F.col("facts_text"))
    unsafe = raw.rlike(R.FORBIDDEN_BRIEF)
    ok = (raw != "") & (F.size(bad) == 0) & ~unsafe
    why = F.when(raw == "", "empty").when(unsafe, "payment claim").otherwise(F.concat(F.lit("numbers not in the data: "), F.concat_ws(", ", bad)))
    return df.withColumn("ai_briefing", F.when(ok, raw).otherwise(F.concat(F.lit("[AI briefing withheld: "), why, F.lit("]")))).withColumn("ai_guardrail", F.when(ok, "PASSED").otherwise("BLOCKED"))


def intake(df: DataFrame, now: dt.datetime) -> DataFrame:
    """Trimmed and cut request fields, a stamp and a message."""
    cut = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n).alias(c)
    d = df.select(cut("team_id", 20), cut("student_alias", 60), cut("request_type", 60), cut("request_text", 900))
    return d.withColumn("received_at", F.lit(now)).withColumn("notification_text", F.concat_ws(" | ", "team_id", "student_alias", "request_type", "request_text"))
