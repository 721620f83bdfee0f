"""Queries: invoice control. Orders play the invoices, customers the order master, events the ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fernspan.functions import rules as R
from fernspan.operators import ap, windows
from fernspan.session import table

NOW = dt.datetime(2024, 1, 31)


def invoices(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("seq"), F.lit(" T1 ").alias("team_id"), F.when(k % 101 == 0, "").otherwise(F.concat(F.lit("inv-"), k.cast("string"))).alias("invoice_id"), F.concat(F.lit(" sup"), (c % 97).cast("string")).alias("supplier"),
        F.concat(F.lit("r"), (k % 4999).cast("string")).alias("invoice_ref"), F.when(k % 89 == 0, "abc").when(k % 83 == 0, "-5").otherwise((F.floor(F.col("o_totalprice") * 100 / 30) / 100).cast("string")).alias("amount_usd"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("po"), (k % 20011).cast("string"))).alias("po_id"), F.when(k % 13 == 0, "yes").alias("bank_changed"), F.lit("api").alias("channel"),
    )


def po_master(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.filter(k % 7 != 0).select(
        k.alias("load_seq"), F.concat(F.lit("PO"), (k % 20011).cast("string")).alias("po_id"), F.concat(F.lit("Sup"), F.when(k % 17 == 0, F.lit(1)).otherwise(F.col("o_custkey") % 97).cast("string")).alias("supplier"),
        (F.floor(F.col("o_totalprice") * 100 / 30) / 100 + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("amount_usd"), F.when(k % 19 == 0, "closed").otherwise("open").alias("status"),
    )


def ledger(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        F.when(k % 53 == 0, None).otherwise(F.concat(F.lit("L"), k.cast("string"))).alias("invoice_id"), F.concat(F.lit("SUP"), (F.col("user_id") % 97 + F.when(F.col("user_id") % 2 == 0, 1000).otherwise(0)).cast("string")).alias("supplier"), F.concat(F.lit("R"), (k % 30011).cast("string")).alias("invoice_ref"),
        (F.col("value") * 1).alias("amount_usd"), F.concat(F.lit("PO"), (k % 40009 + 3000).cast("string")).alias("po_id"), F.when(k % 10 == 0, "HOLD_DUPLICATE").otherwise("READY_FOR_HUMAN_CHECK").alias("status"), F.col("ts").alias("received_at"),
    )


def cases(spark, sf):
    return ap.triage(invoices(spark, sf), po_master(spark, sf), ledger(spark, sf), NOW)


def ap_triage(spark, sf):
    return cases(spark, sf).select("seq", "case_id", "priority", "team_id", "invoice_id", "supplier", "invoice_ref", "amount_usd", "po_id", "bank_changed", "status", "reason", "control_flags", "manager_approval_required", "ai_guardrail", F.md5("telegram_text").alias("telegram_md5"))


def ap_status_counts(spark, sf):
    return cases(spark, sf).groupBy("priority", "status", "control_flags").agg(F.count("*").alias("n"), F.round(F.sum("amount_usd"), 2).alias("amount"))


def ap_triage_fixed(spark, sf):
    return ap.triage_fixed(invoices(spark, sf), po_master(spark, sf)).groupBy("status", "control_flags", "manager_approval_required").agg(F.count("*").alias("n"))


def ap_split_window(spark, sf):
    """Ledger rows with the number and sum of the same supplier's small rows of the seven days before (inclusive)."""
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    small = F.when(F.col("amount_usd") <= 100, F.col("amount_usd"))
    d = windows.trailing(ledger(spark, sf).select("supplier", at.alias("at"), small.alias("small")), "supplier", "at", 7 * 86_400_000_000, "small")
    return d.groupBy("supplier").agg(F.sum("rows").alias("n_rows"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("rows")).alias("n_sum"), F.round(F.max(F.round("total", 4)), 3).alias("largest"))


def ap_digest(spark, sf):
    d = ap.digest(cases(spark, sf), NOW + dt.timedelta(hours=3))
    return d.withColumn("by_status", F.concat_ws(",", F.transform(F.map_entries("by_status"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))))


def ap_held(spark, sf):
    return ap.held(cases(spark, sf), NOW + dt.timedelta(hours=3))


def ap_batch_response(spark, sf):
    r = ap.batch_response(cases(spark, sf))
    text = lambda c: F.concat_ws(",", F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))))
    return r.select("received", text("by_priority").alias("by_priority"), text("by_status").alias("by_status"), "payment_authorized")


def ap_guardrail_notes(spark, sf):
    """Every conversation turn as a review note, some with a forbidden claim or a status in them."""
    d = table(spark, sf, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn")
    note = F.when(k % 11 == 0, F.lit("  ")).when(k % 5 == 0, F.concat("text", F.lit(" This invoice has been Approved."))).when(k % 7 == 0, F.concat(F.lit("REVIEW_MANAGER "), "text")).otherwise(F.col("text"))
    status = F.when(k % 2 == 0, "REVIEW_MANAGER").otherwise("HOLD_DUPLICATE")
    g = ap.guarded_notes(d.select("conv_id", "turn", note.alias("note"), status.alias("status"), F.lit("rule").alias("reason")))
    return g.select("conv_id", "turn", "ai_guardrail", F.when(F.col("ai_guardrail") == "BLOCKED", F.col("ai_commentary")).alias("withheld"))


def ap_guardrail_numbers(spark, sf):
    """Briefings that quote an event's amount, some with another number or a payment claim."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    facts = F.concat(F.lit('{"cases":'), k.cast("string"), F.lit(',"hold":'), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("}"))
    raw = F.concat(F.lit("In 24 hours, 3 holds of "), F.col("value").cast("decimal(12,2)").cast("string"), F.when(k % 5 == 0, " and 987,654 more").otherwise(""), F.when(k % 7 == 0, " payments released").otherwise(""))
    g = ap.guarded_briefing(e.select("event_id", raw.alias("raw"), facts.alias("facts_text")))
    return g.select("event_id", "ai_guardrail", F.when(F.col("ai_guardrail") == "BLOCKED", F.col("ai_briefing")).alias("withheld"))


def ap_batch_rows(spark, sf):
    """One JSON request for each customer, split back into invoice rows."""
    o = table(spark, sf, "orders")
    inv = F.struct(F.concat(F.lit("I"), F.col("o_orderkey").cast("string")).alias("invoice_id"), F.round("o_totalprice", 2).cast("string").alias("amount_usd"))
    req = o.groupBy(F.col("o_custkey").alias("request_id")).agg(F.to_json(F.struct(F.concat(F.lit("T"), F.first("o_custkey").cast("string")).alias("team_id"), F.sort_array(F.collect_list(inv)).alias("invoices"))).alias("body"))
    return ap.batch_rows(req).groupBy("request_id").agg(F.count("*").alias("n"), F.min("team_id").alias("team_id"), F.max("seq").alias("last_seq"), F.min("invoice_id").alias("first_invoice"), F.round(F.sum(F.col("amount_usd").try_cast("double")), 2).alias("total"))


def ap_route(spark, sf):
    """Three-way route by priority, as one frame with its branch."""
    c = cases(spark, sf)
    out = None
    for p, branch in (("P1", "hold"), ("P2", "review"), ("P3", "ready")):
        part = c.filter(F.col("priority") == p).select(F.lit(branch).alias("branch"), "invoice_id", "status")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("branch").agg(F.count("*").alias("n"), F.count_distinct("status").alias("n_status"))


def ap_numbers(spark, sf):
    """Number reading: blanks, exponents, separators and infinities of a spread of spellings."""
    e = table(spark, sf, "events")
    k = F.col("event_id") % 8
    raw = F.when(k == 0, " ").when(k == 1, "1e3").when(k == 2, "abc").when(k == 3, "Infinity").when(k == 4, "NaN").when(k == 5, "1,250").when(k == 6, " 12.5 ").otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    return e.select("event_id", R.number(raw).alias("x"), R.yes(F.when(k == 0, "true").when(k == 1, " Yes ").when(k == 2, "1")).alias("flag"))


QUERIES = {f.__name__: f for f in (ap_triage, ap_status_counts, ap_triage_fixed, ap_split_window, ap_digest, ap_held, ap_batch_response, ap_guardrail_notes, ap_guardrail_numbers, ap_batch_rows, ap_route, ap_numbers)}

_INV = """
inv AS (SELECT o_orderkey AS seq, 'T1' AS team_id, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE 'INV-' || o_orderkey END AS invoice_id, 'SUP' || (o_custkey % 97) AS supplier, 'R' || (o_orderkey % 4999) AS invoice_ref,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN -5 ELSE floor(o_totalprice * 100 / 30) / 100 END AS amount_usd,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'PO' || (o_orderkey % 20011) END AS po_id, o_orderkey % 13 = 0 AS changed FROM orders),
po0 AS (SELECT o_orderkey AS load_seq, 'PO' || (o_orderkey % 20011) AS po_id, 'SUP' || CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE o_custkey % 97 END AS po_supplier,
  floor(o_totalprice * 100 / 30) / 100 + CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS po_amount, CASE WHEN o_orderkey % 19 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS po_status FROM orders WHERE o_orderkey % 7 <> 0),
po AS (SELECT po_id, arg_max(po_supplier, load_seq) AS po_supplier, arg_max(po_amount, load_seq) AS po_amount, arg_max(po_status, load_seq) AS po_status FROM po0 GROUP BY po_id),
led AS (SELECT 'L' || event_id AS invoice_id, 'SUP' || (user_id % 97 + CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 0 END) AS supplier, 'R' || (event_id % 30011) AS invoice_ref, value AS amount_usd, 'PO' || (event_id % 40009 + 3000) AS po_id, event_id % 10 = 0 AS rejected, ts AS received_at, event_id FROM events),
v AS (SELECT *, coalesce(invoice_id <> '' AND supplier <> '' AND invoice_ref <> '' AND amount_usd > 0 AND amount_usd < 10000000, false) AS valid, coalesce(amount_usd > 10000, false) AS high FROM inv),
u AS (SELECT v.*, EXISTS (SELECT 1 FROM led l WHERE l.event_id % 53 <> 0 AND l.supplier = v.supplier AND l.invoice_ref = v.invoice_ref) OR (supplier || '|' || invoice_ref) = 'ALPHA|A-776' OR row_number() OVER (PARTITION BY supplier, invoice_ref ORDER BY seq) > 1 AS dup FROM v),
w AS (SELECT *, (valid AND NOT dup)::INT AS counted, CASE WHEN valid AND NOT dup AND amount_usd <= 10000 THEN amount_usd END AS small FROM u),
rec AS (SELECT supplier, count(*) AS old_n, sum(amount_usd) AS old_sum FROM led WHERE event_id % 53 <> 0 AND NOT rejected AND received_at >= TIMESTAMP '2024-01-24' AND amount_usd <= 10000 GROUP BY supplier),
usedpo AS (SELECT DISTINCT po_id FROM led WHERE event_id % 53 <> 0 AND NOT rejected),
x AS (SELECT w.*, po.po_supplier, po.po_amount, po.po_status, (usedpo.po_id IS NOT NULL) OR coalesce(sum(counted) OVER (PARTITION BY CASE WHEN w.po_id = '' THEN '#' || seq ELSE w.po_id END ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS po_used,
  coalesce(old_n, 0) + count(small) OVER p AS siblings, coalesce(old_sum, 0) + coalesce(sum(small) OVER p, 0) + coalesce(amount_usd, 0) AS split_total
  FROM w LEFT JOIN po ON w.po_id = po.po_id LEFT JOIN usedpo ON w.po_id = usedpo.po_id LEFT JOIN rec ON w.supplier = rec.supplier WINDOW p AS (PARTITION BY w.supplier ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, valid AND NOT high AND siblings > 0 AND split_total > 10000 AS split FROM x),
z AS (SELECT *, CASE WHEN NOT valid THEN 1 WHEN dup THEN 2 WHEN changed THEN 3 WHEN po_id = '' THEN 4 WHEN po_status IS NULL THEN 5 WHEN po_status <> 'OPEN' THEN 6 WHEN po_supplier <> supplier THEN 7 WHEN po_used THEN 8 WHEN abs(po_amount - amount_usd) > 0.01::DOUBLE THEN 9 WHEN split THEN 10 WHEN high THEN 11 ELSE 12 END AS arm FROM y),
s AS (SELECT *, ['HOLD_INVALID_DATA','HOLD_DUPLICATE','HOLD_BANK_CHANGE','REVIEW_MISSING_PO','REVIEW_UNKNOWN_PO','REVIEW_PO_CLOSED','REVIEW_PO_SUPPLIER','REVIEW_PO_ALREADY_INVOICED','REVIEW_AMOUNT_MISMATCH','REVIEW_SPLIT_SUSPECTED','REVIEW_MANAGER','READY_FOR_HUMAN_CHECK'][arm] AS status,
  ['INVALID_DATA','DUPLICATE','BANK_CHANGE','MISSING_PO','UNKNOWN_PO','PO_CLOSED','PO_SUPPLIER_MISMATCH','PO_ALREADY_INVOICED','AMOUNT_MISMATCH','SPLIT_SUSPECTED','HIGH_VALUE',''][arm] AS f0 FROM z),
c AS (SELECT *, CASE WHEN arm <= 3 THEN 'P1' WHEN arm <= 11 THEN 'P2' ELSE 'P3' END AS priority, high OR split AS manager,
  coalesce(nullif(concat_ws('|', nullif(f0, ''), CASE WHEN high AND f0 <> 'HIGH_VALUE' THEN 'HIGH_VALUE' END, CASE WHEN split AND f0 <> 'SPLIT_SUSPECTED' THEN 'SPLIT_SUSPECTED' END), ''), 'NONE') AS control_flags,
  CASE arm WHEN 1 THEN 'Required field missing or invalid amount' WHEN 2 THEN 'Supplier and reference already submitted (found in AP ledger table or earlier in this batch)' WHEN 3 THEN 'Bank details changed; call the supplier on a known number before paying' WHEN 4 THEN 'Purchase order missing'
   WHEN 5 THEN po_id || ' is not in the PO master table' WHEN 6 THEN po_id || ' is ' || po_status || ', not OPEN' WHEN 7 THEN po_id || ' belongs to ' || po_supplier || ', not ' || supplier WHEN 8 THEN po_id || ' has already been invoiced under another reference (possible re-billing)'
   WHEN 9 THEN 'PO amount is $' || format('{:.2f}', po_amount) || ', invoice says $' || format('{:.2f}', amount_usd) WHEN 10 THEN (siblings + 1) || ' invoices from ' || supplier || ' in 7 days, each <= $10,000 but $' || format('{:.2f}', split_total) || ' together (approval-limit splitting?)'
   WHEN 11 THEN 'Finance-manager approval required (amount > $10,000)' ELSE 'All V4 controls passed; human confirmation still required' END || CASE WHEN (high OR split) AND arm NOT IN (10, 11) THEN '; finance-manager approval also required' ELSE '' END AS reason,
  'AP-20240131-' || regexp_replace(CASE WHEN invoice_id = '' THEN 'NOID' ELSE invoice_id END, '[^A-Z0-9]', '', 'g') || '-' || right(cast(1706659200000 + seq AS VARCHAR), 5) AS case_id FROM s)
"""
_NOTE = """WITH k AS (SELECT conv_id, turn, text, conv_id * 7 + turn AS k FROM conversations), n AS (SELECT conv_id, turn, trim(CASE WHEN k % 11 = 0 THEN '  ' WHEN k % 5 = 0 THEN text || ' This invoice has been Approved.' WHEN k % 7 = 0 THEN 'REVIEW_MANAGER ' || text ELSE text END) AS raw, CASE WHEN k % 2 = 0 THEN 'REVIEW_MANAGER' ELSE 'HOLD_DUPLICATE' END AS status FROM k),
o AS (SELECT *, list_filter([{st}], lambda s : s <> status AND contains(raw, s))[1] AS other FROM n),
p AS (SELECT *, concat_ws('; ', CASE WHEN raw = '' THEN 'empty answer' END, CASE WHEN regexp_matches(raw, '{pat}', 'i') THEN 'claims approval/payment or asks for bank details' END, 'mentions a different status ' || other) AS problems FROM o)
SELECT conv_id, turn, CASE WHEN problems = '' THEN 'PASSED' ELSE 'BLOCKED' END AS ai_guardrail, CASE WHEN problems <> '' THEN '[withheld by guardrail: ' || problems || '] Rule reason: rule' END AS withheld FROM p"""
_WITH = "WITH " + _INV.strip() + "\n"

ORACLES = {
    "ap_triage": _WITH
    + """SELECT seq, case_id, priority, team_id, invoice_id, supplier, invoice_ref, amount_usd, po_id, CASE WHEN changed THEN 'YES' ELSE 'NO' END AS bank_changed, status, reason, control_flags, manager AS manager_approval_required,
  CASE WHEN priority = 'P2' THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS ai_guardrail,
  md5('INVOICE CONTROL | ' || CASE priority WHEN 'P1' THEN '🔴 HOLD' WHEN 'P2' THEN '🟠 REVIEW' ELSE '🟢 READY' END || chr(10) || 'Case: ' || case_id || chr(10) || 'Invoice: ' || invoice_id || ' (api)' || chr(10) || 'Supplier: ' || supplier || '  Ref: ' || invoice_ref || chr(10) || 'Amount: $' || coalesce(format('{:.2f}', amount_usd), 'INVALID') || '  PO: ' || CASE WHEN po_id = '' THEN '-' ELSE po_id END || chr(10) || 'Status: ' || status || chr(10) || 'Flags: ' || control_flags || chr(10) || 'Reason: ' || reason || chr(10) || 'HUMAN REVIEW REQUIRED. NO PAYMENT MADE.') AS telegram_md5
FROM c""",
    "ap_status_counts": _WITH + "SELECT priority, status, control_flags, count(*) AS n, round(sum(amount_usd), 2) AS amount FROM c GROUP BY ALL",
    "ap_triage_fixed": _WITH
    + """, f AS (SELECT *, CASE WHEN NOT valid THEN 1 WHEN changed THEN 3 WHEN po_id = '' THEN 4 WHEN po_status IS NULL THEN 5 WHEN po_supplier <> supplier THEN 7 WHEN abs(po_amount - amount_usd) > 0.01::DOUBLE THEN 9 WHEN high THEN 11 ELSE 12 END AS a FROM y),
  g AS (SELECT ['HOLD_INVALID_DATA','','HOLD_BANK_CHANGE','REVIEW_MISSING_PO','REVIEW_UNKNOWN_PO','','REVIEW_PO_SUPPLIER','','REVIEW_AMOUNT_MISMATCH','','REVIEW_MANAGER','READY_FOR_HUMAN_CHECK'][a] AS status, ['INVALID_DATA','','BANK_CHANGE','MISSING_PO','UNKNOWN_PO','','PO_SUPPLIER_MISMATCH','','AMOUNT_MISMATCH','','HIGH_VALUE',''][a] AS f0, high FROM f)
  SELECT status, coalesce(nullif(concat_ws('|', nullif(f0, ''), CASE WHEN high AND f0 <> 'HIGH_VALUE' THEN 'HIGH_VALUE' END), ''), 'NONE') AS control_flags, high AS manager_approval_required, count(*) AS n FROM g GROUP BY ALL""",
    "ap_split_window": """WITH e AS (SELECT 'SUP' || (user_id % 97 + CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 0 END) AS supplier, ts, CASE WHEN value <= 100 THEN value END AS small FROM events),
  w AS (SELECT supplier, count(small) OVER p AS n, sum(small) OVER p AS total FROM e WINDOW p AS (PARTITION BY supplier ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW))
  SELECT supplier, count(*) AS n_rows, max(n) AS most, cast(sum(n) AS BIGINT) AS n_sum, round(max(round(total, 4)), 3) AS largest FROM w GROUP BY supplier""",
    "ap_digest": _WITH
    + "SELECT *, 'INVOICE CONTROL | DAILY DIGEST' || chr(10) || 'Cases: ' || cases || ' | P1 ' || p1 || ' / P2 ' || p2 || ' / P3 ' || p3 || chr(10) || 'On hold: $' || format('{:.2f}', on_hold_usd) || ' | Needs manager: $' || format('{:.2f}', needs_manager_usd) || chr(10) || 'By status: ' || (SELECT string_agg(k || ' ' || n, ', ' ORDER BY k) FROM (SELECT status AS k, count(*) AS n FROM c GROUP BY 1)) AS header,"
    " (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT status AS k, count(*) AS n FROM c GROUP BY 1)) AS by_status FROM (SELECT count(*) AS cases, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3, round(coalesce(sum(amount_usd) FILTER (priority = 'P1'), 0), 2) AS on_hold_usd, round(coalesce(sum(amount_usd) FILTER (manager), 0), 2) AS needs_manager_usd, 0::BIGINT AS ai_notes_blocked FROM c)",
    "ap_held": _WITH + "SELECT seq, invoice_id || ' ' || supplier || ' $' || coalesce(regexp_replace(format('{:.2f}', amount_usd::DOUBLE), '\\.?0+$', ''), 'null') || ' ' || status AS line FROM c WHERE priority = 'P1'",
    "ap_batch_response": _WITH + "SELECT count(*) AS received, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT priority AS k, count(*) AS n FROM c GROUP BY 1)) AS by_priority, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT status AS k, count(*) AS n FROM c GROUP BY 1)) AS by_status, false AS payment_authorized FROM c",
    "ap_guardrail_notes": _NOTE.replace("{st}", ", ".join(f"'{s}'" for s in R.STATUSES)).replace("{pat}", R.FORBIDDEN_NOTE.replace("(?i)", "")),
    "ap_guardrail_numbers": """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'BLOCKED' ELSE 'PASSED' END AS ai_guardrail,
  CASE WHEN event_id % 7 = 0 THEN '[AI briefing withheld: payment claim]' WHEN event_id % 5 = 0 THEN '[AI briefing withheld: numbers not in the data: 987654]' END AS withheld FROM events""",
    "ap_batch_rows": "SELECT o_custkey AS request_id, count(*) AS n, 'T' || o_custkey AS team_id, count(*) - 1 AS last_seq, min('I' || o_orderkey) AS first_invoice, round(sum(round(o_totalprice, 2)), 2) AS total FROM orders GROUP BY o_custkey",
    "ap_route": _WITH + "SELECT CASE priority WHEN 'P1' THEN 'hold' WHEN 'P2' THEN 'review' ELSE 'ready' END AS branch, count(*) AS n, count(DISTINCT status) AS n_status FROM c GROUP BY priority",
    "ap_numbers": """SELECT event_id, CASE event_id % 8 WHEN 1 THEN 1000.0 WHEN 6 THEN 12.5 WHEN 7 THEN cast(cast(value AS DECIMAL(12,2)) AS DOUBLE) END::DOUBLE AS x, coalesce(event_id % 8 IN (0, 1, 2), false) AS flag FROM events""",
}
