"""Golden cases: normalisation, dedup, invoice rules, guardrails, exposure."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fernspan.functions import rules as R
from fernspan.functions import text as T
from fernspan.operators import ap, fx, metrics, similarity, tabular
from fernspan.operators.components import components
from fernspan.operators.dedup import label_conflicts, priority_dedup
from fernspan.session import scratch_path
from fernspan.sources import loaders, stores

NOW = dt.datetime(2026, 10, 20, 2, 0)


@pytest.mark.parametrize(
    ("text", "token"),
    [("Verify at http://bit.ly/x9", "urltoken"), ("Track at singpost.sg/track", "urltoken"), ("Call 91234567 now", "phonetoken"), ("Call +65 9123 4567 now", "phonetoken"), ("You won £2000", "moneytoken"), ("mail a@b.com", "urltoken"), ("mail a@b.dev", "emailtoken"), ("room 12", "numtoken")],
)
def test_placeholders(spark, text, token):
    got = spark.createDataFrame([(text,)], "t string").select(T.normalise_text(F.col("t"))).first()[0]
    assert token in got.split()


def test_priority_dedup_and_conflicts(spark):
    d = spark.createDataFrame([(1, "Hello, World!", "spam", 2), (2, "hello world", "smishing", 1), (3, "!!!", "ham", 1), (4, "other", "ham", None)], "id long, text string, label string, rank int")
    key = T.dedup_key(F.col("text"))
    kept = {r["id"]: r["label"] for r in priority_dedup(d, key, F.col("rank"), F.col("id")).collect()}
    assert kept == {2: "smishing", 4: "ham"}
    assert label_conflicts(d, key, "label").count() == 2


def test_ui_noise(spark):
    text = "Today 10:31\nYour parcel is held\nDelivered 9.05 pm\n\nPay now\nread"
    assert spark.createDataFrame([(text,)], "t string").select(T.without_ui_noise(F.col("t"))).first()[0] == "Your parcel is held Pay now"


def test_char_wb_short_words(spark):
    got = spark.createDataFrame([("A bc def",)], "t string").select(T.char_wb(F.col("t"), 3, 5)).first()[0]
    assert sorted(got) == sorted([" a ", " bc", "bc ", " bc ", " de", "def", "ef ", " def", "def ", " def "])


def test_red_flags(spark):
    d = spark.createDataFrame([(["Your", "account.", "123", "£100,000", "account", "x"], [0.5, 0.4, 0.3, 0.2, 0.1, 0.001])], "t array<string>, w array<double>")
    assert d.select(T.red_flags(F.col("t"), F.col("w"))).first()[0] == ["account", "£100,000"]


PO = [("PO-501", "ALPHA", 1250.0, "OPEN"), ("PO-502", "BETA", 8950.0, "OPEN"), ("PO-503", "GAMMA", 4700.0, "OPEN"), ("PO-505", "DELTA", 24600.0, "OPEN"), ("PO-9", "CLOSED CO", 10.0, "CLOSED"), ("PO-601", "SIGMA", 6000.0, "OPEN"), ("PO-602", "SIGMA", 5500.0, "OPEN")]
INVOICE = "seq long, team_id string, invoice_id string, supplier string, invoice_ref string, amount_usd string, po_id string, bank_changed string, channel string"
LEDGER = "invoice_id string, supplier string, invoice_ref string, amount_usd double, po_id string, status string, received_at timestamp"


def run(spark, invoices, ledger=()):
    rows = [(i, "T", *v, "api") for i, v in enumerate(invoices)]
    po = spark.createDataFrame([(i, *p, "b") for i, p in enumerate(PO)], "load_seq long, po_id string, supplier string, amount_usd double, status string, buyer string")
    out = ap.triage(spark.createDataFrame(rows, INVOICE), po, spark.createDataFrame(list(ledger), LEDGER), NOW)
    return [(r["status"], r["control_flags"]) for r in out.orderBy("seq").collect()], out


def test_batch_of_rules(spark):
    got, out = run(
        spark,
        [
            ("INV-201", "Alpha", "A-777", "1250", "PO-501", "NO"), ("INV-202", "Beta", "B-1", "8950", "PO-502", "NO"), ("INV-203", "Gamma", "G-1", "14700", "", "NO"), ("INV-204", "Alpha", "A-776", "1250", "PO-501", "NO"), ("INV-205", "Delta", "D-1", "24600", "PO-505", "NO"),
            ("INV-206", "Beta", "B-2", "9100", "PO-502", "NO"), ("INV-207", "Epsilon", "E-1", "100", "PO-999", "NO"), ("INV-208", "Gamma", "G-2", "4700", "PO-503", "yes"), ("INV-209", "Zeta", "Z", "-5", "PO-501", "NO"), ("", "Zeta", "Z2", "5", "PO-501", "NO"),
            ("INV-211", "Closed Co", "C", "10", "PO-9", "NO"), ("INV-212", "Alpha", " a-777 ", "1250", "PO-501", "NO"), ("INV-213", "Other", "O", "1250", "PO-501", "NO"),
        ],
    )
    assert got == [
        ("READY_FOR_HUMAN_CHECK", "NONE"), ("READY_FOR_HUMAN_CHECK", "NONE"), ("REVIEW_MISSING_PO", "MISSING_PO|HIGH_VALUE"), ("HOLD_DUPLICATE", "DUPLICATE"), ("REVIEW_MANAGER", "HIGH_VALUE"), ("REVIEW_PO_ALREADY_INVOICED", "PO_ALREADY_INVOICED|SPLIT_SUSPECTED"),
        ("REVIEW_UNKNOWN_PO", "UNKNOWN_PO"), ("HOLD_BANK_CHANGE", "BANK_CHANGE"), ("HOLD_INVALID_DATA", "INVALID_DATA"), ("HOLD_INVALID_DATA", "INVALID_DATA"), ("REVIEW_PO_CLOSED", "PO_CLOSED"), ("HOLD_DUPLICATE", "DUPLICATE"), ("REVIEW_PO_SUPPLIER", "PO_SUPPLIER_MISMATCH"),
    ]
    one = out.first()
    assert one["human_approval_required"] and not one["payment_authorized"] and not one["ai_can_override_status"]


@pytest.mark.parametrize(("age", "status"), [(dt.timedelta(days=1), "REVIEW_SPLIT_SUSPECTED"), (dt.timedelta(days=7), "REVIEW_SPLIT_SUSPECTED"), (dt.timedelta(days=8, hours=1), "READY_FOR_HUMAN_CHECK")])
def test_split_window(spark, age, status):
    old = [("INV-301", "SIGMA", "S-1", 6000.0, "PO-601", "READY_FOR_HUMAN_CHECK", NOW - age)]
    assert run(spark, [("INV-302", "Sigma", "S-2", "5500", "PO-602", "NO")], old)[0][0][0] == status


def test_ledger_memory(spark):
    old = [("INV-1", "alpha", " a-777 ", 5.0, "PO-501", "HOLD_INVALID_DATA", NOW), (None, "BETA", "B-1", 1.0, "PO-502", "READY_FOR_HUMAN_CHECK", NOW)]
    got, _ = run(spark, [("I", "ALPHA", "A-777", "1250", "PO-501", "NO"), ("J", "BETA", "B-1", "8950", "PO-502", "NO")], old)
    assert [g[0] for g in got] == ["HOLD_DUPLICATE", "READY_FOR_HUMAN_CHECK"]


def test_guardrails(spark):
    notes = ["Payment has been made.", "This is approved for payment", "Please send us your bank details number", "I approved it", "see REVIEW_MANAGER", "", "Check the supplier record."]
    d = spark.createDataFrame([(n, "HOLD_DUPLICATE", "r") for n in notes], "note string, status string, reason string")
    assert [r[0] for r in ap.guarded_notes(d).select("ai_guardrail").collect()] == ["BLOCKED"] * 6 + ["PASSED"]
    facts = '{"cases":3,"on_hold_usd":7200,"x":13}'
    b = spark.createDataFrame([("3 cases, $7,200.00 on hold, 13 more in 24 h", facts), ("9,999 on hold", facts), ("payments released", facts), ("", facts)], "raw string, facts_text string")
    got = [(r["ai_guardrail"], r["ai_briefing"]) for r in ap.guarded_briefing(b).collect()]
    assert [g[0] for g in got] == ["PASSED", "BLOCKED", "BLOCKED", "BLOCKED"]
    assert got[1][1] == "[AI briefing withheld: numbers not in the data: 9999]"


def test_numbers(spark):
    d = spark.createDataFrame([("",), ("1e3",), ("Infinity",), ("abc",), (" 7.5 ",), (None,)], "t string")
    assert [r[0] for r in d.select(R.number(F.col("t"))).collect()] == [None, 1000.0, None, None, 7.5, None]


def test_exposure(spark):
    run_date, ref = dt.date(2026, 10, 26), dt.date(2026, 10, 23)
    st = spark.createDataFrame([("EUR", 1.431, 1.4563, -0.03, ""), ("SGD", 1.0, 1.0, 0.0, ""), ("JPY", 0.008, 0.008, 0.7, "DAILY_MOVE|OFF_1M_AVERAGE|NO_HISTORY")], "currency string, today double, hi double, dod_pct double, alert string")
    inv = spark.createDataFrame([("a", "s", "eur", 18450.0, dt.date(2026, 10, 30)), ("b", "s", "SGD", 12000.0, dt.date(2026, 11, 2)), ("c", "s", "XYZ", 5000.0, dt.date(2026, 11, 9)), ("d", "s", "JPY", 1.0, dt.date(2026, 10, 24)), ("e", "s", "EUR", -1.0, dt.date(2026, 12, 1))], "invoice_id string, supplier string, currency string, amount double, due_date date")
    r = {x["invoice_id"]: x for x in fx.exposure(inv, st, run_date, ref).collect()}
    assert [r[k]["payment_bucket"] for k in "abcde"] == ["DUE_THIS_WEEK", "DUE_THIS_WEEK", "DUE_30_DAYS", "OVERDUE", "LATER"]
    assert [r[k]["status"] for k in "abcde"] == ["CONVERTED", "CONVERTED", "EXCEPTION", "CONVERTED_FX_ALERT", "EXCEPTION"]
    assert round(r["a"]["amount_sgd"], 2) == 26401.95 and r["b"]["fx_risk_sgd"] == 0 and r["c"]["amount_sgd"] is None
    assert r["d"]["note"] == "JPY DAILY_MOVE + OFF_1M_AVERAGE|NO_HISTORY (0.70% d/d)"


def test_append_once(spark):
    new = spark.createDataFrame([(dt.date(2026, 1, 1), "EUR", 1.0)], "rate_date date, currency string, eur_rate double")
    assert fx.append_once(new.limit(0), new).count() == 1 and fx.append_once(new, new).count() == 0


def test_review_rule(spark):
    d = spark.createDataFrame([([0.97, 0.03, 0.0], "ham"), ([0.55, 0.0, 0.45], "ham"), ([0.45, 0.0, 0.55], "spam")], "proba array<double>, pred string")
    assert [r[0] for r in d.select(metrics.answer_cost(F.col("proba"), F.col("pred")) > 0.5).collect()] == [True, False, False]


def test_grouped_interval_is_wider(spark):
    rows = [(g, "smishing", "smishing" if g % 3 else "ham", f"{g}/{i}") for g in range(12) for i in range(10)]
    d = spark.createDataFrame(rows, "g long, y string, pred string, one string")
    width = lambda c: (lambda r: r["hi"] - r["lo"])(metrics.bootstrap(d, F.col(c), 300, 1).first())
    assert width("g") > width("one")


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), (10, 11), (11, 12), (12, 13), (13, 10), (3, 2)], "src long, dst long")
    assert {r["v"]: r["component"] for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, 10: 10, 11: 10, 12: 10, 13: 10}
    path = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    assert {r["component"] for r in components(path).collect()} == {0}


def test_near_copies(spark):
    base = "Your parcel is held at customs, please pay the fee today at the counter or it will be returned to the sender"
    d = spark.createDataFrame([(1, base), (2, base.replace("today", "now")), (3, "Shall we meet for dinner near the office after work?"), (4, base), (5, "")], "id long, text string")
    c = {r["id"]: r["cluster"] for r in similarity.near_copy_clusters(d, "id", "text").collect()}
    assert c[1] == c[2] == c[4] == 1 and c[3] == 3


def test_roles_and_registry(spark, tmp_path):
    p = f"file://{tmp_path}/x"
    spark.createDataFrame([("1", "ham", "see you at dinner, then"), ("2", "phishing", "pay now"), ("3", "0", "ok")], "no string, kind string, body string").write.option("header", "true").csv(p)
    got = {(r["text"], r["label"]) for r in loaders.load_csv(spark, p).collect()}
    assert ("pay now", "smishing") in got and len(got) == 3
    both = loaders.load_all(spark, {"a": lambda: loaders.load_csv(spark, p), "gone": lambda: loaders.load_csv(spark, p + "-gone")})
    assert both.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        loaders.load_all(spark, {"gone": lambda: loaders.load_csv(spark, p + "-gone")}, strict=True)
    with pytest.raises(ValueError, match="target"):
        loaders.require_target(both, "spam")


def test_keyed_table(spark):
    t = stores.KeyedTable(spark, scratch_path(spark, "t"), "k long, v string").ensure()
    t.insert(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), 1, "k")
    t.update(spark.createDataFrame([(2, "c")], "k long, v string"), 2, "k")
    assert sorted((r["k"], r["v"]) for r in t.rows().collect()) == [(1, "a"), (2, "c")]
    t.reset()
    assert t.rows().count() == 0


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, v double")
    assert tabular.value_counts(e, "k").count() == 0 and tabular.histogram(e, "v", 0, 1, 4).count() == 0
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
