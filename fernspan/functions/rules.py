"""Scalar rules of invoice control and FX reporting, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses, and what review notes and briefings must not claim.
STATUSES = (
    "READY_FOR_HUMAN_CHECK", "HOLD_INVALID_DATA", "HOLD_DUPLICATE", "HOLD_BANK_CHANGE", "REVIEW_MISSING_PO", "REVIEW_UNKNOWN_PO",
    "REVIEW_PO_CLOSED", "REVIEW_PO_SUPPLIER", "REVIEW_PO_ALREADY_INVOICED", "REVIEW_AMOUNT_MISMATCH", "REVIEW_SPLIT_SUSPECTED", "REVIEW_MANAGER",
)
FORBIDDEN_NOTE = r"(?i)(approved for payment|has been (approved|paid)|is approved|been paid|payment (has been|was|is) (made|sent|released|scheduled)|ready for payment|authori[sz]ed? (the |this )?payment|i (have )?approved|bank (account|details) (number|to)|send (us|me) your)"
FORBIDDEN_BRIEF = r"(?i)(approved for payment|has been paid|were paid|payments? (made|sent|released))"
FREE_NUMBERS = ("1", "2", "3", "24")


def upper_cut(value: Column, n: int) -> Column:
    return F.substring(F.upper(F.trim(F.coalesce(value.cast("string"), F.lit("")))), 1, n)


def number(raw: Column) -> Column:
    """A finite number or null: blank and unreadable texts, NaN and infinities are null."""
    x = F.trim(raw.cast("string")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def yes(value: Column) -> Column:
    return upper_cut(F.coalesce(value, F.lit("NO")), 10).isin("YES", "TRUE", "1")


def priority(status: Column) -> Column:
    return F.when(status.startswith("HOLD"), "P1").when(status.startswith("REVIEW"), "P2").otherwise("P3")


def case_id(now_ms: int, day: str, invoice_id: Column, index: Column) -> Column:
    name = F.regexp_replace(F.when(invoice_id == "", "NOID").otherwise(invoice_id), "[^A-Z0-9]", "")
    return F.concat(F.lit(f"AP-{day}-"), name, F.lit("-"), F.right((F.lit(now_ms) + index).cast("string"), F.lit(5)))


def days_bucket(days: Column) -> Column:
    return F.when(days < 0, "OVERDUE").when(days <= 7, "DUE_THIS_WEEK").when(days <= 30, "DUE_30_DAYS").otherwise("LATER")


def signed_percent(x: Column) -> Column:
    return F.format_string("%+.2f%%", x.cast("double"))


def long_date(text: Column) -> Column:
    """'23 October 2026' to a date."""
    return F.to_date(text, "d MMMM yyyy")


def numbers_in(text: Column) -> Column:
    """The numbers of a text as canonical strings, thousands separators dropped."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x.try_cast("double").cast("decimal(30,6)").cast("string"), r"\.?0+$", ""))


def invented_numbers(text: Column, facts: Column) -> Column:
    """Numbers of the text that are neither in the facts nor small counts that any text may use."""
    allowed = F.array_union(numbers_in(facts), F.array(*map(F.lit, FREE_NUMBERS)))
    return F.array_except(numbers_in(text), allowed)


def note_problems(note: Column, status: Column) -> Column:
    """What is wrong with a review note: empty, a forbidden claim, or another status named."""
    raw = F.trim(F.coalesce(note, F.lit("")))
    other = F.get(F.filter(F.array(*map(F.lit, STATUSES)), lambda s: (s != status) & F.contains(raw, s)), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(raw == "", "empty answer"),
            F.when(raw.rlike(FORBIDDEN_NOTE), "claims approval/payment or asks for bank details"),
            F.when(other.isNotNull(), F.concat(F.lit("mentions a different status "), other)),
        )
    )
