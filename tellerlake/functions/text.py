"""Text rules: money and percent wording, statement cleaning and tagging, schema notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up

WHITESPACE = " \t\n\r\f\v"

# Words that mark a statement as changing data, and the columns that replace a star.
DESTRUCTIVE_WORDS = ["delete", "update", "insert", "drop", "alter", "truncate", "create"]
STAR_COLUMNS = ["member_id AS customer_id", "first_name", "last_name", "email", "phone", "date_of_birth"]
# Notes by table name (first match wins) and by column name (all that match).
TABLE_NOTES = [
    (["member"], "Customer/member information"),
    (["payment"], "Payment transactions and history"),
    (["credit_card", "card"], "Credit card details and management"),
    (["financial_health", "health"], "Financial health metrics and scoring"),
    (["product"], "Financial products and offerings"),
    (["recommendation"], "Product recommendations and suggestions"),
]
PREFIX_NOTES = [("dim_", "Dimension table for analytics"), ("fact_", "Fact table for metrics and measures")]
COLUMN_NOTES = [
    (["income"], "Income-related data"),
    (["score"], "Scoring and rating metrics"),
    (["balance"], "Account balances and amounts"),
    (["date", "time"], "Time-series data"),
]


def money(value: Column) -> Column:
    """$1,234 (whole dollars, half-up)."""
    return F.concat(F.lit("$"), F.format_number(F.floor(value.cast("double") + 0.5), 0))


def percent(value: Column) -> Column:
    """12.3% of a fraction."""
    return F.format_string("%.1f%%", half_up(value.cast("double") * 100, 1))


def clean_statement(text: Column) -> Column:
    """Drop code fences or a leading ``sql`` word, then one trailing semicolon."""
    body = F.btrim(text, F.lit(WHITESPACE))
    tagged = F.replace(body, F.lit("```sql"), F.lit(""))
    bare = F.btrim(
        F.when(body.startswith("```sql"), F.replace(tagged, F.lit("```"), F.lit("")))
        .when(body.startswith("```"), F.replace(body, F.lit("```"), F.lit("")))
        .when(F.lower(F.substr(body, F.lit(1), F.lit(3))) == "sql", F.substr(body, F.lit(4)))
        .otherwise(body),
        F.lit(WHITESPACE))
    shorter = F.substr(bare, F.lit(1), F.greatest(F.length(bare) - 1, F.lit(0)))
    return F.when(bare.endswith(";"), F.btrim(shorter, F.lit(WHITESPACE))).otherwise(bare)


def expand_star(text: Column) -> Column:
    """Replace everything up to the FROM after the first ``select *`` by the fixed column list."""
    low = F.lower(text)
    star = F.locate("select *", low)
    after = F.locate("from", F.substr(low, F.greatest(star, F.lit(1))))
    head = "SELECT " + ", ".join(STAR_COLUMNS) + " "
    rewritten = F.concat(F.lit(head), F.substr(text, star + after - 1))
    return F.when((star > 0) & (after > 0), rewritten).otherwise(text)


def ensure_column(text: Column, column: str = "product_id") -> Column:
    """Add the column to a statement that starts with SELECT and does not name it.

    The first upper-case and the first lower-case keyword are both patched.
    """
    low = F.lower(text)
    patched = text
    for word in ("SELECT", "select"):
        spot = F.instr(patched, word)
        patched = F.when(
            spot > 0,
            F.concat(F.substr(patched, F.lit(1), spot - 1), F.lit(f"{word} {column},"),
                     F.substr(patched, spot + len(word))),
        ).otherwise(patched)
    wanted = F.ltrim(low).startswith("select") & ~low.contains(column)
    return F.when(wanted, patched).otherwise(text)


def lineage(text: Column, oltp_prefix: str = "bank_oltp.", dw_prefix: str = "bank_dw.") -> Column:
    """Which schema prefixes a statement names: OLTP, DW, Both or Unknown."""
    low = F.lower(text)
    oltp, dw = low.contains(oltp_prefix), low.contains(dw_prefix)
    return F.when(oltp & dw, "Both").when(oltp, "OLTP").when(dw, "DW").otherwise("Unknown")


def is_destructive(text: Column, mode: str = "substring") -> Column:
    """Does the text hold a data-changing word, as any substring or as a whole word?"""
    if mode not in ("substring", "word"):
        raise ValueError("mode is substring or word")
    words = "|".join(DESTRUCTIVE_WORDS)
    return F.lower(text).rlike(words if mode == "substring" else rf"\b({words})\b")


def table_note(table: Column) -> Column:
    low = F.lower(table)
    expr = F
    for needles, note in TABLE_NOTES:
        test = F.lit(False)
        for needle in needles:
            test = test | low.contains(needle)
        expr = expr.when(test, note)
    for prefix, note in PREFIX_NOTES:
        expr = expr.when(low.startswith(prefix), note)
    return expr.otherwise(F.lit(None).cast("string"))


def mentions(column: Column, needles: list[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | F.lower(column).contains(needle)
    return test
