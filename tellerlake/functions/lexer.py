"""Statements by their tokens: one pattern cuts a text into strings, quoted names, comments, words, blanks and signs.

No token is lost, so a statement is the concatenation of its tokens. A doubled quote ends a string and begins the next
one, which is all the same here. Strings and comments that do not end go on to the end of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DESTRUCTIVE_WORDS, STAR_COLUMNS

STRING, COMMENT = r"'[^']*(?:'|\z)", r"--[^\n]*|#[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
QUOTED = r'"[^"]*(?:"|\z)|`[^`]*(?:`|\z)'
WORD = r"[A-Za-z_][A-Za-z_0-9$]*"
TOKEN = rf"{STRING}|{QUOTED}|{COMMENT}|{WORD}|[0-9]+|\s+|[\s\S]"


def tokens(text: Column) -> Column:
    """All tokens of a statement, in order; null for null."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def computed(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression is computed again wherever it is named, for each token inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def code(text: Column) -> Column:
    """The tokens that mean something, in order: words and quoted names in lower case and without quotes, signs and strings as they are."""
    return _code(tokens(text))


def _code(found: Column) -> Column:
    kept = F.filter(found, lambda t: ~t.rlike(rf"^(?:\s|{COMMENT})"))
    return F.transform(kept, lambda t: F.when(t.rlike(r'^["`]'), F.concat(F.lit('"'), F.lower(F.translate(t, '"`', "")))).when(t.startswith("'"), t).otherwise(F.lower(t)))


def names(text: Column) -> Column:
    """Words and quoted names of a statement in lower case, without quotes."""
    return _names(tokens(text))


def _names(found: Column) -> Column:
    return F.transform(F.filter(_code(found), lambda t: t.rlike('^[a-z_"]')), lambda t: F.translate(t, '"', ""))


def is_destructive(text: Column) -> Column:
    """Does a data-changing word stand in the statement as a word of its own, not in a string, a comment or a quoted name?"""
    return F.arrays_overlap(code(text), F.array(*[F.lit(w) for w in DESTRUCTIVE_WORDS]))


def lineage(text: Column, oltp: str = "bank_oltp", dw: str = "bank_dw") -> Column:
    """OLTP, DW, Both or Unknown, by the schemas that qualify a name: followed by a dot, and not in a string or a comment."""
    def told(found: Column) -> Column:
        def qualifies(schema: str) -> Column:
            return F.exists(F.transform(found, lambda t, i: F.translate(t, '"', "").eqNullSafe(F.lit(schema)) & F.get(found, i + 1).eqNullSafe(F.lit("."))), lambda x: x)

        return computed(qualifies(oltp), lambda o: computed(qualifies(dw), lambda d: F.when(o & d, "Both").when(o, "OLTP").when(d, "DW").otherwise("Unknown")))

    return computed(code(text), told)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _silent(token: Column) -> Column:
    return token.rlike(rf"^(?:\s|{COMMENT})")


def _places(found: Column, test) -> Column:
    """Places of the tokens that pass the test."""
    return F.filter(F.transform(found, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def _end(found: Column, select: Column) -> Column:
    """Place of the first FROM behind the star of ``select`` with as many open brackets in front of it as in front of ``select``."""
    def step(acc: Column, t: Column) -> Column:
        level = F.when(acc["i"] == select["at"], acc["now"]).otherwise(acc["level"])
        here = acc["end"].isNull() & (acc["i"] > select["next"]) & (F.lower(t) == "from") & (acc["now"] == acc["level"])
        now = acc["now"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        return F.struct((acc["i"] + 1).alias("i"), now.alias("now"), level.alias("level"), F.when(here, acc["i"]).otherwise(acc["end"]).alias("end"))

    none = F.lit(None).cast("int")
    return F.aggregate(found, F.struct(F.lit(0).alias("i"), F.lit(0).alias("now"), none.alias("level"), none.alias("end")), step, lambda acc: acc["end"])


def expand_star(text: Column) -> Column:
    """The first ``SELECT *`` up to its FROM replaced by the fixed list of columns; a text without one stays.

    Blanks and comments may stand between the words; the FROM is the next one outside of brackets opened after the star.
    """
    def stars(found: Column, heard: Column) -> Column:
        pairs = F.transform(heard, lambda p, i: F.struct(p.alias("at"), F.get(heard, i + 1).alias("next")))
        return F.get(F.filter(pairs, lambda p: (F.lower(F.get(found, p["at"])) == "select") & (F.get(found, p["next"]) == "*")), F.lit(0))

    def expanded(found: Column, select: Column, end: Column) -> Column:
        head = _joined(F.slice(found, F.lit(1), select["at"]))
        tail = _joined(F.slice(found, end + 1, F.size(found)))
        return F.when(end.isNotNull(), F.concat(head, F.lit("SELECT " + ", ".join(STAR_COLUMNS) + " "), tail)).otherwise(text)

    return computed(tokens(text), lambda found: computed(
        computed(_heard(found), lambda heard: stars(found, heard)), lambda select: computed(
            F.when(select.isNotNull(), _end(found, select)), lambda end: expanded(found, select, end))))


def _heard(found: Column) -> Column:
    """Places of the tokens that are no blanks and comments."""
    return _places(found, lambda t: ~_silent(t))


def ensure_column(text: Column, column: str = "product_id") -> Column:
    """``column`` put first into a statement that begins with SELECT and does not name it, after DISTINCT or ALL if there is one."""
    def ensured(found: Column, heard: Column) -> Column:
        first, second = F.get(heard, F.lit(0)), F.get(heard, F.lit(1))
        after = F.when(F.lower(F.get(found, second)).isin("distinct", "all"), second).otherwise(first)
        wanted = (F.lower(F.get(found, first)) == "select") & ~F.array_contains(_names(found), column)
        patched = F.concat(_joined(F.slice(found, F.lit(1), after + 1)), F.lit(f" {column},"), _joined(F.slice(found, after + 2, F.size(found))))
        return F.when(F.coalesce(wanted, F.lit(False)), patched).otherwise(text)

    return computed(tokens(text), lambda found: computed(_heard(found), lambda heard: ensured(found, heard)))
