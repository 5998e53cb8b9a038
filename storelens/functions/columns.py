"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that text trimming removes, not only the blank.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Written dates, each shape once: figures with slashes, dashes, dots or nothing between, and month names.
# A text is only read as what it looks like, month first: 03/04/2026 is the fourth of March,
# 25/12/2025 can only be Christmas.
_CLOCK = r"(?: (?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)?"
_HALF_DAY = r" (?:0?[1-9]|1[0-2]):[0-5]\d(?::[0-5]\d)? [ap]m"
_TWO_FIGURES = (
    rf"(?i)^(?:(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:{_HALF_DAY}|{_CLOCK})|(\d{{1,2}})([-.])(\d{{1,2}})\5(\d{{4}}))$"
)
_YEAR_FIRST = (
    rf"(?i)^(?:(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_CLOCK}|(\d{{4}})\.(\d{{1,2}})\.(\d{{1,2}})"
    rf"|(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_HALF_DAY}|(\d{{4}})(\d{{2}})(\d{{2}}))$"
)
# A month's name is kept by its first three letters; it is whole or has just these, September four.
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_MONTHS = {name: str(k) for k, name in enumerate(_MONTH[1:-1].split("|"), 1)}
_REST = (
    "(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust|(?<=sep)t(?:ember)?"
    "|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?"
)
_SHORT = "(?:(?<=sep)t)?"
_NAMED = (
    rf"(?i)^(?:{_MONTH}{_REST} (?:(\d{{1,2}}),? )(\d{{4}}){_CLOCK}|(\d{{1,2}}) {_MONTH}{_REST} (\d{{4}})"
    rf"|(\d{{1,2}})-{_MONTH}{_SHORT}-(\d{{4}}))$"
)
_MONTH_ALONE = rf"(?i)^{_MONTH}{_REST} (\d{{4}})$"
_SHORT_YEAR = r"(?i)^(\d{1,2}/\d{1,2}/|\d{1,2} (?:[a-z]{3}|sept) |\d{1,2}-(?:[a-z]{3}|sept)-)(\d{2})$"
# A day name says nothing that the date does not.
_DAY_NAME = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all whitespace, line breaks included (`trim` alone drops blanks only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def money(c: Column | str) -> Column:
    """`$1,234.50` -> 1234.50; text that is no amount -> NULL."""
    return F.regexp_replace(col(c), "[$,]", "").try_cast("decimal(18,2)")


def number(c: Column | str) -> Column:
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def whole_number(c: Column | str) -> Column:
    return number(c).try_cast("int")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of the value, which is worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _date_of(text: Column) -> Column:
    """The date that a text shows by its shape; a text of no such shape has none."""

    def read(pattern: str, order: str, named: bool = False) -> Column:
        def day(w: Column) -> Column:
            number = lookup(F.lower(F.substr(w, F.lit(6), F.lit(3))), _MONTHS)
            return (F.concat(F.left(w, F.lit(5)), number, F.substr(w, F.lit(9))) if named else w).try_cast("date")

        return once(F.regexp_replace(text, pattern, order), lambda w: F.when(w != text, day(w)))

    figure = F.left(text, F.lit(1)).between("0", "9")
    clock = (F.substr(text, F.lit(5), F.lit(1)) == "-") & ~F.right(text, F.lit(1)).isin("m", "M") & text.rlike(r"^\d{4}-")
    return (
        F.when(figure & clock, text.try_cast("timestamp_ntz").cast("date"))
        .when(text.rlike("[A-Za-z]{3}"), F.coalesce(read(_NAMED, "$3$6$9-$1$5$8-$2$4$7", named=True), read(_MONTH_ALONE, "$2-$1-1", named=True)))
        .when(figure & (F.substr(text, F.lit(2), F.lit(2)).rlike("[/.-]")), F.coalesce(read(_TWO_FIGURES, "$3$7-$1$4-$2$6"), read(_TWO_FIGURES, "$3$7-$2$6-$1$4")))
        .when(figure & (F.length(text) == 4), text.try_cast("date"))
        .when(figure & text.rlike(r"^\d{4}"), read(_YEAR_FIRST, "$1$4$7$10-$2$5$8$11-$3$6$9$12"))
    )


def mixed_date(c: Column | str, strict: bool = False) -> Column:
    """Date out of mixed human formats.

    Empty text is missing. Other unreadable text is NULL, or fails the query when
    `strict`. A time of day is dropped, so the last day of a period is whole.
    """
    first = lambda text: F.left(text, F.lit(1))
    plain = lambda text: F.when(first(text) >= "A", F.regexp_replace(text, _DAY_NAME, "")).otherwise(text)
    # Only the shortest texts can end in a year of two figures.
    whole = lambda text: F.when(F.length(text) <= 11, F.regexp_replace(text, _SHORT_YEAR, "$120$2")).otherwise(text)
    text = once(once(strip(c), plain), whole)
    parsed = once(text, _date_of)
    if not strict:
        return parsed
    return F.when(
        parsed.isNull() & (strip(c) != ""),
        F.raise_error(F.concat(F.lit("unreadable date: "), strip(c))).cast("date"),
    ).otherwise(parsed)


def lookup(c: Column | str, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Value of a small fixed mapping, or `default` for other and missing keys.

    The mapping is a literal inside the expression: no join, nothing to broadcast.
    """
    if not mapping:
        found = F.lit(None).cast("string")
    else:
        found = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), col(c))
    if default is None:
        return found
    return F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def localized(c: Column | str, labels: Mapping[str, str]) -> Column:
    """Display label of a value; a value without a label shows as itself."""
    return lookup(c, labels, default=col(c))


def pretty(c: Column | str) -> Column:
    """`cash_on_delivery` -> `Cash on delivery`."""
    words = F.replace(col(c), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2))))


def money_text(c: Column | str, digits: int = 0) -> Column:
    """1234.5 -> `$1,234` (halves to the even neighbour)."""
    return F.concat(F.lit("$"), F.format_number(col(c).cast("double"), digits))


def percent_text(c: Column | str) -> Column:
    """8.84 -> `8.8%`."""
    return F.concat(F.format_number(col(c).cast("double"), 1), F.lit("%"))


def not_cancelled(status: Column | str = "order_status") -> Column:
    """True for every status but cancelled, a missing one included."""
    return ~col(status).eqNullSafe("cancelled")


def status_is(value: str, status: Column | str = "order_status") -> Column:
    return col(status).eqNullSafe(value)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, NULL when b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    """a / b as double, 0 when b is 0."""
    return F.when(col(b) == 0, F.lit(0.0)).otherwise(ratio(a, b))


def change_pct(now: Column | str, before: Column | str) -> Column:
    """(now - before) / before in percent, 0 against a zero base."""
    now, before = col(now).cast("double"), col(before).cast("double")
    return F.when(before == 0, F.lit(0.0)).otherwise(F.try_divide(now - before, before) * 100)


def total_of(c: Column | str) -> Column:
    """Sum where an empty sum is 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0).cast("decimal(28,2)"))


def run_length(flags: list[Column]) -> Column:
    """How many of the flags hold in a row, counted from the first one."""
    return reduce(
        lambda rest, flag: F.when(flag, rest + 1).otherwise(F.lit(0)), reversed(flags), F.lit(0)
    )
