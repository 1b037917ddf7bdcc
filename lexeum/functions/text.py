"""Column functions on text. White space is Unicode's, as in Python, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
SOLID = r"(?U)[^\s\x1c-\x1f]"

# What CSV readers take for missing, and placeholders in exported sheets.
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
PLACEHOLDERS = ("", "None", "<NA>", "nan", "NaN")
NEWLINE_TOKEN = "NEWLINE_TOKEN"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_STRINGS), c)


def filled(c: Column) -> Column:
    """As string; null is ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def reason(c: Column) -> Column:
    return strip(filled(c))


def no_placeholder(c: Column) -> Column:
    s = strip(filled(c))
    return F.when(s.isin(*PLACEHOLDERS), F.lit("")).otherwise(s)


def fallback(first: Column, second: Column) -> Column:
    """``first`` unless it is ''."""
    return F.when(first != "", first).otherwise(second)


def newlines(c: Column) -> Column:
    return F.replace(c, F.lit(NEWLINE_TOKEN), F.lit("\n"))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def cleaned(c: Column) -> Column:
    """Tags to blanks, then addresses to [URL], then runs of white space to one blank; case and signs stay."""
    c = F.regexp_replace(filled(c), r"<[^>]+>", " ")
    c = F.regexp_replace(c, rf"https?://{SOLID}+|www\.{SOLID}+", "[URL]")
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def content_hash(c: Column) -> Column:
    return F.md5(c)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(SOLID + "+"))


def preview(c: Column, n: int = 80) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("…"))


def numeric(c: Column) -> Column:
    """Only numerals of any script, at least one, as Python's ``isnumeric`` but for ideographs that stand for numbers; null stays null."""
    return c.rlike(r"^[\p{Nd}\p{Nl}\p{No}]+$")


def letters_only(c: Column) -> Column:
    """All but Latin and German letters to blanks, mentions of users out."""
    return F.replace(F.regexp_replace(c, "[^A-Za-zäÄöÖüÜß]+", " "), F.lit("TwitterUser"), F.lit(" "))


def small_words(c: Column) -> Column:
    """The words of :func:`letters_only` in small letters, empty ones among them: split once, without a copy of the text for its blanks."""
    for x in ("TwitterUser", "\u0130", "\u1e9e", "\u212a"):  # a name, and the only other signs whose small form has one of these letters
        c = F.replace(c, F.lit(x), F.lit(" "))
    return F.split(F.lower(c), "[^a-zäöüß]+")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _near(x: Column, digits: int) -> Column:
    """:func:`_nearest` in doubles alone, for 0 <= x * 10**digits < 2**50 and up to 7 digits.

    ``p`` is the product rounded to a double; only where it lies half-way between
    two whole numbers can its error decide. The error is exact: the halves of
    ``x``, of 26 bits each, times the power, of 24 bits at most, are doubles.
    """
    power, p = 10.0**digits, x * 10.0**digits
    n = F.rint(p)
    high = x * 134217729.0 - (x * 134217729.0 - x)  # 2**27 + 1
    error = (high * power - p) + (x - high) * power
    return (n + F.when(F.abs(p - n) == 0.5, F.when((p - n) * error > 0, (p - n) * 2).otherwise(0.0)).otherwise(0.0)).cast("long")


def _nearest(x: Column, digits: int) -> Column:
    """The whole number nearest to x * 10**digits, ties to even; null unless 0 <= x < 2**52 and the result is a long."""
    if digits > 7:
        return _nearest_whole(x, digits)
    return F.when(x * 10.0**digits < float(1 << 50), _near(x, digits)).otherwise(_nearest_whole(x, digits))


def _nearest_whole(x: Column, digits: int) -> Column:
    """:func:`_nearest` in whole decimals.

    A double is a whole number of 2**-shift. Both that number and the power are
    whole decimals, so twice the remainder of their quotient tells the side on
    which the exact binary value lies.
    """
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n).cast("decimal(19,0)")
    shift = F.greatest(F.lit(0), 53 - F.floor(F.log2(x)).cast("int"))  # so many that the number is whole, though the logarithm may be one off

    def parts(s: Column) -> Column:
        whole = (power(F.least(s, F.lit(60))) * power(F.greatest(s - 60, F.lit(0)))).cast("decimal(38,0)")
        number = ((x * F.pow(F.lit(2.0), s)).cast("long").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(19,0)")).cast("decimal(38,0)")
        return F.struct(number.alias("a"), whole.alias("b"))

    def even(t: Column) -> Column:
        def up(q: Column) -> Column:
            rest = (t["a"] - (q.cast("decimal(19,0)") * t["b"]).cast("decimal(38,0)")) * 2
            return q + ((rest > t["b"]) | ((rest == t["b"]) & (q % 2 == 1))).cast("long")

        return _let(F.call_function("div", t["a"], t["b"]), up)

    fits = (x < float(1 << 52)) & (x * 10.0**digits < 9e18)
    # what is under 2**-66 rounds to nothing at any number of digits here
    return F.when(x < 2.0**-66, F.lit(0).cast("long")).when(fits, _let(_let(shift, parts), even))


def rounded(c: Column, digits: int = 0) -> Column:
    """The double nearest to ``c`` rounded to ``digits`` (at most 15), ties to even, decided by the exact binary value, as Python's ``round``."""
    return _let(c.cast("double"), lambda x: F.coalesce(F.signum(x) * _nearest(F.abs(x), digits).cast("double") / 10.0**digits, x))


def rounded_scaled(c: Column, digits: int = 0) -> Column:
    """``c`` times the power of ten, to the nearest whole number, ties to even, and back: what arrays' ``round`` gives."""
    return F.rint(c.cast("double") * 10.0**digits) / 10.0**digits


def _shown(x: Column, digits: int) -> Column:
    """:func:`fixed` of numbers that :func:`_near` cannot round."""

    def said(q: Column) -> Column:
        odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_string(f"%.{digits}f", x))
        cut = lambda t: F.concat(_sign(x), F.substr(t, F.lit(1), F.length(t) - digits), F.lit("." if digits else ""), F.right(t, F.lit(digits)) if digits else F.lit(""))
        text = _let(q.cast("string"), lambda t: _let(F.lpad(t, F.greatest(F.lit(digits + 1), F.length(t)), F.lit("0")), cut))
        return F.when(q.isNotNull(), text).otherwise(odd)

    return _let(_nearest_whole(F.abs(x), digits), said)


def _sign(x: Column) -> Column:
    return F.when((x < 0) | ((x == 0) & (F.signum(x).cast("string") == "-0.0")), "-").otherwise("")


def fixed(c: Column, digits: int = 2) -> Column:
    """``c`` with ``digits`` after the point, correctly rounded as :func:`rounded`; null stays null.

    Numbers of up to 7 digits and less than 2**50 in units of the last one are
    rounded and written by compiled code, where ``c`` stands several times: it
    is to be a column or a cheap expression of columns.
    """
    x = c.cast("double")
    slow = _let(x, lambda v: _shown(v, digits))
    if digits > 7:
        return F.when(x.isNotNull(), slow)
    units, power = _near(F.abs(x), digits), F.lit(10**digits).cast("long")
    whole, rest = F.call_function("div", units, power).cast("string"), F.substr((power + units % power).cast("string"), F.lit(2))
    text = F.concat(_sign(x), whole, F.lit("."), rest) if digits else F.concat(_sign(x), whole)
    return F.when(F.abs(x) * 10.0**digits < float(1 << 50), text).when(x.isNotNull(), slow)


def percent(c: Column, digits: int = 2, blank: bool = True) -> Column:
    return F.concat(fixed(c, digits), F.lit(" %" if blank else "%"))


def thousands(c: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(c, 0)


def capitalised(c: Column) -> Column:
    """The first letter large, all others small, words behind blanks too."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)
