"""Numbers written in table cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliant.functions.text import col, strip

_BODY = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NEGATIVE = rf"^(?:\(({_BODY})\)|({_BODY})-)$"
_PLUS = rf"^({_BODY})\+$"


def to_double(c: Column) -> Column:
    """Invariant-culture number text: optional sign on either side, parentheses for negatives,
    thousands commas and exponent.  Anything else is null.

    A straight chain of replacements: every step is used once, so the generated
    code stays small.
    """
    signed = F.regexp_replace(F.regexp_replace(strip(c), _NEGATIVE, "-$1$2"), _PLUS, "$1")
    return F.translate(F.regexp_extract(signed, rf"^[+-]?{_BODY}$", 0), ",", "").try_cast("double")


def parse_numeric(c: Column | str) -> Column:
    """Number in a cell; a trailing unit is dropped, not applied.

    One comma and no dot is a decimal comma; commas before a dot are thousands.
    """
    bare = F.rtrim(F.replace(col(c), F.lit(" "), F.lit("")), F.lit("GMKTbBps"))
    point = F.regexp_replace(bare, r"^([^,.]*),([^,.]*)$", "$1.$2")
    return to_double(F.when(point.rlike(r"^[^,.]*,.*\."), F.translate(point, ",", "")).otherwise(point))


def unit_letter(c: Column | str) -> Column:
    return F.upper(F.right(strip(c), F.lit(1)))


def parse_bandwidth(c: Column | str) -> Column:
    """Cell value in Mbps; a bare number is Mbps already."""
    v = strip(c)
    unit = F.upper(F.right(v, F.lit(1)))
    has_unit = unit.isin("G", "T", "M", "K")
    factor = (F.when(unit == "G", F.lit(1000.0)).when(unit == "T", F.lit(1000000.0))
              .when(unit == "K", F.lit(0.001)).otherwise(F.lit(1.0)))
    digits = F.when(has_unit, F.left(v, F.length(v) - 1)).otherwise(v)
    return to_double(F.rtrim(digits, F.lit("bBpPsSit"))) * factor


def format_result(c: Column | str) -> Column:
    """Whole numbers without decimals, others with two, rounded on the exact binary value.

    ``format_string('%.2f')`` rounds the shortest decimal text of a double, so a
    value just under a tie (1.005) would go the wrong way.  The fraction is
    therefore scaled by 2**62, which is exact, and divided as integers.
    """
    c = col(c)
    size = F.abs(c)
    whole = F.floor(size).cast("bigint")
    scaled = ((size - whole) * F.lit(float(2 ** 62))).cast("bigint").cast("decimal(20,0)")
    one = F.lit(2 ** 62).cast("decimal(20,0)")
    hundred = scaled * F.lit(100).cast("decimal(3,0)")
    rest = hundred % one  # exact; a decimal quotient alone would be rounded
    cents = ((hundred - rest) / one).cast("bigint") + (rest >= F.lit(2 ** 61).cast("decimal(20,0)")).cast("int")
    carried = whole + F.when(cents >= 100, F.lit(1)).otherwise(F.lit(0))
    text = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), carried.cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(text)


def half_even(c: Column, digits: int) -> Column:
    """Round ties to the even neighbour."""
    return F.bround(c, digits)
