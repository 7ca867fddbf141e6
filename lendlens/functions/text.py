"""Text helpers with the exact trimming, padding and casing rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a label.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?inf(inity)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim any white space, not only blanks. A character trim, not a regex: these labels are
    normalised inside long CASE chains, and filters push those chains down to the scan."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def norm(c: Column | str) -> Column:
    return F.lower(strip(c))


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters that have a case, in any alphabet
    (``initcap`` only looks at blanks)."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), ""
    )


def coded_id(c: Column | str, prefix: str, width: int) -> Column:
    """``prefix`` + the digits of ``c`` as a zero-padded number; never truncates long numbers.

    Without digits the raw text is kept behind ``prefix-``; a null stays null.
    """
    c = col(c)
    digits = F.regexp_replace(c, "[^0-9]+", "")
    number = F.ltrim(digits, F.lit("0"))
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(width)), F.lit("0"))
    return F.when(digits == "", F.concat(F.lit(prefix + "-"), c)).otherwise(F.concat(F.lit(prefix), padded))


def number_text(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number (also ``nan``) is null."""
    clean = norm(c)
    return F.when(clean.rlike(NUMBER_PATTERN), clean.try_cast("double"))


def number_or_percent(c: Column | str) -> Column:
    """``0.45`` or ``45%`` to double; unreadable text is null."""
    clean = norm(c)
    scale = F.when(clean.endswith("%"), 100.0).otherwise(1.0)
    return number_text(F.rtrim(clean, F.lit("%"))) / scale


def clean_double(c: Column | str) -> Column:
    """Tolerant numeric cast; NaN never enters a table."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def clean_timestamp(c: Column | str) -> Column:
    return col(c).try_cast("timestamp_ntz")


def clamp01(c: Column) -> Column:
    """Limit to [0, 1]; null stays null (``greatest`` would drop it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
