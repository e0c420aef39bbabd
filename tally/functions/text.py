"""String helpers: masking, blank tests, yen amounts, prefixes, hashes."""
from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour).
MASK_TEXT = "***MASKED***"
DOCUMENT_PREFIX = "passage: "
QUERY_PREFIX = "query: "
# Every decimal digit of Unicode beyond ASCII, and the ASCII digit that it stands for.
OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)
# One match is either "<n> 万円" (x 10 000) or "<n> 円" (x 1); digits may carry
# thousands commas.  (?U) gives Java the Unicode \d and \s that Python uses.
YEN_PATTERN = r"(?U)(?:(\d+(?:,\d+)*)\s*万円|(\d+(?:,\d+)*)\s*円)"
MAN_ZEROS = "0000"


def mask_all(col: Column) -> Column:
    """Whole value replaced, type string."""
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(F.lit(MASK_TEXT))


def mask_keep_two(col: Column) -> Column:
    """First two characters kept, the rest replaced by '*'."""
    return F.concat(F.left(col, F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.length(col) - 2, F.lit(0))))


def is_blank(col: Column) -> Column:
    """NULL, empty or only (Unicode) whitespace."""
    return col.isNull() | col.rlike(r"(?U)^\s*$")


def with_prefix(col: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), col)


def _plain_digits(digits: Column) -> Column:
    return F.translate(F.regexp_replace(digits, ",", ""), OTHER_DIGITS, ASCII_DIGITS)


def yen_amounts(text: Column) -> Column:
    """Set (distinct array<string>, smallest first) of yen amounts named in a text.

    Amounts are whole numbers of any length, so they are kept as decimal strings without
    leading zeros, which are equal exactly when the amounts are.  One regex pass gives both
    groups per match; the man-group wins when present.  Whole text is scanned.
    """
    man = F.regexp_extract_all(text, F.lit(YEN_PATTERN), 1)
    yen = F.regexp_extract_all(text, F.lit(YEN_PATTERN), 2)
    both = F.arrays_zip(man.alias("m"), yen.alias("y"))
    values = F.transform(
        both,
        lambda p: F.when(F.length(p["m"]) > 0, F.concat(_plain_digits(p["m"]), F.lit(MAN_ZEROS))).otherwise(_plain_digits(p["y"])),
    )
    plain = F.array_distinct(F.transform(values, lambda v: F.regexp_replace(v, "^0+(?=[0-9])", "")))
    by_size = F.array_sort(F.transform(plain, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    return F.transform(by_size, lambda p: p["v"])


def account_number_from_key(key: Column) -> Column:
    """'ACC-' + first 8 characters of a stable hex digest, upper-cased."""
    return F.concat(F.lit("ACC-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 8)))
