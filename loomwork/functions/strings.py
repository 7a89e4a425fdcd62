"""Column expressions over text: tokens, neighbours, JSON keys, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters, numbers and underscores of any script.
WORD = r"([\p{L}\p{N}_]+)"


def stripped(text: Column, left: bool = True) -> Column:
    """Text without white space at its end and, with ``left``, at its start."""
    text = F.regexp_replace(text, r"\s+$", "")
    return F.regexp_replace(text, r"^\s+", "") if left else text


def tokens(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def grams(words: Column, n: int, names: str | list[str], kept: str | list[str] | None = None) -> Column:
    """All runs of ``n`` neighbours in an array, as structs of the slots ``kept`` (all, if not given); none if it is shorter.

    The array is zipped with itself, shifted: no lambda, so it stays in generated code.
    """
    runs = F.greatest(F.lit(0), F.size(words) - (n - 1))
    shifted = [F.slice(words, F.lit(k + 1), runs).alias(c) for k, c in enumerate(names) if kept is None or c in kept]
    return F.arrays_zip(*shifted)


def bigrams(words: Column) -> Column:
    return grams(words, 2, ["x", "y"])


def json_value(value: Column) -> Column:
    """A value as JSON text, written as ``json.dumps`` does: strings, with other than ASCII characters escaped, and whole numbers."""
    text = F.regexp_extract(F.to_json(F.struct(value.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    # A character beyond ASCII is its UTF-16 units, four digits each.
    escaped = lambda c: F.when(c <= F.lit("\x7f"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1"))
    each = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(each)


def md5_mod(text: Column, n: int) -> Column:
    """The md5 of a text as a 128-bit number, modulo n: Horner's rule over four 32-bit pieces."""
    if not 0 < n < 1 << 31:
        raise ValueError("the modulus must be positive and below 2**31")
    digest, r = F.md5(text), F.lit(0).cast("long")
    for i in range(4):
        r = (r * F.lit(1 << 32) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % F.lit(n).cast("long")
    return r


def shard(key: Column, n: int) -> Column:
    """The shard of a key among n: the same in every run and on every machine."""
    return md5_mod(json_value(key), n)


def thousands(number: Column) -> Column:
    """A whole number as text, with commas between groups of three digits."""
    return F.format_number(number, 0)


def percent(share: Column, digits: int = 4, width: int = 0) -> Column:
    """A share as text in percent, with so many digits after the point, filled up with spaces on the left."""
    return F.format_string(f"%{width or ''}.{digits}f%%", share * 100.0)


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's md5, as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
