"""Checksums, entropy and value hashing as higher-order functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewatch import rules

# The decimal digits of all other scripts, by their value.
SCRIPT_DIGITS = {c: str(unicodedata.decimal(c)) for c in map(chr, range(128, 0x20000)) if unicodedata.category(c) == "Nd"}


def _verhoeff_tables() -> tuple[list[int], list[int]]:
    """The two Verhoeff tables, flattened, from their group definition.

    Digits are the dihedral group of the pentagon: 0-4 rotations, 5-9
    reflections. Position ``i`` permutes digits by the i-th power of one
    fixed permutation.
    """
    multiply = []
    for a in range(10):
        for b in range(10):
            if a < 5:
                multiply.append((a + b) % 5 if b < 5 else 5 + (a + b) % 5)
            else:
                multiply.append(5 + (a - b) % 5 if b < 5 else (a - b) % 5)
    step = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # fixed value
    permute = list(range(10))
    powers = []
    for _ in range(8):
        powers.extend(permute)
        permute = [step[d] for d in permute]
    return multiply, powers


def _int_array(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(str(v) for v in values) + ")")


def strip_separators(value: Column) -> Column:
    """Drop the spaces and dashes a number may be written with."""
    return F.regexp_replace(value, r"(?U)[\s\-]", "")


def ascii_digits(value: Column) -> Column:
    """Digits of any script as 0 to 9, so that a number has one hash and one checksum however it is written."""
    return F.translate(value, "".join(SCRIPT_DIGITS), "".join(SCRIPT_DIGITS.values()))


def _digit_at(value: Column, index: Column) -> Column:
    return F.ascii(F.substring(value, index + 1, F.lit(1))) - F.lit(48)


def verhoeff_check(number: Column) -> Column:
    """True where the digits fold to zero; false for anything but digits."""
    multiply, powers = _verhoeff_tables()
    rev = F.reverse(strip_separators(number))

    def fold(acc: Column, i: Column) -> Column:
        permuted = F.get(_int_array(powers), (i % 8) * 10 + _digit_at(rev, i))
        return F.get(_int_array(multiply), acc * 10 + permuted)

    folded = F.aggregate(F.sequence(F.lit(0), F.length(rev) - 1), F.lit(0), fold)
    return F.when(rev.rlike("^[0-9]+$"), folded == 0).otherwise(F.lit(False))


def luhn_check(number: Column) -> Column:
    """True where the Luhn sum is a multiple of ten; false for anything but digits."""
    return F.call_function("luhn_check", strip_separators(number))


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for an empty string."""
    n = F.length(value)
    chars = F.array_sort(F.array_distinct(F.split(value, "")))
    chars = F.filter(chars, lambda c: F.length(c) > 0)

    def fold(acc: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(value, c, F.lit("")))).cast("double") / n
        return acc - share * F.log2(share)

    return F.when(n > 0, F.aggregate(chars, F.lit(0.0).cast("double"), fold)).otherwise(F.lit(0.0))


def high_entropy(value: Column, cut: float = rules.ENTROPY_CUT) -> Column:
    return shannon_entropy(value) >= F.lit(cut)


def hash_value(value: Column, salt: str) -> Column:
    """Salted SHA-256 of the stripped value. The salt is required configuration."""
    if not salt:
        raise ValueError("a salt is required to hash matched values")
    stripped = F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")
    return F.sha2(F.concat(F.lit(salt), stripped), 256)


# One-argument functions: Spark hands a second parameter of a filter the index.
CHECKS = {"verhoeff": verhoeff_check, "luhn": luhn_check, "entropy": lambda value: high_entropy(value)}


def register_sql_functions(spark: SparkSession, salt: str) -> None:
    """Offer the checks to SQL users as temporary SQL functions (``luhn_check`` is built in)."""
    multiply, powers = _verhoeff_tables()
    m, p = ",".join(map(str, multiply)), ",".join(map(str, powers))
    strip = r"regexp_replace(v, '(?U)[\\s\\-]', '')"
    digit = f"(ascii(substring(reverse({strip}), i + 1, 1)) - 48)"
    indexes = f"sequence(0, length({strip}) - 1)"
    digits_only = f"{strip} rlike '^[0-9]+$'"
    salt_sql = salt.replace("\\", "\\\\").replace("'", "\\'")
    bodies = {
        "verhoeff_check(v STRING) RETURNS BOOLEAN": (
            f"CASE WHEN {digits_only} THEN aggregate({indexes}, 0, (a, i) -> "
            f"get(array({m}), a * 10 + get(array({p}), (i % 8) * 10 + {digit}))) = 0 ELSE false END"
        ),
        "shannon_entropy(v STRING) RETURNS DOUBLE": (
            "CASE WHEN length(v) > 0 THEN aggregate(filter(array_sort(array_distinct(split(v, ''))), c -> length(c) > 0), "
            "CAST(0 AS DOUBLE), (a, c) -> a - (length(v) - length(replace(v, c, ''))) / length(v) "
            "* log2((length(v) - length(replace(v, c, ''))) / length(v))) ELSE CAST(0 AS DOUBLE) END"
        ),
        "hash_value(v STRING) RETURNS STRING": (
            f"sha2(concat('{salt_sql}', regexp_replace(v, '(?U)^\\\\s+|\\\\s+\\\\z', '')), 256)"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
