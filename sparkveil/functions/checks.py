"""Checksums and shape tests on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import constants


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon (rotations 0-4, flips 5-9)."""
    ra, rb = a % 5, b % 5
    rot = (ra - rb) % 5 if a >= 5 else (ra + rb) % 5
    return rot + (5 if (a >= 5) != (b >= 5) else 0)


def _permutations() -> list[list[int]]:
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([base[d] for d in rows[-1]])
    return rows


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _digit_array(d: Column) -> Column:
    return F.transform(F.split(d, ""), lambda x: x.cast("int"))


def verhoeff_ok(c: Column) -> Column:
    """True for exactly 12 digits whose Verhoeff checksum is zero."""
    mul = constants([_dihedral(a, b) for a in range(10) for b in range(10)], "int")
    perm = constants([v for row in _permutations() for v in row], "int")
    d = digits(c)
    steps = F.transform(
        _digit_array(F.reverse(d)), lambda x, i: F.get(perm, (i % 8) * 10 + x)
    )
    check = F.aggregate(steps, F.lit(0), lambda acc, x: F.get(mul, acc * 10 + x))
    return F.coalesce(F.when(F.length(d) == 12, check == 0), F.lit(False))


def luhn_ok(c: Column) -> Column:
    """True for 14 or more digits whose Luhn sum is a multiple of ten."""
    d = digits(c)
    doubled = F.transform(
        _digit_array(F.reverse(d)),
        lambda x, i: F.when(i % 2 == 0, x).when(x < 5, x * 2).otherwise(x * 2 - 9),
    )
    total = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.when(F.length(d) >= 14, total % 10 == 0), F.lit(False))


# the ASCII characters among white space and separators
ASCII_BLANKS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    """Trim Unicode white space and separators from both ends."""
    wide = F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.when(F.octet_length(c) == F.length(c), F.btrim(c, F.lit(ASCII_BLANKS))).otherwise(wide)


def normalize_ws(c: Column) -> Column:
    """Remove all white space."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "")


def valid_pan(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"), F.lit(False))


def valid_aadhaar(c: Column) -> Column:
    return verhoeff_ok(c)


def confidence(type_: Column, value: Column, normalized: Column, base: Column) -> Column:
    """Confidence of one hit; checksum types look at the digits."""
    n_digits = F.length(digits(normalized))
    domain = F.lower(F.get(F.split(value, "@"), F.lit(1)))
    return (
        F.when(type_ == "AADHAAR", F.when(n_digits != 12, base)
               .when(verhoeff_ok(normalized), 0.95).otherwise(0.7))
        .when(type_ == "CARD_NUMBER", F.when(n_digits < 15, base)
              .when(luhn_ok(normalized), 0.9).otherwise(0.6))
        .when(type_ == "IMEI", F.when(n_digits < 14, base)
              .when(luhn_ok(normalized), 0.85).otherwise(0.6))
        .when(type_ == "UPI", F.when(~F.contains(value, F.lit("@")), base)
              .when(F.contains(domain, F.lit(".com")) | F.contains(domain, F.lit(".in")), 0.2)
              .otherwise(0.85))
        .otherwise(base)
    )
