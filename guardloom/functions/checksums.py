"""Check digits as column expressions over strings; null and malformed input give false.

Signs and blanks between digits are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(d: Column, i: Column | int) -> Column:
    return F.substring(d, i if isinstance(i, Column) else F.lit(i), F.lit(1)).cast("int")


def weighted(d: Column, weights: list[int]) -> Column:
    """Sum of the leading digits times their weights."""
    out = F.lit(0)
    for i, w in enumerate(weights, 1):
        out = out + _digit(d, i) * F.lit(w)
    return out


def _is(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(False))


def luhn(c: Column, least: int = 13) -> Column:
    d = digits(c)
    return _is((F.length(d) >= least) & F.call_function("luhn_check", d))


def repeated(d: Column) -> Column:
    return d.rlike(r"^(\d)\1*$")


#: The multiplication and permutation tables of the dihedral check digit.
_VERHOEFF_D = "0123456789 1234067895 2340178956 3401289567 4012395678 5987604321 6598710432 7659821043 8765932104 9876543210".split()
_VERHOEFF_P = "0123456789 1576283094 5803796142 8916043527 9453126870 4286573901 2793806415 7046913258".split()


def verhoeff(c: Column, length: int = 12) -> Column:
    d = F.reverse(digits(c))
    table, perm = F.lit("".join(_VERHOEFF_D)), F.lit("".join(_VERHOEFF_P))
    at = lambda t, i: F.substring(t, i + 1, F.lit(1)).cast("int")
    step = lambda acc, i: at(table, acc * 10 + at(perm, F.pmod(i, F.lit(8)) * 10 + F.substring(d, i + 1, F.lit(1)).cast("int")))
    return _is((F.length(d) == length) & (F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0), step) == 0))


def sin_ca(c: Column) -> Column:
    d = digits(c)
    return _is((F.length(d) == 9) & F.call_function("luhn_check", d) & ~d.rlike("^[08]"))


def nhs_uk(c: Column) -> Column:
    d = digits(c)
    r = F.pmod(F.lit(11) - F.pmod(weighted(d, list(range(10, 1, -1))), F.lit(11)), F.lit(11))
    return _is((F.length(d) == 10) & (r < 10) & (r == _digit(d, 10)))


def _mod11(d: Column, weights: list[int]) -> Column:
    r = F.pmod(weighted(d, weights) * 10, F.lit(11))
    return F.when(r == 10, 0).otherwise(r)


def cpf_br(c: Column) -> Column:
    d = digits(c)
    return _is((F.length(d) == 11) & ~repeated(d) & (_mod11(d, list(range(10, 1, -1))) == _digit(d, 10)) & (_mod11(d, list(range(11, 1, -1))) == _digit(d, 11)))


def cnpj_br(c: Column) -> Column:
    d, w = digits(c), [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    check = lambda ws: F.when(F.pmod(weighted(d, ws), F.lit(11)) < 2, 0).otherwise(11 - F.pmod(weighted(d, ws), F.lit(11)))
    return _is((F.length(d) == 14) & ~repeated(d) & (check(w) == _digit(d, 13)) & (check([6, *w]) == _digit(d, 14)))


def nif_es(c: Column) -> Column:
    """Spanish DNI and NIE: the letter by the remainder of 23."""
    u = F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    n = F.concat(F.translate(F.substring(u, 1, 1), "XYZ", "012"), F.substring(u, 2, 7)).cast("int")
    letter = F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), F.pmod(n, F.lit(23)) + 1, F.lit(1))
    return _is(u.rlike("^[0-9XYZ][0-9]{7}[A-Z]$") & (letter == F.substring(u, 9, 1)))


def bsn_nl(c: Column) -> Column:
    d = digits(c)
    s = weighted(d, [9, 8, 7, 6, 5, 4, 3, 2]) - _digit(d, 9)
    return _is((F.length(d) == 9) & (d != "000000000") & (F.pmod(s, F.lit(11)) == 0))


def tfn_au(c: Column) -> Column:
    d = digits(c)
    return _is((F.length(d) == 9) & (F.pmod(weighted(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]), F.lit(11)) == 0))


def abn_au(c: Column) -> Column:
    d = digits(c)
    s = weighted(d, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10
    return _is((F.length(d) == 11) & (F.pmod(s, F.lit(89)) == 0))


def acn_au(c: Column) -> Column:
    d = digits(c)
    check = F.pmod(F.lit(10) - F.pmod(weighted(d, [8, 7, 6, 5, 4, 3, 2, 1]), F.lit(10)), F.lit(10))
    return _is((F.length(d) == 9) & (check == _digit(d, 9)))


def ktp_id(c: Column) -> Column:
    """Indonesian identity number: digits 7-12 are a date, women's days plus 40."""
    d = digits(c)
    day = F.substring(d, 7, 2).cast("int")
    day, month = F.when(day > 40, day - 40).otherwise(day), F.substring(d, 9, 2).cast("int")
    return _is((F.length(d) == 16) & day.between(1, 31) & month.between(1, 12))


def ipv4(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return _is(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x.cast("int") <= 255))


def private_ipv4(c: Column) -> Column:
    return _is(ipv4(c) & c.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)"))
