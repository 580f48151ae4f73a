"""Numbers that states give to persons: their formats, check digits, and permutations that keep both."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date


def _mod11(d: str, weights: range | list[int]) -> int:
    return sum(int(c) * w for c, w in zip(d, weights)) % 11


def _nhs(d: str) -> str | None:
    r = (11 - _mod11(d, range(10, 1, -1))) % 11
    return None if r == 10 else str(r)


def _cpf(d: str) -> str | None:
    a = _mod11(d, range(10, 1, -1)) * 10 % 11 % 10
    return None if len(set(d)) == 1 else f"{a}{_mod11(f'{d}{a}', range(11, 1, -1)) * 10 % 11 % 10}"


def _pesel(d: str) -> str | None:
    month, day = int(d[2:4]), int(d[4:6])
    century = {0: 1900, 1: 2000, 2: 2100, 3: 2200, 4: 1800}.get(month // 20)
    try:
        date((century or 0) + int(d[:2]), month % 20, day)
    except ValueError:
        return None
    return str(-sum(int(c) * w for c, w in zip(d, [1, 3, 7, 9] * 3)) % 10)


def _snils(d: str) -> str | None:
    s = sum(int(c) * w for c, w in zip(d, range(9, 0, -1))) % 101
    return f"{s % 100:02d}"


def _steuer(d: str) -> str | None:
    if d[0] == "0":
        return None
    p = 10
    for c in d:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def _nir(d: str) -> str | None:
    if d[0] not in "12" or not (1 <= int(d[3:5]) <= 12 or int(d[3:5]) >= 20):
        return None
    return f"{97 - int(d) % 97:02d}"


def _bsn(d: str) -> str | None:
    r = sum(int(c) * w for c, w in zip(d, range(9, 1, -1))) % 11
    return None if r == 10 or not int(d) else str(r)


def _sin(d: str) -> str | None:
    if d[0] in "08":
        return None
    s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d))
    return str(-s % 10)


def _ssn(d: str) -> str | None:
    return "" if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" else None


#: Fixed value: check letters of Spanish identity numbers by remainder of 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _dni(d: str) -> str | None:
    return DNI_LETTERS[int(d) % 23]


def _nie(d: str) -> str | None:
    return DNI_LETTERS[int(f"{'XYZ'.index(d[0])}{d[1:]}") % 23]


#: Fixed values of the Italian code: what characters at odd places count.
_ODD_PLACES = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]))


def _fiscal(u: str) -> str | None:
    if not 1 <= int(u[9:11]) <= 71 or 31 < int(u[9:11]) < 41:
        return None
    s = sum(_ODD_PLACES[c] if i % 2 == 0 else (int(c) if c.isdigit() else ord(c) - 65) for i, c in enumerate(u))
    return chr(65 + s % 26)


@dataclass(frozen=True)
class Scheme:
    """A format as written, the length of what precedes the check, and the check of it (None: no such number)."""

    name: str
    pattern: re.Pattern
    payload: int
    check: Callable[[str], str | None]

    def holds(self, value: str) -> bool:
        if not self.pattern.fullmatch(value):
            return False
        u = plain(value)
        return self.check(u[: self.payload]) == u[self.payload :]


def plain(value: str) -> str:
    return "".join(c for c in value.upper() if c.isalnum())


#: In this order; the first that holds names a number.
SCHEMES = [
    Scheme(name, re.compile(p), n, check)
    for name, p, n, check in (
        ("ssn", r"\d{3}([- ])\d{2}\1\d{4}", 9, _ssn),
        ("nhs", r"\d{3}[ -]?\d{3}[ -]?\d{4}", 9, _nhs),
        ("cpf", r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}", 9, _cpf),
        ("snils", r"\d{3}-\d{3}-\d{3}[ -]\d{2}", 9, _snils),
        ("pesel", r"\d{11}", 10, _pesel),
        ("steuer", r"[1-9]\d ?\d{3} ?\d{3} ?\d{3}", 10, _steuer),
        ("nir", r"[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d", 13, _nir),
        ("sin", r"\d{3}[- ]\d{3}[- ]\d{3}", 8, _sin),
        ("bsn", r"\d{9}|\d{4}\.\d{2}\.\d{3}", 8, _bsn),
        ("dni", r"\d{8}[- ]?[A-HJ-NP-TV-Z]", 8, _dni),
        ("nie", r"[XYZ][- ]?\d{7}[- ]?[A-HJ-NP-TV-Z]", 8, _nie),
        ("fiscal", r"[A-Z]{6} ?\d\d[A-EHLMPRST]\d\d ?[A-Z]\d{3}[A-Z]", 15, _fiscal),
    )
]


def scheme_of(value: str) -> Scheme | None:
    return next((s for s in SCHEMES if s.holds(value)), None)


def written_like(value: str, u: str) -> str:
    """``u`` with the signs and blanks of ``value``, whose letters and digits it replaces."""
    new = iter(u)
    return "".join(next(new) if c.isalnum() else c for c in value)


def permuted(value: str, digits: Callable[[str], str]) -> str:
    """The value with its digits permuted by ``digits`` and its check worked out anew.

    The permutation is walked until its result is a number of the same scheme
    (or, like the value, of none), so it permutes the numbers of each scheme
    among themselves and can be undone the same way.
    """
    s = scheme_of(value)
    u = plain(value)
    while True:
        if s is None:
            new = iter(digits("".join(c for c in u if c.isdigit())))
            u = "".join(next(new) if c.isdigit() else c for c in u)
        else:
            head = u[: s.payload]
            new = iter(digits("".join(c for c in head if c.isdigit())))
            head = "".join(next(new) if c.isdigit() else c for c in head)
            # where there is no such number the walk goes on from a number that is none
            u = head + (s.check(head) or u[s.payload :])
        got = written_like(value, u)
        if scheme_of(got) == s:
            return got
