"""Rule banks: named patterns that are tried only where one of their words occurs.

Patterns are over plain lower-case text and use only what Java and RE2 regular
expressions have in common, so that a bank can be written out as SQL as well.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.functions.text import words
from guardloom.operators.hits import hit, hits_of


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    message: str
    pattern: str
    words: tuple[str, ...]  # one of these tokens must be in the text for the pattern to match; () if that cannot be said


def rules(prefix: str, text: str) -> list[Rule]:
    """Rules from lines ``id | severity | message | words | pattern``."""
    out = []
    for line in text.strip().splitlines():
        name, severity, message, words, pattern = (x.strip() for x in line.split(" | ", 4))
        out.append(Rule(f"{prefix}.{name}", severity, message, pattern, tuple(words.split()) if words != "-" else ()))
    return out


def scan(plain: Column, tokens: Column, bank: Iterable[Rule]) -> Column:
    """The hits of a bank: each rule at most once, in the bank's order."""
    bank = list(bank)
    all_words = sorted({w for r in bank for w in r.words})
    found = []
    for r in bank:
        ok = plain.rlike(r.pattern)
        if r.words:
            ok = F.arrays_overlap(tokens, words(*r.words)) & ok
        found.append(F.when(ok, hit(r.rule_id, r.severity, r.message)))
    hits = hits_of(*found)
    if all(r.words for r in bank) and bank:
        hits = F.when(F.arrays_overlap(tokens, words(*all_words)), hits).otherwise(hits_of())
    return hits


def any_of(plain: Column, tokens: Column, bank: Iterable[Rule]) -> Column:
    return F.size(scan(plain, tokens, bank)) > 0


def scan_sql(plain: str, bank: Iterable[Rule]) -> str:
    """Rule ids of a bank's hits as a DuckDB list, without the words."""
    cases = ", ".join(f"CASE WHEN regexp_matches({plain}, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN '{r.rule_id}' END" for r in bank)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def risk_sql(plain: str, bank: Iterable[Rule]) -> str:
    w = {"low": 10, "medium": 30, "high": 50}
    parts = " + ".join(f"CASE WHEN regexp_matches({plain}, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN {w[r.severity]} ELSE 0 END" for r in bank)
    return f"CAST(least(100, {parts}) AS INTEGER)"
