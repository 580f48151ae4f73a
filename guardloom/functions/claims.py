"""Claims and passages: sentences cut into statements, sources into parts, and the parts nearest to each statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.functions import text as tx
from guardloom.functions.text import let

_NONE = "array<string>"


def _n_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1))


def _whole(parts: Column, least: int) -> Column:
    """Parts of fewer than ``least`` words go with the one before them, a first one with the one after."""
    tidy = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[\s,;]+|[\s,;]+$", "")), lambda p: p != "")

    def add(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.concat(last, F.lit(", "), p)))
        short = (_n_words(p) < least) | ((n == 1) & (_n_words(last) < least))
        return F.when((n > 0) & short, joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(tidy, F.array().cast(_NONE), add)


def atomic_claims(sentence: Column, least: int = 3, each_side: int = 5) -> Column:
    """The statements of a sentence, or the sentence itself if it has but one; none for blank input.

    A comma before a conjunction or a semicolon divides. Where there is none, a
    bare "and" does, if every side has ``each_side`` words or more.
    """

    def of(s: Column) -> Column:
        marked = _whole(F.split(s, r"(?i),\s+(?:and|but|so|yet|while|whereas|although|though)\s+|;\s+"), least)
        sides = F.split(s, r"(?i)\s+and\s+")
        bare = F.when(F.forall(sides, lambda p: _n_words(p) >= each_side), _whole(sides, least)).otherwise(F.array(s))
        return let(marked, lambda m: F.when(F.size(m) > 1, m).otherwise(let(bare, lambda b: F.when(F.size(b) > 1, b).otherwise(F.array(s)))))

    return let(F.trim(F.coalesce(sentence, F.lit(""))), lambda s: F.when(s == "", F.array().cast(_NONE)).otherwise(of(s)))


def passages(source: Column, most_chars: int = 600, most: int = 12) -> Column:
    """A source in parts of at most ``most_chars``, by paragraphs and then by sentences; a longer sentence is a part.

    From the part number ``most`` on the rest stays in one piece, so nothing is
    lost. Blank sources have no part.
    """

    def packed(paragraph: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            last = F.element_at(acc, -1)
            fits = (F.size(acc) > 0) & (F.length(last) + F.length(s) + 1 <= most_chars)
            return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))

        return F.aggregate(tx.sentences(paragraph), F.array().cast(_NONE), add)

    def of(s: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(s, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
        parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most_chars, F.array(p)).otherwise(packed(p))))
        return let(parts, lambda p: F.when(F.size(p) > most, F.concat(F.slice(p, F.lit(1), F.lit(most - 1)), F.array(F.array_join(F.slice(p, F.lit(most), F.size(p)), "\n\n")))).otherwise(p))

    return let(F.trim(F.coalesce(source, F.lit(""))), lambda s: F.when(s == "", F.array().cast(_NONE)).when(F.length(s) <= most_chars, F.array(s)).otherwise(of(s)))


def nearest(claims: Column, parts: Column, k: int = 3) -> Column:
    """For each claim its ``k`` parts of largest word overlap (ties by order): array of (claim, parts: (overlap, part_no, part))."""
    bag = lambda c: F.array_distinct(tx.tokens(c))

    def ranked(c: Column) -> Column:
        scored = F.transform(parts, lambda p, i: F.struct((-tx.overlap(bag(c), bag(p))).alias("back"), i.alias("part_no"), p.alias("part")))
        return F.transform(F.slice(F.array_sort(scored), 1, k), lambda x: F.struct((-x["back"]).alias("overlap"), x["part_no"].alias("part_no"), x["part"].alias("part")))

    return F.transform(claims, lambda c: F.struct(c.alias("claim"), ranked(c).alias("parts")))
