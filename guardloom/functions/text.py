"""Column functions over text; all of them built-in expressions that stay in the JVM.

Each takes and returns columns; null in gives null out unless said otherwise.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that draw nothing.
INVISIBLE = "[­​‌‍⁠﻿]"
#: Letters of other scripts and the Latin letters that they look like.
HOMOGLYPHS = ("аеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαАВЕКМНОРСТУХ", "aeopcyxijsdhqwABEZHIKMNOPTYXoaABEKMHOPCTYX")
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
FOLD_FROM, FOLD_TO = HOMOGLYPHS[0] + _WIDE[0] + "   　", HOMOGLYPHS[1] + _WIDE[1] + "    "
#: Digits and signs written for letters.
LEET = ("013457@$!", "oieastasi")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def words(*w: str) -> Column:
    """The words as an array literal; one expression however many there are."""
    return F.split(F.lit("\n".join(w)), "\n") if w else F.array().cast("array<string>")


def hmac_sha256(c: Column, key: str | bytes) -> Column:
    """HMAC-SHA256 of the text under a key, as 64 hex digits; two plain digests, so it stays in the JVM."""
    k = key.encode() if isinstance(key, str) else key
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = bytearray(x ^ 0x36 for x in k), bytearray(x ^ 0x5C for x in k)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "utf-8")), 256))), 256)


def plain(c: Column) -> Column:
    """Lower case, without invisible characters, widths and look-alike letters undone."""
    return F.lower(F.translate(F.regexp_replace(c, INVISIBLE, ""), FOLD_FROM, FOLD_TO))


def plain_sql(c: str) -> str:
    """``plain`` as DuckDB SQL."""
    q = lambda s: s.replace("'", "''")
    return f"lower(translate(regexp_replace({c}, '{INVISIBLE}', '', 'g'), '{q(FOLD_FROM)}', '{q(FOLD_TO)}'))"


def leet(c: Column) -> Column:
    """Digits and signs read as the letters they stand for."""
    return F.translate(c, *LEET)


def squeezed(c: Column) -> Column:
    """Letters repeated three times or more, once."""
    return F.regexp_replace(c, r"([a-z])\1{2,}", "$1")


def despaced(c: Column) -> Column:
    """Single letters set apart by blanks or dots, joined: 'b a d' and 'b.a.d' to 'bad'."""
    return F.regexp_replace(c, r"(?<=(?:^|[^a-z0-9])[a-z])[ .\-_](?=[a-z](?:[ .\-_]|$|[^a-z0-9]))", "")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def sentences(c: Column, longer_than: int = 0) -> Column:
    """Parts that end in . ! or ? and a blank; trimmed, empty ones and short ones left out."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def length_without(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, ""))


def share_of(c: Column, pattern: str) -> Column:
    """Share of the characters that match a one-character pattern; 0 for empty text."""
    n = F.length(c)
    return F.when(n > 0, (n - length_without(c, pattern)) / n).otherwise(0.0)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character, 0 for empty text.

    The characters are sorted and counted in runs, so the cost is n log n.
    """
    chars = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    n = F.length(c).cast("double")
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    term = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + term(acc["run"])).alias("sum"))

    total = F.aggregate(chars, start, step, lambda acc: acc["sum"] + term(acc["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def ngrams(words: Column, n: int) -> Column:
    """Arrays of n words as text, in order; shorter input gives none."""
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        k = F.size(w) - F.lit(n - 1)
        return F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)

    return let(words, of)


def trigrams(c: Column) -> Column:
    """Character trigrams in order, by one scan with a lookahead."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), 1)


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct items of ``a`` that are in ``b``; 0 if ``a`` is empty."""
    own = F.array_distinct(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of one length; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
