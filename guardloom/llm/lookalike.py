"""One consistent form for texts that look the same but differ in their characters.

Look-alike characters are mapped first (widths, blanks, invisible characters,
ligatures, letters of other scripts). What remains is grouped by the Unicode
collation, under which composed and combining accents are equal while accents,
case, punctuation and raised digits differ. Each class gets one canonical
member, which is joined back; it is written in a form that does not depend on
which members there are, so the results of different tables compare as well.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.session import materialize

#: Letters that readers take for the Latin letter below them.
LOOKALIKES = {
    # Cyrillic
    "АВЕЅІЈКМНОРСТУХҮԌԚԜҺҒӀ": "ABESIJKMHOPCTYXYGQWhFI",
    "аеіјорсухѕһԁԛԝӏгҽүԍѵѡ": "aeijopcyxshdqwlreygvw",
    # Greek
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ": "ABEZHIKMNOPTYXCj",
    "ονικυραϲγ": "ovikupacy",
    # Armenian
    "ոսօհցքՏՕԼ": "nuohgqSOL",
    # Latin letters of phonetic and other alphabets
    "ɑɡıȷꞌꓐꓓꓖꓙꓚ": "agij'BDGJC",
}
#: Hyphens, apostrophes and dots drawn alike.
PUNCTUATION = {"‐‑‒−﹣": "-----", "ʼʹ՚": "'''", "․‧": ".."}
#: Every kind of blank between words.
BLANKS = "\t               　"
#: Characters that draw nothing, as a regular expression class.
INVISIBLE = r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\x00-\x08\x0b-\x1f\x7f-\x9f]"


def _width_variants() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form looks the same: one-character ones, and ligatures.

    By rule: full and half width, fonts and compatibility forms of letters and
    digits; raised, lowered, circled and fractional forms look different and stay.
    """
    one, many = {}, {}
    for cp in [*range(0x00A0, 0x3000), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if not d or not d.startswith(("<wide>", "<narrow>", "<font>", "<compat>")):
            continue
        to = unicodedata.normalize("NFKC", ch)
        if len(to) == 1:
            one[ch] = to
        elif to.isalnum() and len(to) <= 4 and cp < 0xFB50:
            many[ch] = to
    return one, many


def _table() -> tuple[str, str, dict[str, str], dict[str, str]]:
    """Characters and what each becomes, ligatures, and by mark the composed letters that keep it apart."""
    one, many = _width_variants()
    marked: dict[str, str] = {}
    for part in (LOOKALIKES, PUNCTUATION):
        for src, dst in part.items():
            assert len(src) == len(dst), (src, dst)
            one.update(zip(src, dst))
    for cp in [*range(0x0370, 0x0590), 0x1E9B, *range(0x1F00, 0x2000)]:  # composed look-alikes, as their decomposition maps
        d = unicodedata.normalize("NFD", chr(cp))
        if d != chr(cp) and d[0] in one:
            to = unicodedata.normalize("NFC", one[d[0]] + d[1:])
            one[chr(cp)] = to if len(to) == 1 else one[d[0]]
            if len(to) > 1:
                marked[d[1:]] = marked.get(d[1:], "") + chr(cp)
    one.update({c: " " for c in BLANKS})
    for c, to in list(one.items()):  # a width variant of a look-alike, in one step
        one[c] = one.get(to, to)
    return "".join(one), "".join(one.values()), many, marked


_FROM, _TO, _LIGATURES, _MARKED = _table()


def _invisible() -> str:
    """The characters of INVISIBLE below U+10000, for tables that delete them; by category and range."""
    more = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0x00, 0x09), *range(0x0B, 0x20), *range(0x7F, 0xA0)]))
    return more + "".join(c for c in map(chr, range(0xA0, 0x10000)) if unicodedata.category(c) == "Cf" and c not in more)


_GONE = "".join(c for c in _invisible() if c not in _FROM)


_NOT_ASCII = r"[^\x20-\x7e\n]"
#: Invisible characters beyond the tables: tags and variation selectors.
_ASTRAL_INVISIBLE = r"[\x{E0001}-\x{E007F}\x{E0100}-\x{E01EF}\x{1D173}-\x{1D17A}\x{110BD}\x{110CD}\x{13430}-\x{1343F}\x{1BCA0}-\x{1BCA3}]"


def skeleton(col: Column | str) -> Column:
    """The text with look-alike characters mapped; built-in functions only.

    Blanks at the ends draw nothing and go, as do carriage returns. Plain ASCII
    texts skip the tables.
    """
    c = F.col(col) if isinstance(col, str) else col
    kept = c
    for marks, letters in _MARKED.items():
        kept = F.regexp_replace(kept, f"([{letters}])", f"$1{marks}")
    kept = F.when(c.rlike("[" + "".join(_MARKED.values()) + "]"), kept).otherwise(c)
    s = F.translate(kept, _FROM + _GONE, _TO)  # characters without a counterpart are deleted
    s = F.when(c.rlike(_ASTRAL_INVISIBLE), F.regexp_replace(s, _ASTRAL_INVISIBLE, "")).otherwise(s)
    few = "[" + "".join(_LIGATURES) + "]"
    spelt = s
    for lig, to in _LIGATURES.items():
        spelt = F.replace(spelt, F.lit(lig), F.lit(to))
    mapped = F.when(c.rlike(few), spelt).otherwise(s)
    return F.trim(F.when(c.rlike(_NOT_ASCII), mapped).otherwise(c))


def look_key(col: Column | str) -> Column:
    """The skeleton under accent- and case-sensitive Unicode collation: equal iff it looks equal."""
    return F.collate(skeleton(col), "UNICODE")


#: Every character that has a canonical decomposition, but Hangul syllables.
_COMPOSED = [cp for cp in [*range(0x00C0, 0xAC00), *range(0xF900, 0x1FFFF), *range(0x2F800, 0x2FA20)] if (d := unicodedata.decomposition(chr(cp))) and d[0] != "<"]


def _coarse_table() -> tuple[str, str]:
    """The look-alike table with accents dropped as well, by rule.

    Composed characters become the first one of their canonical decomposition;
    the marks that occur in such decompositions are deleted, with the invisible
    characters and Hangul (whose syllables are written in two ways).
    """
    to, gone = dict(zip(_FROM, _TO)), set(_GONE)
    gone |= {chr(cp) for cp in [*range(0x1100, 0x1200), *range(0xAC00, 0xD7A4)]}
    for cp in _COMPOSED:
        d = unicodedata.normalize("NFD", chr(cp))
        if d != chr(cp):
            to.setdefault(chr(cp), d[0])
            gone |= set(d[1:])
    for c, x in list(to.items()):  # to the end: a width variant of a composed letter, an accented look-alike
        while (y := to.get(x, unicodedata.normalize("NFD", x)[:1])) != x:
            x = y
        to[c] = x
    gone |= {c for c, x in to.items() if x in gone}  # a mark that is another one
    kept = {c: x for c, x in to.items() if c not in gone}
    return "".join(kept) + "".join(sorted(gone)), "".join(kept.values())


_COARSE_FROM, _COARSE_TO = _coarse_table()


def coarse_hash(col: Column | str) -> Column:
    """A 64-bit hash that is equal for texts of equal look, and for few others.

    What the collation holds equal is equal here, so only rows that share a
    hash with a different text need be collated.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.translate(c, _COARSE_FROM, _COARSE_TO)
    few = "[" + "".join(_LIGATURES) + "]"
    spelt = bare
    for lig, to in _LIGATURES.items():
        spelt = F.replace(spelt, F.lit(lig), F.lit(to))
    bare = F.when(c.rlike(few), spelt).otherwise(bare)
    bare = F.when(c.rlike(_ASTRAL_INVISIBLE), F.regexp_replace(bare, _ASTRAL_INVISIBLE, "")).otherwise(bare)
    return F.xxhash64(F.trim(F.when(c.rlike(_NOT_ASCII), bare).otherwise(c)))


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __t, __m of the rows that share their coarse hash with a different text.

    Hashes are worked out once and written (two numbers a row). Minima and
    maxima per hash are kept while counting, so no hash is too hot; the texts
    themselves are moved once, by their row's id.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).filter("__t is not null")
    keyed = materialize(rows.select("__id", coarse_hash("__t").alias("__h"), F.xxhash64(F.col("__t"), F.length("__t")).alias("__o")))
    several = keyed.groupBy("__h").agg(F.min("__o").alias("__lo"), F.max("__o").alias("__hi")).filter("__lo <> __hi").select("__h")
    ids = keyed.join(several, "__h", "left_semi").select("__id")
    return rows.join(ids, "__id", "left_semi").select("__id", "__t", F.md5("__t").alias("__m"))


#: Letters that are read as Latin ones, by script; within a word that has other letters of the script they are its own.
def _back() -> dict[str, dict[str, str]]:
    """By script: Latin letter -> its own; letters with accents as their decomposition says."""
    lists = list(LOOKALIKES.items())
    out = {}
    for script, part, cps in (("Cyrillic", lists[:2], range(0x0400, 0x0530)), ("Greek", lists[2:4], [*range(0x0370, 0x0400), *range(0x1F00, 0x2000)]), ("Armenian", lists[4:5], ())):
        to = {a: b for src, dst in part for a, b in zip(src, dst)}
        back = {b: a for a, b in reversed(to.items())}
        for cp in cps:
            d = unicodedata.normalize("NFD", chr(cp))
            if d[1:] and d[0] in to:
                latin = unicodedata.normalize("NFC", to[d[0]] + d[1:])
                if len(latin) == 1:
                    back.setdefault(latin, unicodedata.normalize("NFC", chr(cp)))
        out[script] = back
    return out


_BACK = _back()


def _one_script(col: Column) -> Column:
    """A skeleton with words that hold a letter of another script written in that script throughout.

    Such a letter is in every member of a class, so all get the same words.
    """
    words = F.regexp_extract_all(col, F.lit(r"(\p{L}[\p{L}\p{M}]*|[^\p{L}]+)"), 1)

    def written(w: Column) -> Column:
        out = w
        for script, back in _BACK.items():
            out = F.when(w.rlike(rf"\p{{Is{script}}}"), F.translate(w, "".join(back), "".join(back.values()))).otherwise(out)
        return out

    return F.when(col.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]"), F.array_join(F.transform(words, written), "")).otherwise(col)


def _composed(col: str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in s], dtype=object)

    return run(col)


def _unstable() -> str:
    """A class of what composition may change: combining marks, Hangul letters, characters that do not stay composed."""
    moved, runs = [cp for cp in _COMPOSED if unicodedata.normalize("NFC", chr(cp)) != chr(cp)], []
    for cp in moved:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return r"[\p{M}\x{1100}-\x{11FF}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


_UNSTABLE = _unstable()


def consistent(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the text's one form, by its characters alone.

    Look-alikes mapped, words of other scripts in their own letters, accents
    composed. Only texts with combining marks go through Python.
    """
    x = df.withColumn(out, _one_script(skeleton(text_col)))
    loose = F.coalesce(F.col(out).rlike(_UNSTABLE), F.lit(False))
    return x.filter(~loose).unionByName(x.filter(loose).withColumn(out, _composed(out)))


def classes(rows: DataFrame) -> DataFrame:
    """Classes of equal looks among candidates: look (collated), canonical, n_rows, varied.

    The canonical member is written in the consistent form, which all members
    of a class have in common; should two forms differ, the smallest counts.
    Members are never gathered: minima are kept while counting, so a class may
    hold any share of the rows. ``varied`` says that it has more than one spelling.
    """
    t = rows.groupBy("__t").agg(F.count(F.lit(1)).alias("__n"))
    t = t.select("__t", "__n", look_key("__t").alias("look"), _one_script(skeleton("__t")).alias("__c"))
    return t.groupBy("look").agg(F.min("__c").alias("canonical"), F.sum("__n").alias("n_rows"), (F.min("__t") != F.max("__t")).alias("varied"))


def _members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __m (digest of the text), canonical of the rows in classes of several spellings."""
    rows = materialize(candidates(df, id_col, text_col))
    varied = classes(rows).filter("varied").select("look", "canonical")
    return materialize(rows.withColumn("look", look_key("__t")).join(varied, "look").select("__id", "__m", "canonical"))


def canonical_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, canonical: every text in its class's one form.

    A text that no other text looks like has its own consistent form, the same
    that it would have among others. Null texts stay null; texts that draw
    nothing become ''.
    """
    found = _members(df, id_col, text_col).select(F.col("__id").alias(id_col), "canonical")
    rows = df.select(F.col(id_col), F.col(text_col).alias("__t")).join(found, id_col, "left")
    both = consistent(rows.select(id_col, F.coalesce("canonical", "__t").alias("__own")), "__own", "__c")
    return both.select(id_col, F.when(F.col("__own").isNotNull(), F.coalesce("__c", F.lit(""))).alias("canonical"))


def same_look_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of rows that look the same but are different strings: ``<id>_a`` < ``<id>_b``.

    Spellings of a class are paired first, then each pair of spellings is
    joined with its rows, so copies of one text never meet each other: the
    joins yield what the result lists and nothing that is thrown away.
    """
    members = _members(df, id_col, text_col).select("__id", "__m", F.md5("canonical").alias("cls"))
    spellings = members.select("cls", "__m").distinct()
    two = spellings.select("cls", F.col("__m").alias("ma")).join(spellings.select("cls", F.col("__m").alias("mb")), "cls").filter("ma < mb")
    rows = members.select("__id", "__m")
    pairs = two.select("ma", "mb").join(rows.select(F.col("__m").alias("ma"), F.col("__id").alias("x")), "ma").join(rows.select(F.col("__m").alias("mb"), F.col("__id").alias("y")), "mb")
    return pairs.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


# --- the same in SQL ----------------------------------------------------------------


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(t: str) -> str:
    """The consistent form of a text as DuckDB SQL; equal forms are equal looks. NUL, which SQL texts cannot hold, is left out."""
    kept = t
    for marks, letters in _MARKED.items():
        kept = f"regexp_replace({kept}, '([{letters}])', '\\1{marks}', 'g')"
    gone = _GONE.replace("\0", "")
    out = f"translate({kept}, {_literal(_FROM + gone)}, {_literal(_TO)})"
    out = f"regexp_replace({out}, '{_ASTRAL_INVISIBLE}', '', 'g')"
    for lig, to in _LIGATURES.items():
        out = f"replace({out}, {_literal(lig)}, {_literal(to)})"
    word = "w"
    for script, back in _BACK.items():
        word = f"CASE WHEN regexp_matches(w, '\\p{{{script}}}') THEN translate(w, {_literal(''.join(back))}, {_literal(''.join(back.values()))}) ELSE {word} END"
    words = f"regexp_extract_all(trim({out}, ' '), '(?s)\\p{{L}}[\\p{{L}}\\p{{M}}]*|[^\\p{{L}}]+')"
    return f"nfc_normalize(array_to_string(list_transform({words}, lambda w: {word}), ''))"
