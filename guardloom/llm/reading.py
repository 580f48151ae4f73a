"""Reading level of documents: gradient-boosted trees over text statistics.

Two views of a text are kept apart. The label, a grade by familiar words in the
manner of published vocabulary formulas, comes from a list of words that
children know and from the vocabulary of a public tokenizer. The features never
see these: they describe the distributions of lengths, word formation, syntax
and cohesion, and the mean grade of the other documents that a word occurs in,
summed up over the whole corpus. The trees are fitted to a bounded sample,
cross-validated by groups of sources and calibrated on the predictions for the
sources that were left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.llm import bpe
from guardloom.llm.common import spread
from guardloom.llm.pii import fold
from guardloom.session import materialize

#: Documents from which the trees are fitted, at most (picked by hash).
SAMPLE = 3_000
TREES, RATE, DEPTH, BINS = 100, 0.12, 4, 32
#: Grades up to EASY are for readers with a few years of school, from HARD on for specialists: familiar
#: words alone reach 9, so two more years come from words that no general vocabulary has.
EASY, HARD = 4.8, 11.0

#: Words that children know in their first years of school (inflections are undone by rule).
EARLY = frozenset(
    """a an the this that these those and or but so if then when while because of to in on at by with from for up down out off over under into about after before again
    i me my mine you your yours he him his she her hers it its we us our they them their who what where when why how which here there yes no not never always now once one two three
    four five six seven eight nine ten am is are was were be been being do does did done doing have has had having can could will would shall should may might must let
    go goes going went gone come came get got give gave given make made take took taken put see saw seen look like love want need know knew think thought say said tell told ask
    talk play run ran walk jump sit sat stand sleep eat ate drink read write wrote draw sing dance laugh cry smile help find found keep kept hold show open close stop start wait
    turn call hear heard listen feel felt hurt fall fell fly swim ride climb push pull throw catch wash clean cut cook bake buy sell sold bring brought carry forget forgot remember
    learn teach work live die grow hide hid hug kiss thank please sorry hello bye good bad big little small long short tall old new young fat thin hot cold warm wet dry fast slow
    happy sad mad angry kind mean nice funny silly pretty ugly soft hard loud quiet dark light bright full empty safe sick well fine great best better more most many much some any all
    both each other same only very too really just also red blue green yellow black white brown pink orange purple man men woman women boy girl kid child children baby people friend
    mom dad mother father brother sister son daughter grandmother grandfather grandma grandpa aunt uncle cousin family teacher doctor nurse baker cook policeman farmer king queen
    prince princess dog cat bird fish cow pig horse sheep duck hen chicken mouse rabbit bear lion tiger elephant monkey kangaroo butterfly frog bee ant snake dinosaur animal pet house
    home room door window bed chair table kitchen bathroom garden yard street road school class book page word story picture song game toy ball doll bike car bus train boat plane
    truck shoe hat coat shirt dress sock bag box cup plate bowl spoon fork knife pen pencil paper card key phone telephone computer clock money food water milk juice bread cake cookie
    egg apple banana pizza sandwich chocolate candy soup breakfast lunch dinner tree flower grass leaf sun moon star sky rain snow wind cloud hill river sea beach farm zoo park store
    town city playground birthday party present day night morning afternoon evening today tomorrow yesterday week month year monday tuesday wednesday thursday friday saturday sunday
    hand head hair eye ear nose mouth tooth teeth face arm leg foot feet name number color thing way place time side top bottom end front back first last next left right football
    basketball note rule bot robot rock bit lot fun mistake secret stranger everybody nobody everyone someone something nothing together sometimes maybe across around away behind
    wonderful beautiful delicious frightened scared dream wish""".split()
)
_SUBORDINATE = frozenset("although though whereas unless because since while whether which whose whom that if until insofar notwithstanding lest whereby wherein whereof".split())
_PRONOUN = frozenset("i you we he she me us him her my your our his they them it".split())
_PREPOSITION = frozenset("of in to for with on by from at into upon within under between among through during against without toward".split())
_BE = frozenset("is are was were be been being".split())
_CONNECTIVE = frozenset("so then and but because therefore hence thus however moreover conversely first next finally also".split())
_FUNCTION = frozenset("the a an and or of to in is are was it that this for with on by not be as at from has have had will can you we i he she they its their no if but which do does did who".split())
_FORMAL = re.compile(r"(?:tions?|it(?:y|ies)|ness(?:es)?|ments?|isms?|ances?|ences?|ologies|ology|ations?)$")

_SPEAKER = re.compile(r"\s*(?:(?:User|Assistant|System)\s*:\s*|(?:[-*•>]|\d+[.)])\s+|#+\s+)")
_SENTENCE = re.compile(r"[.!?…][\"')\]]*\s+|\n+")
#: Words with one of these are identifiers, figures or markup.
_ODD = re.compile(r"[\d_@/\\<>{}\[\]|=]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SYLLABLE = re.compile(r"[aeiouy]+")

NAMES = """words_mean words_sd words_p90 letters_mean letters_sd letters_p90 syllables long_words variety commas breaks subordinate prepositions pronouns be formal
connectives overlap n_words grade_mean grade_p90 grade_p10""".split()
#: Groups of sources for cross-validation; a source is wholly in one.
FOLDS = 8
#: Words are kept with their grades if they occur in one of so many documents.
WORD_SHARE = 10_000
#: Documents of the mean grade that are added to those of every word.
DRAWN = 10


def _early(w: str) -> bool:
    if w in EARLY:
        return True
    for end, put in (("s", ""), ("es", ""), ("ed", ""), ("ed", "e"), ("d", ""), ("ing", ""), ("ing", "e"), ("ies", "y"), ("er", ""), ("est", ""), ("ly", ""), ("'s", ""), ("n't", "")):
        if w.endswith(end) and w[: -len(end)] + put in EARLY:
            return True
    return len(w) > 5 and (w[-3:] == "ing" or w[-2:] == "ed") and w[-4:-3] == w[-5:-4] and w[:-4] in EARLY


class Words(dict):
    """Word -> row of what is known of it, worked out once per worker.

    ``facts``: letters, syllables, three syllables or more, subordinating,
    preposition, pronoun, form of be, formal, connective, function word.
    ``grades``: the word's mean grades (see Grades), by the fold left out.
    """

    def __init__(self, grades: "Grades | None" = None):
        super().__init__()
        self.graded = grades
        self.rows: list[tuple] = []
        self.grade_rows: list = []

    def __missing__(self, w: str) -> int:
        syllables = max(1, len(_SYLLABLE.findall(w[:-1] if w.endswith("e") and not w.endswith("le") else w)))
        self.rows.append((len(w), syllables, syllables >= 3, w in _SUBORDINATE, w in _PREPOSITION, w in _PRONOUN, w in _BE, len(w) > 6 and bool(_FORMAL.search(w)), w in _CONNECTIVE, w in _FUNCTION))
        if self.graded is not None:
            self.grade_rows.append(self.graded.of(w))
        got = self[w] = len(self.rows) - 1
        return got

    def tables(self) -> tuple[np.ndarray, np.ndarray | None]:
        return np.array(self.rows, dtype=np.float64).reshape(len(self.rows), 10), np.array(self.grade_rows) if self.graded is not None else None

    def renewed(self) -> "Words":
        """Itself, or an empty one if it has grown large."""
        return self if len(self) < 300_000 else Words(self.graded)


def prose(text: str | None) -> list[list[str]]:
    """Sentences as lower-case words; identifiers, speakers and names inside sentences are left out."""
    if not text:
        return []
    out, odd, find = [], _ODD.search, _WORD.findall
    for s in _SENTENCE.split(fold(text)[0]):
        if m := _SPEAKER.match(s):
            s = s[m.end() :]
        if odd(s):
            s = " ".join([x for x in s.split() if not odd(x)])
        words = find(s)
        if not words:
            continue
        if s[s.index(words[0]) + 1 :].islower():
            words[0] = words[0].lower()
            out.append(words)
            continue
        loud = len(words) > 3 and s.isupper()
        own = [w.lower() for i, w in enumerate(words) if i == 0 or not w[0].isupper() or loud]
        if own:
            out.append(own)
    return out


def is_json(col: Column | str) -> Column:
    """Whether a text is a JSON object or array, or nearly one."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    looks = F.substring(bare, 1, 1).isin("{", "[") & F.right(bare, F.lit(1)).isin("}", "]")
    return F.when(looks, F.try_parse_json(bare).isNotNull() | (F.size(F.split(bare, '":')) > 2)).otherwise(False)


def is_english(sents: list[list[str]], label: str | None) -> bool:
    """By the label if there is one, else by the share of function words; rare vocabulary does not matter."""
    if label or not sents:
        return label == "en" and bool(sents)
    words = [w for s in sents for w in s]
    return len(words) > 2 and sum(w in _FUNCTION for w in words) >= 0.1 * len(words)


class Familiar(dict):
    """Word -> (known to children, in no general vocabulary whole), by a list and a public tokenizer."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, w: str) -> tuple[bool, bool]:
        if len(self) > 300_000:
            self.clear()
        early = _early(w)
        got = self[w] = (early, not early and len(w) > 2 and self.find(f" {w}".encode()) < 0)
        return got


def vocabulary_grade(sents: list[list[str]], familiar: Familiar) -> float:
    """The label: a grade in school years from the shares of unfamiliar words.

    Words that children do not know raise it to that of general readers at
    most; only words too rare for a general vocabulary raise it further.
    """
    flat = [familiar[w] for s in sents for w in s]
    early, rare = (sum(x[i] for x in flat) / len(flat) for i in (0, 1))
    return min(18.0, 1.5 + min(7.5, 21.0 * max(0.0, 0.94 - early)) + min(10.0, 110.0 * max(0.0, rare - 0.03)))


@dataclass
class Grades:
    """Mean grades of words: of all documents they occur in, and of those outside each fold.

    ``sums``: word -> (sums, counts) as arrays by fold. Means are drawn towards that of all documents.
    """

    sums: dict
    total: np.ndarray  # sum of grades by fold
    count: np.ndarray  # documents by fold

    def middle(self) -> np.ndarray:
        """By the fold left out; the last one leaves out none."""
        s, n = (np.append(x.sum() - x, x.sum()) for x in (self.total, self.count))
        return np.where(n > 0, s / np.maximum(n, 1), 8.0)

    def of(self, w: str) -> np.ndarray:
        m, got = self.middles, self.sums.get(w)
        if got is None:
            return m
        s, n = (np.append(x.sum() - x, x.sum()) for x in got)
        return (s + DRAWN * m) / (n + DRAWN)

    def __post_init__(self):
        self.middles = self.middle()


def _ranked(values: np.ndarray, group: np.ndarray, begins: np.ndarray, sizes: np.ndarray, *tenths: int) -> list[np.ndarray]:
    """The given deciles of each group's values."""
    ordered = values[np.lexsort((values, group))]
    return [ordered[begins + (sizes - 1) * k // 10] for k in tenths]


def features(texts: list[str], docs: list[list[list[str]]], words: Words) -> np.ndarray:
    """A row of NAMES per document, for a whole batch at once; 0 where there is no word, and for grades without any."""
    out = np.zeros((len(docs), len(NAMES)))
    at = np.array([i for i, d in enumerate(docs) if d], dtype=np.int64)
    if not len(at):
        return out
    coded = [[[words[w] for w in s] for s in docs[i]] for i in at]
    flat = [w for d in coded for s in d for w in s]
    lens = np.array([len(s) for i in at for s in docs[i]])
    n_sents = np.array([len(docs[i]) for i in at])
    facts, grades = words.tables()
    ids = np.array(flat)
    f = facts[ids]
    sent_doc = np.repeat(np.arange(len(at)), n_sents)
    doc = np.repeat(sent_doc, lens)
    sent_begin, n = np.r_[0, np.cumsum(n_sents)[:-1]], np.bincount(doc, minlength=len(at))
    begin = np.r_[0, np.cumsum(n)[:-1]]

    def spread(values, begins, group, sizes):
        mean = np.add.reduceat(values, begins) / sizes
        sd = np.sqrt(np.maximum(0.0, np.add.reduceat(values * values, begins) / sizes - mean * mean))
        return mean, sd, *_ranked(values, group, begins, sizes, 9)

    def share(k):
        return np.add.reduceat(f[:, k], begin) / n

    distinct = np.array([len({w for s in d for w in s}) for d in coded])
    # cohesion: content words shared by neighbouring sentences
    common = set(np.flatnonzero(facts[:, 9]).tolist())
    laps = np.zeros(len(at))
    for i, d in enumerate(coded):
        if len(d) > 1:
            own = [set(s) - common for s in d]
            laps[i] = sum(len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(own, own[1:])) / (len(d) - 1)
    content = f[:, 9] == 0
    cols = [
        *spread(lens.astype(float), sent_begin, sent_doc, n_sents), *spread(f[:, 0], begin, doc, n), share(1), share(2), np.log(distinct + 1) / np.log(n + 1),
        np.array([texts[i].count(",") for i in at]) / n_sents, np.array([texts[i].count(";") + texts[i].count(":") + texts[i].count("(") + texts[i].count(")") for i in at]) / n_sents,
        share(3), share(4), share(5), share(6), share(7), share(8), laps, np.log(n),
    ]
    out[np.ix_(at, range(len(cols)))] = np.stack(cols, 1)
    if grades is not None:
        out[at, -3:] = _grade_features(grades[ids[content], FOLDS], doc[content], len(at), words.graded.middles[FOLDS])
    return out


def _grade_features(g: np.ndarray, doc: np.ndarray, n: int, middle: float) -> np.ndarray:
    """Mean, ninth and first decile of the content words' grades of n documents; the middle without any."""
    out = np.full((n, 3), middle)
    k = np.bincount(doc, minlength=n)
    some = np.flatnonzero(k)
    if len(some):
        begin, size = np.r_[0, np.cumsum(k[some])[:-1]], k[some]
        out[some, 1], out[some, 2] = _ranked(g, doc, begin, size, 9, 1)
        out[some, 0] = np.add.reduceat(g, begin) / size
    return out


def grade_features(docs: list[list[list[str]]], words: Words, fold: int) -> np.ndarray:
    """The grade features under the grades without a fold (FOLDS leaves out none)."""
    flat = [(i, words[w]) for i, d in enumerate(docs) for s in d for w in s if w not in _FUNCTION]
    grades = words.tables()[1]
    doc, ids = np.array(flat, dtype=np.int64).reshape(len(flat), 2).T
    return _grade_features(grades[ids, fold] if len(flat) else np.empty(0), doc, len(docs), words.graded.middles[fold])


# --- boosted trees ------------------------------------------------------------------


@dataclass
class Trees:
    """Regression trees as arrays; ``feature`` is -1 at leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All trees at once, a level at a time."""
        out, trees = np.empty(len(x)), np.arange(len(self.value))
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                f = self.feature[trees, node]
                right = part[rows, np.maximum(f, 0)] > self.cut[trees, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            out[at : at + 1024] = self.base + self.value[trees, node].sum(1)
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Least-squares boosting with binned features; deterministic.

    The sums of all features' bins of a node come from one weighted count.
    """
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)
    place = binned + np.arange(k) * BINS
    last = np.arange(BINS - 1) < np.array([len(c) for c in cuts])[:, None]  # cuts that there are
    base = float(y.mean())
    now, nodes = np.full(n, base), 2 ** (DEPTH + 1) - 1
    fs, cs, vs = [], [], []
    for _ in range(trees):
        r = y - now
        f, c, v = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        where = np.zeros(n, int)
        for node in range(nodes):
            own = np.flatnonzero(where == node)
            if not len(own):
                continue
            total = r[own].sum()
            v[node] = rate * total / (len(own) + 1.0)
            if node >= 2**DEPTH - 1 or len(own) < 20:
                continue
            at = place[own].ravel()
            cnt = np.cumsum(np.bincount(at, minlength=k * BINS).reshape(k, BINS), 1)[:, :-1]
            s = np.cumsum(np.bincount(at, np.repeat(r[own], k), k * BINS).reshape(k, BINS), 1)[:, :-1]
            ok = last & (cnt >= 5) & (len(own) - cnt >= 5)
            gain = np.where(ok, s**2 / np.maximum(cnt, 1) + (total - s) ** 2 / np.maximum(len(own) - cnt, 1) - total**2 / len(own), -1)
            j, i = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, i] > 1e-9:
                f[node], c[node] = j, cuts[j][i]
                where[own] = 2 * node + 1 + (binned[own, j] > i)
        now += Trees(0.0, f[None], c[None], v[None]).predict(x)
        fs.append(f)
        cs.append(c)
        vs.append(v)
    return Trees(base, np.array(fs), np.array(cs), np.array(vs))


def isotonic(x: np.ndarray, y: np.ndarray, knots: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """A rising step-wise mean of y over x (pool adjacent violators), at a few knots."""
    order = np.argsort(x, kind="stable")
    parts = [[float(x[p].mean()), float(y[p].mean()), len(p)] for p in np.array_split(order, min(knots, len(order))) if len(p)]
    out: list[list[float]] = []
    for p in parts:
        out.append(p)
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            b, a = out.pop(), out.pop()
            w = a[2] + b[2]
            out.append([(a[0] * a[2] + b[0] * b[2]) / w, (a[1] * a[2] + b[1] * b[2]) / w, w])
    return np.array([p[0] for p in out]), np.array([p[1] for p in out])


@dataclass
class Model:
    """Its size is bounded by WORD_SHARE and the number of trees."""

    trees: Trees
    grades: Grades
    at: np.ndarray
    to: np.ndarray
    validation: list  # (source, n, rmse, mean grade)

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), self.at, self.to)


def _candidates(df: DataFrame, keep: list[Column], text_col: str, lang_col: str) -> DataFrame:
    """Documents that may be English prose, before Python sees them: no JSON, no other label, not blank."""
    t, lang = F.col(text_col), F.col(lang_col)
    return df.filter((lang.isNull() | (lang == "en")) & t.rlike(r"\S") & ~is_json(t)).select(*keep, t.alias("__text"), lang.alias("__lang"))


def _fold(source: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(FOLDS)).cast("int")


def word_grades(docs: DataFrame, find) -> Grades:
    """Sums of the labels of the documents that each word occurs in, over all documents.

    ``docs`` has __text, __lang and __fold. Sums are added up in the tasks
    before they are shuffled; a word is kept if one of WORD_SHARE documents has
    it, so what reaches the driver does not grow with the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        familiar, sums = Familiar(find()), {}

        def out():
            return pd.DataFrame([(w, k, s, n) for (w, k), (s, n) in sums.items()], columns=["w", "fold", "s", "n"])

        for b in batches:
            for text, lang, k in zip(b["__text"], b["__lang"], b["__fold"]):
                sents = prose(text)
                if not is_english(sents, lang if isinstance(lang, str) else None):
                    continue
                g = vocabulary_grade(sents, familiar)
                for w in {"", *(x for s in sents for x in s)}:  # the empty word counts the documents
                    got = sums.get((w, k))
                    if got is None:
                        sums[w, k] = [g, 1]
                    else:
                        got[0] += g
                        got[1] += 1
            if len(sums) > 300_000:
                yield out()
                sums.clear()
        yield out()

    found = materialize(docs.mapInPandas(run, "w string, fold int, s double, n bigint").groupBy("w", "fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    total, count = np.zeros(FOLDS), np.zeros(FOLDS)
    for r in found.filter("w = ''").collect():
        total[r.fold], count[r.fold] = r.s, r.n
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(x))).alias(f"{x}{k}") for x in ("s", "n") for k in range(FOLDS)]
    kept = found.filter("w <> ''").groupBy("w").agg(F.sum("n").alias("all"), *by_fold).filter(F.col("all") * WORD_SHARE >= float(count.sum()))
    sums = {r.w: (np.array([r[f"s{k}"] or 0.0 for k in range(FOLDS)]), np.array([r[f"n{k}"] or 0 for k in range(FOLDS)], float)) for r in kept.collect()}
    return Grades(sums, total, count)


def picked(docs: DataFrame, hash_col: str, total: int, n: int) -> DataFrame:
    """About ``n`` of ``total`` rows by their hash, however many there are; all if there are fewer."""
    if total <= n:
        return docs
    span = 1 << 62
    return docs.filter(F.pmod(F.col(hash_col), F.lit(span)) < F.lit(max(1, span * n // total)))


def fit(df: DataFrame, text_col: str, source_col: str, lang_col: str, path: str | None = None, n: int = SAMPLE) -> Model:
    """Word grades from all documents; trees from about ``n`` of them, of which only the features move.

    Each source is predicted once by trees, and with word grades, that never
    saw its fold. Without two folds in the sample there is no calibration; a
    corpus without English prose gives the middle grade for everything.
    """
    table = bpe.shipped(df.sparkSession, path)
    find = lambda: table.value.get
    docs = _candidates(df, [_fold(F.col(source_col)).alias("__fold"), F.coalesce(source_col, F.lit("")).alias("__source")], text_col, lang_col)
    grades = word_grades(spread(docs.drop("__source")), find)
    total = int(grades.count.sum())
    same = np.array([0.0, 20.0])
    if not total:
        return Model(Trees(8.0, np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1))), grades, same, same, [])
    shared = df.sparkSession.sparkContext.broadcast(grades)

    @F.pandas_udf("struct<x array<double>, own array<double>, y double>")
    def described(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words, familiar = Words(shared.value), Familiar(find())
        for texts, langs, folds in batches:
            sents = [prose(t) for t in texts]
            english = [is_english(s, lang if isinstance(lang, str) else None) for s, lang in zip(sents, langs)]
            every = np.stack([grade_features(sents, words, k) for k in range(FOLDS + 1)], 1).reshape(len(texts), -1)
            x = features(list(texts), sents, words)
            y = [vocabulary_grade(s, familiar) if e else np.nan for s, e in zip(sents, english)]
            yield pd.DataFrame({"x": list(x), "own": list(every), "y": y})

    some = picked(docs.withColumn("__h", F.xxhash64("__text")), "__h", total, n)
    rows = some.select("__source", "__fold", "__h", described("__text", "__lang", "__fold").alias("d")).select("__source", "__fold", "__h", "d.*").filter("y is not null and not isnan(y)")
    # as many rows as are wanted, not more, should a text that repeats be among those picked
    rows = sorted(rows.orderBy("__h").limit(2 * n).collect(), key=lambda r: (r["__h"], r["__source"], r.y, r.x))
    if not rows:
        raise ValueError("no document was picked for the sample")
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    own = np.array([r.own for r in rows]).reshape(len(rows), FOLDS + 1, 3)
    of, fold = np.array([r["__source"] for r in rows]), np.array([r["__fold"] for r in rows])
    guess, report = np.full(len(rows), np.nan), []
    for k in sorted(set(fold.tolist())):
        test = fold == k
        if test.all():
            continue
        x[:, -3:] = own[:, k]
        guess[test] = grow(x[~test], y[~test]).predict(x[test])
        for src in sorted(set(of[test].tolist())):
            mine = test & (of == src)
            report.append((src, int(mine.sum()), float(np.sqrt(np.mean((guess[mine] - y[mine]) ** 2))), float(y[mine].mean())))
    x[:, -3:] = own[:, FOLDS]
    trees = grow(x, y)
    at, to = isotonic(guess, y) if not np.isnan(guess).any() else (same, same)
    return Model(trees, grades, at, to, report)


def graded(df: DataFrame, keep: list[str], text_col: str, lang_col: str, model: Model) -> DataFrame:
    """The kept columns, grade, level and english_prose of the documents that are no JSON and of no other language.

    level is 'easy', 'middle' or 'hard'. Unlabelled documents whose function
    words are not English are graded but not english_prose. ``all_graded`` adds
    the rest.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<grade double, english boolean>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        words = Words(m.grades)
        for texts, langs in batches:
            words = words.renewed()
            sents = [prose(t) for t in texts]
            english = [is_english(s, lang if isinstance(lang, str) else None) for s, lang in zip(sents, langs)]
            yield pd.DataFrame({"grade": np.round(m.grade(features(list(texts), sents, words)), 4), "english": english})

    rows = spread(_candidates(df, [F.col(k) for k in keep], text_col, lang_col))
    x = rows.select(*keep, run("__text", "__lang").alias("__g"))
    grade = F.col("__g.grade")
    level = F.when(grade <= EASY, "easy").when(grade >= HARD, "hard").when(grade.isNotNull(), "middle")
    return x.select(*keep, grade.alias("grade"), level.alias("level"), F.col("__g.english").alias("english_prose"))


def all_graded(df: DataFrame, keep: list[str], text_col: str, lang_col: str, model: Model) -> DataFrame:
    """``graded``, with every other document as well: null grade and level, no english_prose."""
    t, lang = F.col(text_col), F.col(lang_col)
    other = ~F.coalesce((lang.isNull() | (lang == "en")) & t.rlike(r"\S") & ~is_json(t), F.lit(False))
    rest = df.filter(other).select(*keep, F.lit(None).cast("double").alias("grade"), F.lit(None).cast("string").alias("level"), F.lit(False).alias("english_prose"))
    return graded(df, keep, text_col, lang_col, model).unionByName(rest)
