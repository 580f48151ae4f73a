"""Languages of documents and of their segments, by nearest centroid.

Sentences become normalised TF-IDF vectors of hashed character n-grams; each
language has several centroids, found by spherical k-means over a bounded
sample of labelled texts. The cosine to the nearest centroid gives the
language, and sentences too far from all of them are rejected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardloom.llm.common import spread
from guardloom.llm.lookalike import INVISIBLE, LOOKALIKES

DIMS = 1 << 16
SIZES = (2, 3)
#: Labelled texts per language from which the centroids are fitted, at most.
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 2
#: A sentence's language is only trusted apart from its text's by such a lead in cosine.
LEAD = 0.04
#: ... and with such a confidence.
SURE = 0.7
#: Share of the training sentences of a centroid that lie within its radius.
KEEP = 0.98
#: ... and by what share of that radius (a least cosine) a sentence may fall short of it.
SLACK = 0.5
#: A sentence with a code character for so many words, and two or more in all, is code.
CODE = 5
#: Softness of the confidence.
HEAT = 25.0

# Names of languages as labels write them.
_NAMES = """
en eng english | de deu ger german | fr fra fre french | es spa spanish | it ita italian | pt por portuguese
nl nld dut dutch | pl pol polish | ru rus russian | ja jpn japanese | ar ara arabic | zh zho chi chinese
sv swe swedish | da dan danish | no nor norwegian | fi fin finnish | cs ces cze czech | tr tur turkish
ko kor korean | hi hin hindi | uk ukr ukrainian | ro ron rum romanian | el ell gre greek | hu hun hungarian
"""
NAMES = {name: names[0] for names in (x.split() for x in re.split(r"[|\n]", _NAMES) if x.strip()) for name in names}


def label_of(params: Column | str) -> Column:
    """The two-letter code that a request's params name, or null.

    Looks under language, lang, locale and hints.language, in this order; codes
    with a region, three-letter codes and English names count.
    """
    c = F.col(params) if isinstance(params, str) else params
    known = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    found = []
    for path in ("$.language", "$.lang", "$.locale", "$.hints.language"):
        raw = F.lower(F.trim(F.get_json_object(c, path)))
        found.append(known.getItem(F.regexp_extract(raw, r"^(\p{L}+)", 1)))
    return F.coalesce(*found)


_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿͏]")
_TO_LATIN = {ord(a): b for src, dst in LOOKALIKES.items() for a, b in zip(src, dst)}
_CYRILLIC = list(LOOKALIKES.items())[:2]
_TO_CYRILLIC = {ord(b): a for src, dst in _CYRILLIC for a, b in reversed(list(zip(src, dst))) if b not in "qwhdsljivQWSIJF"}
_LATIN = re.compile("[a-zA-Z]")
_NOT_LATIN = re.compile("[Ͱ-֏]")
_OTHER = re.compile("[а-яА-ЯёЁ]")


def plain(text: str) -> str:
    """Composed characters of one script per sentence, without invisible ones."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))


def one_script(sentence: str) -> str:
    """Letters of the rarer script replaced where the other one draws them alike."""
    if sentence.isascii() or not _NOT_LATIN.search(sentence):
        return sentence
    latin, other = len(_LATIN.findall(sentence)), len(_NOT_LATIN.findall(sentence))
    if other and latin >= other:
        return sentence.translate(_TO_LATIN)
    return sentence.translate(_TO_CYRILLIC) if latin else sentence


_BREAK = re.compile(r"(?<=[.!?…])[\"'»)\]]*\s+|\n+|(?<=[。！？])")
_MARKS = re.compile(r"[@{<\[]|://")
_NOISE = re.compile(r"\{[^{}]*\}|<[^<>]*>|\S+@\S+|https?://\S+|\[[^\[\]]*\]")
_CODE = re.compile(r"[{}\[\]<>=;|\\/_$#*~^]")
_MASK = re.compile(r"(?<=\w)\*+|\*+(?=\w)")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ一-鿿가-힯]")


def sentences(text: str) -> list[str]:
    """The sentences of a text as lower-case words; code, figures and fragments are left out."""
    out = []
    for s in _BREAK.split(plain(text)):
        if not s or len(s) < 4:
            continue
        if _MARKS.search(s):
            s = _NOISE.sub(" ", s)
        signs = len(_CODE.findall(s))
        if signs >= 2 and (signs := len(_CODE.findall(_MASK.sub("", s)))) >= 2 and signs * CODE >= len(s.split()):
            continue
        words = _WORD.findall(one_script(s))
        letters = sum(map(len, words))
        if letters < 4 or (len(words) < 3 or letters < 10) and not _CJK.search(s):
            continue
        out.append(f" {' '.join(words)} ".lower())
    return out


def features(sents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature, count) of hashed n-grams, each pair once."""
    if not sents:
        e = np.empty(0, np.int64)
        return e, e, e
    codes = np.frombuffer("".join(sents).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sid = np.repeat(np.arange(len(sents), dtype=np.uint64), [len(s) for s in sents])
    keys = []
    for n in SIZES:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        own = sid[: len(codes) - n + 1]
        same = own == sid[n - 1 :]
        keys.append((own << np.uint64(16) | (h & np.uint64(DIMS - 1)))[same])
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(DIMS - 1)).astype(np.int64), n


@dataclass
class Centroids:
    """The model: its size is fixed by DIMS, the languages and CENTROIDS."""

    languages: list[str]
    owner: np.ndarray  # centroid -> language
    matrix: np.ndarray  # DIMS x centroids, idf included
    idf: np.ndarray
    radius: np.ndarray  # least cosine by centroid

    def cosines(self, sents: list[str]) -> np.ndarray:
        """sentences x centroids."""
        out = np.zeros((len(sents), len(self.owner)), np.float32)
        step = 128  # what is gathered stays in the cache
        for at in range(0, len(sents), step):
            part = sents[at : at + step]
            row, feat, n = features(part)
            if not len(row):
                continue
            tf = (1 + np.log(n)).astype(np.float32)
            w = tf * self.idf[feat]
            norm = np.sqrt(np.bincount(row, w * w, len(part))) + 1e-9
            begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            gathered = self.matrix.take(feat, 0)
            gathered *= w[:, None]
            out[at + row[begins]] = np.add.reduceat(gathered, begins, axis=0) / norm[row[begins], None]
        return out

    def by_language(self, sents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best cosine per language, and whether the nearest centroid accepts the sentence."""
        c = self.cosines(sents)
        best = np.full((len(sents), len(self.languages)), -1.0, np.float32)
        for k, lang in enumerate(self.owner):
            np.maximum(best[:, lang], c[:, k], out=best[:, lang])
        near = c.argmax(1) if len(sents) else np.empty(0, int)
        return best, c[np.arange(len(sents)), near] >= self.radius[near] if len(sents) else np.empty(0, bool)


def _unaccented(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def fit(texts: list[tuple[str, str]], clusters: int = CENTROIDS) -> Centroids:
    """Centroids from (language, text) pairs; deterministic in their order.

    Each Latin sentence counts a second time without its accents, as people
    type it. Sentences nearer to another language than to their label's (wrong
    labels, quotations) are dropped after a first round.
    """
    sents, langs = [], []
    languages = sorted({lang for lang, _ in texts})
    for lang, text in texts:
        for s in dict.fromkeys(sentences(text)):
            sents.append(s)
            langs.append(languages.index(lang))
            if lang not in ("ru", "ja", "ar", "zh", "ko", "el", "uk") and (bare := _unaccented(s)) != s:
                sents.append(bare)
                langs.append(languages.index(lang))
    if not sents:  # nothing is near to no centroid
        none = np.empty(0, np.int64)
        return Centroids([], none, np.zeros((DIMS, 0), np.float32), np.ones(DIMS, np.float32), np.empty(0, np.float32))
    y = np.array(langs)
    row, feat, n = features(sents)
    tf = (1 + np.log(n)).astype(np.float32)
    df = np.bincount(feat, minlength=DIMS)
    idf = np.log((1 + len(sents)) / (1 + df)).astype(np.float32) + 1
    w = tf * idf[feat]
    norm = np.sqrt(np.bincount(row, w * w, len(sents))).astype(np.float32) + 1e-9
    w = w / norm[row]
    begins = np.searchsorted(row, np.arange(len(sents)))
    keep = np.ones(len(sents), bool)
    for final in (False, True):
        owner, columns = [], []
        for k in range(len(languages)):
            own = np.flatnonzero((y == k) & keep)
            if not len(own):
                continue
            group = np.zeros(len(sents), np.int64) - 1
            group[own] = np.arange(len(own)) * clusters // max(1, len(own)) if final else 0
            k_now = clusters if final and len(own) >= 2 * clusters else 1
            group[own] = np.minimum(group[own], k_now - 1)
            mine = np.isin(row, own)
            r, f, v = row[mine], feat[mine], w[mine]
            for _ in range(6 if k_now > 1 else 1):
                m = np.zeros((DIMS, k_now), np.float32)
                np.add.at(m, (f, group[r]), v)
                m /= np.linalg.norm(m, axis=0) + 1e-9
                if k_now > 1:
                    score = np.zeros((len(sents), k_now), np.float32)
                    np.add.at(score, r, m[f] * v[:, None])
                    group[own] = score[own].argmax(1)
            columns.append(m)
            owner += [k] * k_now
        matrix = np.concatenate(columns, axis=1)
        model = Centroids(languages, np.array(owner), matrix, idf, np.zeros(len(owner), np.float32))
        cos = model.cosines(sents)
        near = cos.argmax(1)
        right = model.owner[near] == y
        if not final:
            keep = right
    for c in range(len(owner)):
        own = cos[(near == c) & right, c]
        model.radius[c] = (1 - SLACK) * np.quantile(own, 1 - KEEP) if len(own) else 1.0
    return model


def labelled_sample(df: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each label, picked by hash; what reaches the driver is bounded."""
    known = df.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h")).filter("l is not null and t is not null")
    top = known.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("r") <= per_language)
    return [(r.l, r.t) for r in sorted(top.select("l", "t", "h").collect(), key=lambda r: (r.l, r.h))]


def decide(model: Centroids, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
    """(language, confidence, letters) of every sentence of each text.

    A sentence keeps its own language if it leads over that of the whole text;
    doubtful ones follow the text.
    """
    sents, where = [], []
    for i, t in enumerate(texts):
        if t:
            own = sentences(t)
            sents += own
            where += [i] * len(own)
    out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    if not sents or not len(model.owner):
        return out
    best, accepted = model.by_language(sents)
    size = np.array([len(s) for s in sents])
    where = np.array(where)
    total = np.zeros((len(texts), best.shape[1]), np.float64)
    np.add.at(total, where, best * size[:, None] * accepted[:, None])
    main = total.argmax(1)
    own = best.argmax(1)
    at = np.arange(len(sents))
    lead = best[at, own] - best[at, main[where]]
    e = np.exp(HEAT * (best - best.max(1, keepdims=True)))
    e /= e.sum(1, keepdims=True)
    pick = np.where((lead > LEAD) & (e[at, own] > SURE), own, main[where])
    conf = e[at, pick]
    for j in range(len(sents)):
        if accepted[j]:
            out[where[j]].append((model.languages[pick[j]], float(conf[j]), int(size[j])))
    return out


def segments(df: DataFrame, model: Centroids, id_col: str, text_col: str) -> DataFrame:
    """One row per run of sentences of one language: id, segment_no, lang, confidence, n_sentences.

    Null, empty and blank texts, code, figures and sentences far from every
    centroid give no row. Confidence is the mean over the run's letters.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, nos, langs, confs, counts = [], [], [], [], []
            for i, found in zip(b.iloc[:, 0], decide(shared.value, list(b.iloc[:, 1]))):
                no = 0
                j = 0
                while j < len(found):
                    k = j
                    while k < len(found) and found[k][0] == found[j][0]:
                        k += 1
                    part = found[j:k]
                    ids.append(i)
                    nos.append(no)
                    langs.append(found[j][0])
                    confs.append(sum(c * n for _, c, n in part) / sum(n for _, _, n in part))
                    counts.append(k - j)
                    no, j = no + 1, k
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=b.iloc[:, 0].dtype), "segment_no": pd.Series(nos, dtype="int32"), "lang": pd.Series(langs, dtype=object), "confidence": pd.Series(confs, dtype="float64"), "n_sentences": pd.Series(counts, dtype="int32")})

    rows = spread(df.select(F.col(id_col), F.col(text_col).alias("__text")).filter("__text is not null"))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, segment_no int, lang string, confidence double, n_sentences int")


def document_language(segs: DataFrame, id_col: str) -> DataFrame:
    """id, lang, confidence, n_languages: the language of most sentences; ties to the first code."""
    per = segs.groupBy(id_col, "lang").agg(F.sum("n_sentences").alias("s"), (F.sum(F.col("confidence") * F.col("n_sentences")) / F.sum("n_sentences")).alias("c"))
    total = F.sum("s")
    top = F.max_by(F.struct("lang", "c", "s"), F.struct("s", "c"))
    return per.groupBy(id_col).agg(top.alias("t"), total.alias("all"), F.count(F.lit(1)).cast("int").alias("n_languages")).select(
        id_col, F.col("t.lang").alias("lang"), (F.col("t.c") * F.col("t.s") / F.col("all")).alias("confidence"), "n_languages"
    )
