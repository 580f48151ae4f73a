"""Abusive, hateful and sexual passages: maximum-scoring segments of token log-odds.

Tokens and seed pairs of tokens get log-odds between abusive and other
sentences, shrunk by a Dirichlet prior that follows their frequency in the
corpus. One linear scan per text finds every segment whose sum cannot be made
larger; the extreme-value law of such sums under the corpus's own token scores
turns them into probabilities. Seeds train it, against counts over all texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.llm.abuse_seeds import abusive, harmless
from guardloom.llm.common import spread
from guardloom.llm.pii import fold
from guardloom.session import materialize

#: Counts over all texts are scaled to what so many texts hold, if there are more: the prior's
#: weight and the least counts are meant for that size, so the model does not drift with the corpus.
SAMPLE = 10_000
#: Tokens that count less than this over SAMPLE texts score as unknown.
LEAST = 5
#: Distinct tokens that a task keeps before it passes them on.
HELD = 200_000
#: Weight of the prior, in tokens.
PRIOR = 60.0
#: Log-odds are cut at plus and minus this.
CUT = 3.5
#: Score of tokens that the model does not know.
UNKNOWN = -0.35
#: A text is a case if its best segment has a smaller probability under the corpus.
ALPHA = 5e-5

# --- tokens -------------------------------------------------------------------------

_DOTTED = re.compile(r"(?<![\w.])(?:[^\W\d_](?:[.\-_]{1,3})){2,}[^\W\d_](?![^\W_])")
_SPACED = re.compile(r"(?<!\w)[^\W_](?P<gap> {1,4})(?:[^\W_](?P=gap))+[^\W_](?!\w)")
_TOKEN = re.compile(r"[^\W_][\w*@$]*(?:['’][^\W\d_]+)?|\*[\w*]+")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LONG = re.compile(r"(.)\1{2,}")
_LEET = str.maketrans("013457@$", "oieastas")


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _joined(m: re.Match) -> str:
    return "".join(c for c in m[0] if c.isalnum())


class Speller(dict):
    """Token -> its usual spelling: leet digits, stars, stretched letters undone by a vocabulary.

    A dictionary that fills itself and starts anew when it has grown large.
    """

    def __init__(self, vocabulary: frozenset):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, tok: str) -> str:
        if len(self) > 200_000:
            self.clear()
        got = self[tok] = self._word(tok)
        return got

    def _word(self, tok: str) -> str:
        v = self.vocabulary
        if tok.isdigit():
            t = tok.translate(_LEET)
            return t if len(tok) > 3 and t in v else "0"
        if tok in v:
            return tok
        if "*" in tok and len(tok) > 2 and tok.count("*") < len(tok) - 1:
            p = re.compile("".join("." if c == "*" else re.escape(c.translate(_LEET)) for c in tok))
            fits = sorted(w for w in v if len(w) == len(tok) and p.fullmatch(w))
            return fits[0] if fits else tok
        if any(c.isdigit() or c in "@$" for c in tok):
            for t in (tok.translate(_LEET), tok.replace("1", "l").translate(_LEET)):
                if t in v:
                    return t
            if sum(c.isdigit() for c in tok) * 2 > len(tok) and len(tok) > 3:
                return "0"
            tok = tok.translate(_LEET)
        if _LONG.search(tok):
            one, two = _LONG.sub(r"\1", tok), _LONG.sub(r"\1\1", tok)
            return two if two in v and one not in v else one
        return tok

    def tokens(self, text: str) -> list[str]:
        return [self[x] for x in as_written(text)]


def as_written(text: str) -> list[str]:
    """Tokens of the folded text, before their spelling is undone; letters set apart are joined.

    Letters set apart come out as single tokens in a row, or with underscores:
    only then the text is looked through for them.
    """
    t = fold(text)[0].lower()
    if not t.isascii():
        t = _bare(t)
    toks = _TOKEN.findall(t)
    if "_" in t or "1 1 1" in " ".join(["1" if len(x) == 1 else "2" for x in toks]):
        toks = _TOKEN.findall(_SPACED.sub(_joined, _DOTTED.sub(_joined, t)))
    return toks


# --- model --------------------------------------------------------------------------


@dataclass
class Model:
    """Its size is bounded by what SAMPLE texts can hold."""

    one: dict  # token -> score
    two: dict  # (token, next token) -> score, of pairs in the seeds
    decay: float  # of the extreme-value law
    log_k: float
    vocabulary: frozenset

    def items(self, toks: list[str]) -> list[float]:
        """The scores along the text: tokens, and the seed pairs between them."""
        one, two = self.one, self.two
        own = [one.get(t, UNKNOWN) for t in toks]
        out, at = [], 0
        for i, p in enumerate(zip(toks, toks[1:]), 1):
            if p in two:
                out += own[at:i]
                out.append(two[p])
                at = i
        return out + own[at:] if at else own

    def probability(self, score: float, n: int) -> float:
        """Of a best segment of such a score or more in a harmless text of n items."""
        return -math.expm1(-math.exp(min(50.0, self.log_k + math.log(max(n, 1)) - self.decay * score)))


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in linear time.

    Segments are kept with the cumulative sums at their ends and a link to the
    nearest earlier one that begins lower. A new segment is joined to that one
    if the sum has risen to a new height since; what a search passes it never
    passes again, since the new segment's link leads around it.
    """
    left: list[float] = []
    right: list[float] = []
    start: list[int] = []
    end: list[int] = []
    link: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        low, at = total, i
        total += s
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= total:
                break
            low, at = left[j], start[j]
            del left[j:], right[j:], start[j:], end[j:]
            j, _ = link[j], link.__delitem__(slice(j, None))
        left.append(low)
        right.append(total)
        start.append(at)
        end.append(i + 1)
        link.append(j)
    return [(b - a, x, y) for a, b, x, y in zip(left, right, start, end)]


def best_segment(scores: list[float]) -> tuple[float, int, int]:
    """The highest of all segments; (0, 0, 0) if no score is positive."""
    return max(segments(scores), default=(0.0, 0, 0))


def _pairs(toks: list[str]) -> list[tuple[str, str]]:
    return list(zip(toks, toks[1:]))


def _log_odds(bad: Counter, rest: Counter, prior: float, nr: float | None = None) -> dict:
    """Log-odds of each item between two samples under a Dirichlet prior of its share of both.

    ``nr``: the size of ``rest``, where it does not list its rarest items.
    """
    nb, nr = sum(bad.values()), sum(rest.values()) if nr is None else nr
    total = nb + nr
    out = {}
    for w in bad.keys() | rest.keys():
        a = prior * (bad[w] + rest[w]) / total + 0.02
        x, y = bad[w] + a, rest[w] + a
        out[w] = max(-CUT, min(CUT, math.log(x / (nb + prior - x)) - math.log(y / (nr + prior - y))))
    return out


def _decay(scores: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The positive root of mean(exp(root * score)) = 1; exists as the mean is negative."""
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.average(np.exp(mid * scores), weights=counts) < 1 else (lo, mid)
    return lo


@dataclass(frozen=True)
class Seeds:
    """The seed phrases as tokens and as counts of tokens and of their pairs."""

    bad: list
    good: list

    @classmethod
    def load(cls) -> "Seeds":
        plain = Speller(frozenset()).tokens
        return cls([plain(p) for p in abusive()], [plain(p) for p in harmless()])

    def words(self) -> frozenset:
        return frozenset(t for p in self.bad + self.good for t in p)

    def pairs(self) -> frozenset:
        return frozenset(x for p in self.bad + self.good for x in _pairs(p))

    def model(self, one: Counter, two: Counter, n_one: float, n_two: float, vocabulary: frozenset) -> Model:
        """Log-odds against a background: counts of its tokens and of seed pairs, with their totals."""
        b1, b2, r1, r2 = Counter(), Counter(), Counter(), Counter()
        for p in self.bad:
            b1.update(p)
            b2.update(_pairs(p))
        for p in self.good * 3:
            r1.update(p)
            r2.update(_pairs(p))
        n1, n2 = sum(r1.values()) + n_one, sum(r2.values()) + n_two
        for own, more in ((r1, one), (r2, two)):
            for k, n in more.items():
                own[k] += n
        first = _log_odds(b1, r1, PRIOR, n1)
        second = {w: s for w, s in _log_odds(b2, r2, PRIOR, n2).items() if b2[w] + r2[w] >= 2 and abs(s) > 0.3}
        model = Model(first, second, 1.0, 0.0, vocabulary)
        # the law's decay is that of the scores of the background's items; tokens without a count are unknown
        scored = [(first[k], n) for k, n in one.items()] + [(second[k], n) for k, n in two.items() if k in second]
        scored.append((UNKNOWN, max(0.0, n_one - sum(one.values()))))
        scores, counts = np.array(scored, dtype=float).T
        model.decay = _decay(scores, counts) if counts.sum() else _decay(np.array([-1.0]))
        return model


#: Marks the rows of counts that hold totals: tokens, pairs and texts.
_TOTALS = ("", "tokens"), ("", "pairs"), ("", "texts")


def count_texts(batches: Iterator[pd.DataFrame], words: frozenset, pairs: frozenset) -> Iterator[pd.DataFrame]:
    """a, b, n of a partition: tokens (b empty), seed pairs and totals, in bounded portions.

    Tokens are counted as written, unless their spelling undone is a seed's.
    """
    n: Counter = Counter()
    two: Counter = Counter()
    spell = Speller(words)

    def out():
        rows = [(a, "", k) for a, k in n.items()] + [(a, b, k) for (a, b), k in two.items()]
        return pd.DataFrame(rows, columns=["a", "b", "n"])

    for batch in batches:
        for text in batch["t"]:
            written = as_written(text)
            toks = [spell[x] for x in written]
            n.update([y if y in words else x for x, y in zip(written, toks)])
            two.update([p for p in zip(toks, toks[1:]) if p in pairs])
            two[_TOTALS[0]] += len(toks)
            two[_TOTALS[1]] += max(0, len(toks) - 1)
            two[_TOTALS[2]] += 1
        if len(n) > HELD:
            yield out()
            n.clear()
            two.clear()
    yield out()


def model_of(df: DataFrame, text_col: str) -> Model:
    """The model with its background counted over all texts, in one pass; not calibrated yet.

    With more than SAMPLE texts, counts are scaled to that many, so the weight
    of the prior means the same at every size; tokens that then count less than
    LEAST, as do those never seen, score as unknown unless they are in the seeds.
    """
    seeds = Seeds.load()
    shared = df.sparkSession.sparkContext.broadcast((seeds.words(), seeds.pairs()))
    rows = spread(df.select(F.col(text_col).alias("t")).filter("t is not null and t <> ''"))
    found = rows.mapInPandas(lambda b: count_texts(b, *shared.value), "a string, b string, n bigint")
    counts = materialize(found.groupBy("a", "b").agg(F.sum("n").alias("n")))
    totals = {r.b: r.n for r in counts.filter("a = ''").collect()}
    scale = min(1.0, SAMPLE / max(totals.get("texts", 0), 1))
    words = seeds.words()
    kept = counts.filter("a <> ''").filter((F.col("n") * scale >= LEAST) | (F.col("b") != "") | F.col("a").isin(sorted(words)))
    one, two = Counter(), Counter()
    for r in kept.collect():
        if r.b:
            two[r.a, r.b] = r.n * scale
        else:
            one[r.a] = r.n * scale
    often = frozenset(w for w, n in one.items() if n >= LEAST and _PLAIN.fullmatch(w))
    return seeds.model(one, two, totals.get("tokens", 0) * scale, totals.get("pairs", 0) * scale, words | often)


def segment_scores(df: DataFrame, id_cols: list[str], text_col: str, model: Model) -> DataFrame:
    """id columns, best (score of the highest segment), n_items, n_segments; whole texts.

    Null, empty and blank texts have no item and no segment.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<best double, n_items int, n_segments int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        tokens = Speller(m.vocabulary).tokens
        for s in batches:
            best, size, n = [], [], []
            for t in s:
                x = m.items(tokens(t)) if t else []
                found = segments(x)
                best.append(max(found)[0] if found else 0.0)
                size.append(len(x))
                n.append(len(found))
            yield pd.DataFrame({"best": best, "n_items": np.array(size, "int32"), "n_segments": np.array(n, "int32")})

    rows = spread(df.select(*id_cols, F.col(text_col).alias("__text")))
    return rows.select(*id_cols, run("__text").alias("__s")).select(*id_cols, "__s.*")


def calibrated(scores: DataFrame, model: Model) -> Model:
    """The model with log K from the best segments of all texts.

    Under the extreme-value law the median of decay * best - log(n_items) is
    log K - log(log 2); unlike the mean it does not feel the abusive texts. It is
    read off a histogram in steps of 0.01, whose size does not grow with the texts.
    """
    x = F.lit(model.decay) * F.col("best") - F.log("n_items")
    steps = scores.filter("n_items > 0").select(F.round(x * 100).cast("bigint").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()
    steps.sort(key=lambda r: r.x)
    half, upto = sum(r.n for r in steps) / 2, 0
    for r in steps:
        upto += r.n
        if upto >= half:
            return replace(model, log_k=r.x / 100 + math.log(math.log(2)))
    return model


def passages(model: Model, speller: Speller, text: str, alpha: float = ALPHA) -> list[tuple[float, str]]:
    """Every significant passage: (probability, its tokens)."""
    toks = speller.tokens(text)
    spans, scores, last = [], [], None
    for k, t in enumerate(toks):
        if last is not None and (p := model.two.get((last, t))) is not None:
            scores.append(p)
            spans.append(k)
        scores.append(model.one.get(t, UNKNOWN))
        spans.append(k)
        last = t
    out = []
    for s, a, b in segments(scores):
        p = model.probability(s, len(scores))
        if p < alpha:
            out.append((p, " ".join(toks[spans[a] : spans[b - 1] + 1])))
    return out


# --- operators ----------------------------------------------------------------------


def _scored(df: DataFrame, id_cols: list[str], text_col: str) -> tuple[Model, DataFrame]:
    model = model_of(df, text_col)
    scores = materialize(segment_scores(df, id_cols, text_col, model))
    return calibrated(scores, model), scores


def fit(df: DataFrame, text_col: str) -> Model:
    """The calibrated model of a table's texts."""
    return _scored(df, [], text_col)[0]


def scored(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """id columns, probability, score (1 - probability) and abusive; whole texts.

    Two passes: one counts the background, one finds the segments of every
    text, from which the law is calibrated as well. Null, empty and blank texts
    have probability 1 and are not abusive.
    """
    model, scores = _scored(df, id_cols, text_col)
    rate = F.exp(F.least(F.lit(50.0), F.lit(model.log_k) + F.log(F.greatest("n_items", F.lit(1))) - F.lit(model.decay) * F.col("best")))
    p = F.when(F.col("n_items") > 0, -F.expm1(-rate)).otherwise(1.0)
    x = scores.select(*id_cols, p.alias("probability"))
    return x.select(*id_cols, "probability", (1 - F.col("probability")).alias("score"), (F.col("probability") < ALPHA).alias("abusive"))


def flagged_passages(df: DataFrame, id_cols: list[str], text_col: str, model: Model) -> DataFrame:
    """id columns, passage_no, probability, passage of every significant passage."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<probability double, passage string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        speller = Speller(m.vocabulary)
        for s in batches:
            yield pd.Series([[{"probability": p, "passage": w} for p, w in passages(m, speller, t)] if t else [] for t in s], dtype=object)

    rows = spread(df.select(*id_cols, F.col(text_col).alias("__text")).filter("__text is not null"))
    x = rows.select(*id_cols, F.posexplode(run("__text")).alias("passage_no", "__p"))
    return x.select(*id_cols, "passage_no", "__p.probability", "__p.passage")
