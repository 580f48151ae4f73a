"""Models of text operators rest on all texts."""

from collections import Counter

import pytest

from guardloom.llm import abuse, langid, lookalike

DATA = "/root/testdata/sf0.01"


def test_background_counts_all_texts(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/infer_requests.parquet").select("text").collect() if r.text][:600]
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    one = abuse.fit(frame(texts), "text")
    # the same counts, made in one place
    seeds = abuse.Seeds.load()
    spell, words, pairs = abuse.Speller(seeds.words()), seeds.words(), seeds.pairs()
    n1, n2, total = Counter(), Counter(), 0
    for t in texts:
        written = abuse.as_written(t)
        toks = [spell[x] for x in written]
        n1.update(y if y in words else x for x, y in zip(written, toks))
        n2.update(p for p in zip(toks, toks[1:]) if p in pairs)
        total += len(toks)
    kept = Counter({w: n for w, n in n1.items() if n >= abuse.LEAST or w in words})
    vocabulary = words | {w for w, n in kept.items() if n >= abuse.LEAST and abuse._PLAIN.fullmatch(w)}
    want = seeds.model(kept, n2, total, total - sum(1 for t in texts if abuse.as_written(t)), frozenset(vocabulary))
    assert one.vocabulary == want.vocabulary and one.one == pytest.approx(want.one) and one.two == pytest.approx(want.two)
    # ten times the corpus: the same model, where a sample of rows would be another one
    monkeypatch.setattr(abuse, "SAMPLE", len(texts))
    ten = abuse.fit(frame(texts * 10), "text")
    assert ten.vocabulary == one.vocabulary and ten.one == pytest.approx(one.one)
    assert (ten.decay, ten.log_k) == pytest.approx((one.decay, one.log_k))


def test_masked_words_are_no_code():
    assert len(langid.sentences("Das ist doch wirklich v*rd*mmt noch einmal zu viel.")) == 1
    assert len(langid.sentences("Please send the forms and/or letters to the office at 3 km/h or slower today.")) == 1
    assert langid.sentences("SELECT * FROM users WHERE id = 1;") == []


def test_composed_and_decomposed_lookalikes(spark):
    pairs = [("\u0435\u0308\u043b\u043a\u0430", "\u0451\u043b\u043a\u0430"), ("\u0415\u0308\u0436", "\u0401\u0436"), ("\u0456\u0308\u0436\u0430", "\u0457\u0436\u0430"), ("\u0443\u0306\u0436", "\u045e\u0436"), ("\u03bf\u0301\u03c7\u03b9", "\u03cc\u03c7\u03b9")]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = lookalike.same_look_pairs(spark.createDataFrame(rows, "n bigint, text string"), "n", "text").collect()
    assert {(r.n_a, r.n_b) for r in got} == {(2 * i, 2 * i + 1) for i in range(len(pairs))}
