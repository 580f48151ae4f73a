"""The text operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import math
import random
import sys
import time
import unicodedata
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import held_out  # noqa: E402

from guardloom.llm import abuse, bpe, identity, langid, lookalike, mixture, pii, reading, sketch

DATA = "/root/testdata/sf0.01"
ODD = [None, "", " ", "​", "a" * 50_000, "\x00\x01", "日本語のテキスト", "🙂🙂", "퟿", "é"]


def odd_rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "rec_no bigint, text string, look string")


# --- 1 ------------------------------------------------------------------------------


def test_same_look(spark):
    texts = ["Café one", "Café one", "Ｃafé one", "Саfé one", "Café one", "Ca​fé one", "Cafe one", "café one", "Café, one", "40 m²", "40 m2", None, "", "​", "ﬁne", "fine", "Café one"]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_no bigint, text string").withColumn("look", F.lit(1))
    got = {(r.rec_no_a, r.rec_no_b) for r in lookalike.same_look_pairs(df, "rec_no", "text").collect()}
    same = [0, 1, 2, 3, 4, 5, 16]
    want = {(a, b) for a in same for b in same if a < b and texts[a] != texts[b]} | {(12, 13), (14, 15)}
    assert got == want
    forms = {r.rec_no: r.canonical for r in lookalike.canonical_forms(df, "rec_no", "text").collect()}
    assert len({forms[i] for i in same}) == 1 and forms[6] == "Cafe one" and forms[11] is None and forms[13] == ""


def test_same_look_edges(spark):
    assert lookalike.same_look_pairs(odd_rows(spark), "rec_no", "text").count() >= 1
    assert lookalike.same_look_pairs(odd_rows(spark).limit(0), "rec_no", "text").count() == 0


def test_same_look_brute_force(spark):
    t = spark.read.parquet(f"{DATA}/infer_requests.parquet")
    got = {(r[0], r[1]) for r in lookalike.same_look_pairs(t, "rec_no", "text").collect()}
    table = str.maketrans(dict(zip(lookalike._FROM, lookalike._TO)))
    groups = {}
    for r in t.select("rec_no", "text").filter("text is not null").collect():
        s = "".join(c for c in r.text if unicodedata.category(c) != "Cf" and (c >= " " or c in "\n\t")).translate(table)
        for a, b in lookalike._LIGATURES.items():
            s = s.replace(a, b)
        groups.setdefault(unicodedata.normalize("NFC", s.strip(" ")), []).append(r)
    want = {(min(a.rec_no, b.rec_no), max(a.rec_no, b.rec_no)) for g in groups.values() for a in g for b in g if a.text != b.text}
    assert got == want and got


def test_canonical_form_of_one_text_alone(spark):
    """A text comes out alike whether its twins are in the table or not."""
    twins = ["caf\u00e9 \uff4f\uff4b", "cafe\u0301 ok", "c\u0430f\u00e9\u00a0ok", "\u043c\u043eя \u043dочь", "\u043coя нoчь", "\u03bf\u03b4\u03cc\u03c2", "oδ\u03bf\u0301ς", "\U0002F800 x", "\u4E3D x", "\ufb01n"]
    frame = lambda rows: spark.createDataFrame(rows, "n bigint, t string")
    got = {r.n: r.canonical for r in lookalike.canonical_forms(frame(list(enumerate(twins))), "n", "t").collect()}
    assert got[0] == got[1] == got[2] == "caf\u00e9 ok" and got[3] == got[4] == "моя ночь" and got[5] == got[6] and got[7] == got[8] and got[9] == "fin"
    for n, t in enumerate(twins):
        assert lookalike.canonical_forms(frame([(n, t)]), "n", "t").first().canonical == got[n]
    again = {r.n: r.canonical for r in lookalike.canonical_forms(frame(list(got.items())), "n", "t").collect()}
    assert again == got  # the form of a form is itself


def test_coarse_hash_covers_all_canonical_decompositions(spark):
    cps = [cp for cp in lookalike._COMPOSED if len(unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(cp)))) <= 3]
    rows = [(cp, chr(cp), unicodedata.normalize("NFD", chr(cp))) for cp in cps]
    x = spark.createDataFrame(rows, "cp int, a string, b string")
    assert len(cps) > 1_500
    assert x.filter(lookalike.coarse_hash("a") != lookalike.coarse_hash("b")).count() == 0


# --- 2 ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(langid.labelled_sample(spark.read.parquet(f"{DATA}/documents.parquet"), "text", "lang", "doc_id"))


def test_languages_held_out(spark, model):
    """Against the labels of requests, of which a known share is wrong on purpose."""
    t = spark.read.parquet(f"{DATA}/infer_requests.parquet").filter("text is not null")
    rows = t.select("text", langid.label_of("params").alias("l")).filter("l is not null").collect()
    found = langid.decide(model, [r.text for r in rows])
    ok = sum(any(x[0] == r.l for x in f) for r, f in zip(rows, found) if f)
    assert ok / sum(bool(f) for f in found) > 0.88


def test_mixed_and_code(model):
    a = "Could you tell me how long the page will stay blocked? "
    b = "Könnten Sie mir bitte sagen, wie lange die Prüfung noch dauert? "
    one, two, none = langid.decide(model, [a, a + b, 'if (x >= 3) { return 0x3; } // 12'])
    assert {x[0] for x in one} == {"en"} and {x[0] for x in two} == {"en", "de"} and none == []
    assert langid.decide(model, ODD[:4]) == [[]] * 4


def test_labels(spark):
    given = ['{"language": "EN"}', '{"lang": "pt-BR"}', '{"locale": "ger"}', '{"hints": {"language": "Spanish"}}', '{"language": "auto"}', '{"language": ""}', "no json", None, '{"allowed_languages": ["en"]}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string")
    assert [r.l for r in df.orderBy("i").select(langid.label_of("p").alias("l")).collect()] == ["en", "pt", "de", "es", None, None, None, None, None]


def test_segments_edges(spark, model):
    rows = langid.segments(odd_rows(spark), model, "rec_no", "text").collect()
    assert all(0 <= r.confidence <= 1 for r in rows)
    assert langid.segments(odd_rows(spark).limit(0), model, "rec_no", "text").count() == 0


def test_no_language_without_labelled_texts(spark):
    empty = langid.fit([])
    assert langid.decide(empty, ["The house is green and old.", None]) == [[], []]
    assert langid.segments(odd_rows(spark), empty, "rec_no", "text").count() == 0


def test_languages_that_are_not_known_are_rejected(model):
    """Every centroid has a radius of its own, and what lies beyond it has no language."""
    assert len({round(float(r), 4) for r in model.radius}) > len(model.radius) // 2
    strange = ["Vláda schválila nový zákon o dani z příjmů.", "Regeringen har beslutat om nya regler för skolan i år.", "Hallitus päätti uusista säännöistä kouluille tänä vuonna.", "Hükümet bu yıl okullar için yeni kurallar belirledi."]
    assert langid.decide(model, strange) == [[]] * 4
    known = ["The government has decided on new rules for schools this year.", "La nouvelle règle vaut pour toutes les écoles du pays."]
    assert [d[0][0] for d in langid.decide(model, known)] == ["en", "fr"]


# --- 3 ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scorer(spark):
    return abuse.fit(spark.read.parquet(f"{DATA}/infer_requests.parquet"), "text")


def judge(model, text):
    x = model.items(abuse.Speller(model.vocabulary).tokens(text))
    return model.probability(abuse.best_segment(x)[0], len(x))


def test_segments_are_maximal():
    rnd = random.Random(5)
    for _ in range(300):
        x = [rnd.choice([-2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(rnd.randint(1, 14))]
        best = max([sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)] + [0.0])
        assert abs(abuse.best_segment(x)[0] - best) < 1e-9
        segs = abuse.segments(x)
        assert all(abs(sum(x[a:b]) - s) < 1e-9 and s > 0 for s, a, b in segs)
        assert max([s for s, _, _ in segs] + [0.0]) == pytest.approx(best)


@pytest.mark.parametrize("text", ["You are a pathetic idiot and everybody knows it.", "y0u ar3 a w0rthl3ss m0ron", "Shut up, you stuuupid baaastard", "I will find you and b.r.e.a.k your neck", "Du bist ein dummes Arschloch", "Va te faire foutre, connard", "Ojalá te mueras, imbécil"])
def test_abusive(scorer, text):
    assert judge(scorer, text) < abuse.ALPHA


@pytest.mark.parametrize("text", ["The moderator removed a post because it insulted people.", "How do I kill a stuck process?", "A dumb terminal is enough.", "Could you tell me how long this takes?", "Das Wort Idiot kommt aus dem Griechischen."])
def test_harmless(scorer, text):
    assert judge(scorer, text) > abuse.ALPHA


def test_held_out_sentences(scorer):
    """Sentences that the seeds were not written for: recall 0.9, one false case at most."""
    assert sum(judge(scorer, t) < abuse.ALPHA for t in held_out.ABUSIVE) >= 0.9 * len(held_out.ABUSIVE)
    assert sum(judge(scorer, t) < abuse.ALPHA for t in held_out.HARMLESS) <= 1


def test_all_segments_against_definition():
    """The stack with links finds what joining neighbours until nothing changes finds."""

    def slow(x):
        sums = [0.0]
        for v in x:
            sums.append(sums[-1] + v)
        out = [(i, i + 1) for i, v in enumerate(x) if v > 0]
        done: list = []
        for new in out:
            while True:
                j = max((k for k, (a, _) in enumerate(done) if sums[a] < sums[new[0]]), default=None)
                if j is None or sums[done[j][1]] >= sums[new[1]]:
                    done.append(new)
                    break
                new = (done[j][0], new[1])
                del done[j:]
        return done

    rnd = random.Random(9)
    for _ in range(400):
        x = [rnd.choice([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(rnd.randint(1, 30))]
        assert [(a, b) for _, a, b in abuse.segments(x)] == slow(x)


def test_long_texts_in_linear_time(scorer):
    """Scores along a text, and personal data in it, cost in proportion to its length."""
    tokens = abuse.Speller(scorer.vocabulary).tokens("you are a stupid idiot and you smell ")
    assert scorer.items(tokens) == [x for i, t in enumerate(tokens) for x in ([scorer.two[tokens[i - 1], t]] if i and (tokens[i - 1], t) in scorer.two else []) + [scorer.one.get(t, abuse.UNKNOWN)]]

    def took(f, x):
        began = time.perf_counter()
        f(x)
        return time.perf_counter() - began

    assert took(scorer.items, tokens * 40_000) < 60 * max(1e-3, took(scorer.items, tokens * 2_000))
    line = "Write to ann@example.org or call +44 20 7946 0958 today. "
    assert took(pii.find, line * 4_000) < 60 * max(1e-3, took(pii.find, line * 200))
    assert len(pii.find(line * 50)) == 100


def test_segments_in_linear_time():
    def took(n, x):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            abuse.segments(x * n)
            best = min(best, time.perf_counter() - began)
        return best

    for x in ([1.0, -2.0], [3.0, -1.0, -1.5], [-1.0, 2.0]):
        assert took(64_000, x) < 40 * took(4_000, x)


def test_abuse_edges(spark):
    rows = {r.rec_no: r for r in abuse.scored(odd_rows(spark), ["rec_no"], "text").collect()}
    assert len(rows) == len(ODD) and not any(r.abusive for r in rows.values()) and rows[0].probability == 1.0
    assert abuse.scored(odd_rows(spark).limit(0), ["rec_no"], "text").count() == 0


# --- 4 ------------------------------------------------------------------------------


def test_percentiles_are_bounded_and_merge(spark):
    rnd = random.Random(9)
    values = [int(rnd.lognormvariate(4, 2)) * rnd.choice([1, 1, 1, -1, 0]) for _ in range(3000)] + [10**15, -(10**12)]
    rows = [(i, rnd.choice("ab"), rnd.choice("xy"), float(v)) for i, v in enumerate(values)] + [(9001, None, "x", 5.0), (9002, "a", "x", None), (9003, "a", "y", float("nan")), (9004, "a", "y", float("inf"))]
    df = spark.createDataFrame(rows, "i bigint, g string, day string, v double")
    parts = sketch.sketch(df, "v", ["g", "day"])
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in sketch.percentiles(sketch.merge(parts, ["g"]), ["g"], shares).collect()}
    direct = {r.g: r for r in sketch.percentiles(sketch.sketch(df, "v", ["g"]), ["g"], shares).collect()}
    assert got == direct
    for g in ("a", "b"):
        own = sorted(v for _, k, _, v in rows if k == g and v is not None and math.isfinite(v))
        assert got[g].n == len(own)
        for name, p in shares.items():
            x = own[math.floor(p * (len(own) - 1))]
            assert abs(got[g][name] - x) <= sketch.ALPHA * abs(x) + 1e-9
    assert got[None].n == 1
    assert sketch.percentiles(sketch.sketch(df.limit(0), "v", ["g"]), ["g"], shares).count() == 0


def test_copies_count_once(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 7), (None, 1), (None, 1)], "id bigint, v bigint")
    assert sketch.once(df, "id", ["v"]).count() == 4


# --- 5 ------------------------------------------------------------------------------

FOUND = [
    ("Write to ann.lee+x@mail.example.org now", {"email"}), ("mail: ann [at] example (dot) org", {"email"}), ("ＡＮＮ＠example.org", {"email"}), ("package @a/b@1.2.3 and user@role", set()),
    ("Call +1 303 555 0145 today", {"phone"}), ("tel 020 7946 0321", {"phone"}), ("Sie erreichen mich unter 030/23125047.", {"phone"}), ("(ref 9400-95231) order 5550-109-77", set()), ("at 10:42 version 1.212.555", set()),
    ("My SSN: 666123456 is here", {"identity_number"}), ("the card says 666-17-5941", {"identity_number"}), ("DNI 99998897A", {"identity_number"}), ("The serial number 666A-15-4418", set()),
    ("I moved to 12 Larkspur Row, Stennick BX10 7QT in May.", {"street_address"}), ("wohnhaft Hopfenweg 36, 00141 Wellmingen", {"street_address"}), ("j'habite au 23 bis, avenue du Vieux-Pressoir", {"street_address"}), ("Lane 4 and Close 7 are test cells", set()),
    ("Kind regards, Fenna Ostelwick", {"person_name"}), ("This is B. Thackmont from the night shift", {"person_name"}), ("The Ada Suite and the Victor engine", set()), ("Mr was read as a title", set()),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_found_kinds(text, want):
    assert {k for _, _, k in pii.find(text)} == want


def test_pseudonyms():
    key = b"k"
    rnd = random.Random(2)
    for n in (1, 2, 3, 7, 10, 16):
        for _ in range(20):
            d = "".join(rnd.choice("0123456789") for _ in range(n))
            assert pii.feistel_digits(key, pii.feistel_digits(key, d), back=True) == d
    assert len({pii.feistel_digits(key, f"{i:03d}") for i in range(1000)}) == 1000
    for d in (date(1900, 1, 1), date(1987, 6, 5), date(2099, 12, 31)):
        assert pii.permute_date(key, pii.permute_date(key, d), back=True) == d
    one, two = pii.redact("Call +1 303 555 0145.", key), pii.redact("ring +1-303-555-0145!", key)
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(one) == digits(two) != "13035550145" and one.startswith("Call [PHONE ") and one.endswith("].")
    assert pii.redact("nothing here", key) == "nothing here"


def test_nothing_is_left(spark):
    t = spark.read.parquet(f"{DATA}/infer_requests.parquet").filter("text is not null")
    for r in pii.redacted(t, ["rec_no"], "text", "k").filter("n_items > 0").join(t.select("rec_no", "text"), "rec_no").collect():
        for a, b, kind in pii.find(r.text):
            if kind in ("email", "phone"):
                assert r.text[a:b] not in r.redacted


def test_pii_edges(spark):
    rows = pii.redacted(odd_rows(spark), ["rec_no"], "text", "k").collect()
    assert {r.rec_no: r.redacted for r in rows} == dict(enumerate(ODD))
    assert pii.found_kinds(odd_rows(spark).limit(0), ["rec_no"], "text", "k").count() == 0


# --- 8 ------------------------------------------------------------------------------


def test_ids_equal_the_publishers(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [*ODD, "<|endoftext|> x", "don't  stop\n\n\tnow", "x" * 3000 + "é" * 500]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("n"), "text")
    df = docs.unionByName(spark.createDataFrame([(-1 - i, x) for i, x in enumerate(texts)], "n bigint, text string"))
    want = {r.n: t.encode(r.text, add_special_tokens=False).ids if r.text else [] for r in df.collect()}
    got = {r.n: list(r.ids) for r in bpe.encode(df, "n", "text").collect()}
    assert got == want
    counts = {r.n: r.n_tokens for r in bpe.token_counts(df, "text").collect()}
    assert counts == {k: len(v) for k, v in want.items()}


def test_perfect_hash():
    keys = {f"k{i}".encode(): i for i in range(5000)}
    h = bpe.PerfectHash(keys)
    assert len(h.key_at) == len(keys) and all(h.get(k) == i for k, i in keys.items()) and h.get(b"other") == -1


def test_identity_numbers_of_their_schemes():
    """Permuted numbers hold their check digits and come back; each scheme meets only itself."""
    rnd = random.Random(4)
    shapes = {"ssn": "999-99-9999", "nhs": "999 999 9999", "cpf": "999.999.999-99", "snils": "999-999-999 99", "pesel": "99999999999", "steuer": "99 999 999 999", "nir": "1 99 99 99 999 999 99", "sin": "999-999-999", "bsn": "999999999", "dni": "99999999A", "nie": "X9999999A", "fiscal": "RSSMRA99T99A999A"}
    for s in identity.SCHEMES:
        found = 0
        while found < 20:
            v = "".join(rnd.choice("0123456789") if c == "9" else c for c in shapes[s.name])
            u = identity.plain(v)
            check = s.check(u[: s.payload])
            if check is None:
                continue
            v = identity.written_like(v, u[: s.payload] + check)
            own = identity.scheme_of(v)
            if own is None:
                continue
            got = pii.permute_identity(b"key", v)
            assert identity.scheme_of(got) == own and pii.permute_identity(b"key", got, back=True) == v
            found += 1
    assert pii.permute_identity(b"key", "QQ 12 34 56 A", back=True) != "QQ 12 34 56 A"


def test_personal_data_held_out():
    kinds = [{k for _, _, k in pii.find(t)} for t, _ in held_out.PERSONAL]
    wanted = sum(len(w) for _, w in held_out.PERSONAL)
    assert sum(len(k & w) for k, (_, w) in zip(kinds, held_out.PERSONAL)) >= 0.9 * wanted
    assert sum(bool(pii.find(t)) for t in held_out.IMPERSONAL) <= 1


def test_tags_are_long_and_dates_keep_their_form():
    tag = pii.placeholder(b"k", "email", "a@b.example")
    assert len(tag) == len("[EMAIL ]") + 32
    assert pii.redact("geboren am 29.02.1980", b"k").startswith("geboren am [DATE ") and pii.redact("born 1980-02-30", b"k") == "born 1980-02-30"


# --- 9 ------------------------------------------------------------------------------


def test_mixture(spark):
    rnd = random.Random(4)
    rows = [(i, s, rnd.randint(1, 400)) for i, s in enumerate(random.Random(1).choices(["big", "mid", "small", None, "other"], [60, 25, 5, 5, 5], k=6000))] + [(9999, "big", 0), (9998, "mid", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs, "doc_id", "source", "n_tokens", targets)
    got = {r.source: r for r in mixture.shares(mixed, targets, docs, "source", "n_tokens").collect()}
    for s, p, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4)):
        assert abs(got[s].actual_share - p / 0.95) < 0.01 and got[s].most_copies <= cap
    assert got["none"].tokens_used == 0 and got["other"].tokens_used == 0 and got["none"].aimed_share is None
    assert mixed.groupBy("doc_id").count().filter("count > 1").count() == 0
    large = {r.source: r for r in mixture.shares(mixture.mix(docs, "doc_id", "source", "n_tokens", targets, 10.0**9), targets, docs, "source", "n_tokens").collect()}
    assert large["big"].copies == large["big"].n_docs - 1 and large["small"].most_copies == 4
    assert mixture.mix(docs.limit(0), "doc_id", "source", "n_tokens", targets).count() == 0
    assert mixture.mix(docs, "doc_id", "source", "n_tokens", targets.limit(0)).count() == 0


def test_multiplier_of_one_source():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        n = np.sort(rnd.choice(np.arange(1, 3_000), 40, replace=False)).astype(float)
        docs, cap = rnd.integers(1, 500, 40).astype(float), float(rnd.integers(1, 6))
        mean = (n * docs).sum() / docs.sum()
        for share in (1e-4, 0.3, 0.999, 1.0):
            want = share * (n * docs).sum() * cap
            l = mixture.solve(n, docs, mean, cap, want)
            got = (n * docs * np.minimum(cap, np.exp(np.minimum(l * n / mean, 50.0)))).sum()
            assert got == pytest.approx(want, rel=1e-5)


# --- 10 -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def grader(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return reading.fit(docs, "text", "source", "lang")


EASY = "The dog is big. My mom has a red hat and we play with the ball. I like my cat. She is in the bed. We read a book and then we eat an apple."
HARD = "The iatrogenic sequelae of heteroscedastic confabulation notwithstanding, the fiduciary antinomy supervenes upon an ineliminable hermeneutic lacuna. Eigenvalue degeneracy obviates commensurability."
MIDDLE = "The service checks each reply before it reaches the user. Open the settings, choose the right account and press the button. The report lists the number of warnings for every team."


def test_levels(spark, grader):
    rows = [(0, EASY, "en"), (1, HARD, "en"), (2, MIDDLE, None), (3, "Der Hund ist groß und die Katze schläft im Bett.", None), (4, '{"name": "x", "b": [1, 2]}', "en"), (5, None, "en"), (6, " ", "en"), (7, EASY, "de")]
    df = spark.createDataFrame(rows, "i int, text string, lang string").withColumn("grade", F.lit("clash"))
    got = {r.i: r for r in reading.all_graded(df, ["i"], "text", "lang", grader).collect()}
    assert len(got) == len(rows) and got[0].level == "easy" and got[1].level == "hard" and got[2].level == "middle"
    assert got[0].english_prose and got[1].english_prose and got[2].english_prose and not got[3].english_prose and not got[4].english_prose and not got[7].english_prose
    assert got[5].grade is None and got[6].level is None
    assert reading.all_graded(df.limit(0), ["i"], "text", "lang", grader).count() == 0


def test_grader_of_few_documents(spark):
    rows = [(i, t, "s", "en") for i, t in enumerate([EASY, HARD, MIDDLE])]
    df = spark.createDataFrame(rows, "i int, text string, source string, lang string")
    got = reading.graded(df, ["i"], "text", "lang", reading.fit(df, "text", "source", "lang")).collect()
    assert len(got) == 3 and all(1 <= r.grade <= 18 for r in got)
    none = df.limit(0)
    assert reading.graded(df, ["i"], "text", "lang", reading.fit(none, "text", "source", "lang")).first().grade == 8.0


def test_samples_of_huge_corpora(spark):
    """The share of rows to pick does not become nothing, however many rows there are."""
    df = spark.range(200_000).withColumn("h", F.xxhash64("id"))
    assert reading.picked(df, "h", 200_000, 3_000).count() == pytest.approx(3_000, rel=0.1)
    for total in (10**10, 10**12, 10**15):
        condition = reading.picked(df, "h", total, 3_000)._jdf.queryExecution().analyzed().toString()
        assert f"{(1 << 62) * 3_000 // total}" in condition and (1 << 62) * 3_000 // total > 1_000
    assert reading.picked(df, "h", 10, 3_000) is df


def test_features_against_plain_counts():
    texts = ["The cat sat. The cat ran, and it was of use (once).", "", "Nation building happens; the nation grows."]
    docs = [reading.prose(t) for t in texts]
    got = reading.features(texts, docs, reading.Words())
    name = reading.NAMES.index
    assert not got[1].any()
    for i in (0, 2):
        flat = [w for s in docs[i] for w in s]
        assert got[i, name("words_mean")] == pytest.approx(len(flat) / len(docs[i]))
        assert got[i, name("letters_mean")] == pytest.approx(sum(map(len, flat)) / len(flat))
        assert got[i, name("letters_p90")] == sorted(map(len, flat))[(len(flat) - 1) * 9 // 10]
        assert got[i, name("variety")] == pytest.approx(math.log(len(set(flat)) + 1) / math.log(len(flat) + 1))
    a, b = ({w for w in s if w not in reading._FUNCTION} for s in docs[0])
    assert got[0, name("overlap")] == pytest.approx(len(a & b) / min(len(a), len(b)))
    assert got[0, name("commas")] == 0.5 and got[0, name("breaks")] == 1.0


def test_held_out_sources(grader):
    assert grader.validation and all(e < 1.5 for _, n, e, _ in grader.validation if n >= 20)


def test_trees_learn():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(800, 4))
    y = 3 * (x[:, 0] > 0.5) + x[:, 1]
    t = reading.grow(x[:600], y[:600])
    assert np.sqrt(np.mean((t.predict(x[600:]) - y[600:]) ** 2)) < 0.25  # y varies by 1.5; a few rows lie in the bin of the step


def test_nothing_else_imports_this_package():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "guardloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "guardloom.llm" not in p.read_text(), p
