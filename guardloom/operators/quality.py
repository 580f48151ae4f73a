"""Scores of answers in [0, 1]; informational, they never block. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.functions import text as tx
from guardloom.operators.agentic import content_words
from guardloom.operators.hits import let

_MARKERS = "however therefore because although furthermore moreover thus consequently first second finally also then instead".split()


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)


def groundedness(answer: Column, sources: Column) -> Column:
    """Share of the sentences whose words overlap all sources by 0.3; 1 without sources or sentences."""
    bag = content_words(F.array_join(F.coalesce(sources, F.array().cast("array<string>")), " "))

    def of(b: Column) -> Column:
        ok = F.transform(tx.sentences(answer, 10), lambda s: (tx.overlap(content_words(s), b) >= 0.3).cast("int"))
        return F.when((F.size(b) == 0) | (F.size(ok) == 0), 1.0).otherwise(_mean(ok))

    return F.round(let(bag, of), 4)


def _dot_products(q: Column, a: Column) -> Column:
    """Of the word counts of two bags: q with a, q with itself, a with itself. One sorted pass, so n log n."""
    tagged = lambda bag, i: F.transform(bag, lambda w: F.struct(w.alias("w"), F.lit(i).alias("i")))
    zero = F.lit(0.0)
    start = F.struct(F.lit(None).cast("string").alias("last"), zero.alias("x"), zero.alias("y"), zero.alias("xy"), zero.alias("xx"), zero.alias("yy"))

    def step(s: Column, v: Column) -> Column:
        new = ~(s["last"].eqNullSafe(v["w"]))
        x, y = F.when(new, 0.0).otherwise(s["x"]), F.when(new, 0.0).otherwise(s["y"])
        closed = lambda p, q_, total: F.when(new, s[total] + s[p] * s[q_]).otherwise(s[total])
        return F.struct(
            v["w"].alias("last"), (x + (1 - v["i"])).alias("x"), (y + v["i"]).alias("y"),
            closed("x", "y", "xy").alias("xy"), closed("x", "x", "xx").alias("xx"), closed("y", "y", "yy").alias("yy"),
        )

    done = lambda s: F.struct((s["xy"] + s["x"] * s["y"]).alias("xy"), (s["xx"] + s["x"] * s["x"]).alias("xx"), (s["yy"] + s["y"] * s["y"]).alias("yy"))
    return F.aggregate(F.array_sort(F.concat(tagged(q, 0.0), tagged(a, 1.0))), start, step, done)


def relevance(question: Column, answer: Column) -> Column:
    """Half the cosine of word counts, a quarter each the recall of names and of keywords; 0.5 if one is empty."""
    q, a = tx.tokens(question), tx.tokens(answer)

    def of(x: Column) -> Column:
        qs, as_ = x["q"], x["a"]
        names = F.transform(F.regexp_extract_all(question, F.lit(r"(?<=\s)([A-Z][a-z]+)\b"), 1), lambda w: F.lower(w))
        entity = F.when(F.size(names) > 0, tx.overlap(names, as_)).otherwise(1.0)
        cosine = let(_dot_products(qs, as_), lambda d: d["xy"] / (F.sqrt(d["xx"]) * F.sqrt(d["yy"])))
        score = 0.5 * cosine + 0.25 * entity + 0.25 * tx.overlap(content_words(question), as_)
        return F.when((F.size(qs) == 0) | (F.size(as_) == 0), 0.5).otherwise(F.least(F.lit(1.0), score))

    return F.round(let(F.struct(q.alias("q"), a.alias("a")), of), 4)


def coherence(answer: Column) -> Column:
    """0.3 connectives, 0.4 words shared by neighbours, 0.3 distinct sentences; 0.8 for one sentence."""

    def of(s: Column) -> Column:
        bags = F.transform(s, content_words)
        marked = F.transform(s, lambda x: F.arrays_overlap(tx.tokens(x), tx.words(*_MARKERS)).cast("int"))
        shared = F.zip_with(F.slice(bags, F.lit(1), F.size(bags) - 1), F.slice(bags, F.lit(2), F.size(bags) - 1), tx.jaccard)
        unique = F.size(F.array_distinct(F.transform(s, F.lower))) / F.size(s)
        score = 0.3 * F.least(F.lit(1.0), _mean(marked) * 2) + 0.4 * F.least(F.lit(1.0), _mean(shared) * 3) + 0.3 * unique
        return F.when(F.size(s) <= 1, 0.8).otherwise(score)

    return F.round(let(tx.sentences(answer, 5), of), 4)


def fluency(answer: Column) -> Column:
    """0.3 sentence lengths, 0.3 complete sentences, 0.2 punctuation, 0.2 variety of words."""

    def of(x: Column) -> Column:
        s, k = x["s"], x["k"]
        lengths = F.transform(s, lambda v: F.size(tx.tokens(v)).cast("double"))
        mean = _mean(lengths)
        var = F.aggregate(lengths, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / F.greatest(F.size(lengths) - 1, F.lit(1))
        cv = F.when(mean > 0, F.sqrt(var) / mean).otherwise(0.0)
        good = _mean(F.transform(lengths, lambda v: v.between(3, 80).cast("int")))
        length = F.least(F.lit(1.0), good + F.when(cv.between(0.2, 0.8), 0.1).otherwise(0.0))
        whole = _mean(F.transform(s, lambda v: (v.rlike(r"^[\p{Lu}\d\"'(]") & v.rlike(r"[.!?][\"')]?$")).cast("int")))
        signs = F.when(answer.rlike(r"[.!?]"), 1.0).otherwise(0.3) - F.when(answer.rlike(r"[!?.,]{4,}"), 0.3).otherwise(0.0)
        variety = F.when(F.size(k) > 0, F.least(F.lit(1.0), 1.5 * F.size(F.array_distinct(k)) / F.size(k))).otherwise(0.0)
        return F.when(F.size(s) == 0, 0.0).otherwise(0.3 * length + 0.3 * whole + 0.2 * signs + 0.2 * variety)

    return F.round(let(F.struct(tx.sentences(answer).alias("s"), tx.tokens(answer).alias("k")), of), 4)


#: Kinds of questions with what their answers show; the first that fits counts.
_INTENTS = [
    (r"^(how (do|can|to)|explain step)", r"(first|then|next|step|click|open|choose|press|\d\.)"),
    (r"^how (many|much|long)", r"\d"),
    (r"^why", r"(because|due to|since|reason|so that)"),
    (r"^when", r"(\d|monday|tuesday|wednesday|thursday|friday|today|tomorrow|yesterday)"),
    (r"^where", r"( in | at | on | under )"),
    (r"^who", r"[A-Z][a-z]+"),
    (r"^(is|are|can|could|do|does|will|would)", r"^(yes|no)|(can|cannot|is|are)"),
    (r"^(compare|what is the difference)", r"(while|whereas|both|unlike|difference)"),
    (r"^(list|give me)", r"(\n|,|\d\.|-)"),
    (r"^(write|turn|translate)", r".{40,}"),
    (r"^what", r"( is | are | means )"),
]


def intent_resolution(question: Column, answer: Column) -> Column:
    """0.6 whether the answer has the form that the question asks for, 0.4 recall of its keywords."""
    q = F.lower(question)
    form = None
    for asks, shows in _INTENTS:
        y = F.when(answer.rlike(shows), 1.0).otherwise(0.3)
        form = F.when(q.rlike(asks), y) if form is None else form.when(q.rlike(asks), y)
    return F.round(0.6 * form.otherwise(0.5) + 0.4 * tx.overlap(content_words(question), tx.tokens(answer)), 4)


def task_adherence(answer: Column, constraints: list[tuple[str, object]]) -> Column:
    """Share of the constraints that hold; 1 without any, an unknown kind counts half."""
    if not constraints:
        return F.lit(1.0)
    words = F.size(tx.tokens(answer))
    held = {
        "max_words": lambda v: words <= v, "min_words": lambda v: words >= v, "max_chars": lambda v: F.length(answer) <= v,
        "must_include": lambda v: F.lower(answer).contains(str(v).lower()), "must_not_include": lambda v: ~F.lower(answer).contains(str(v).lower()),
        "json": lambda v: F.try_parse_json(answer).isNotNull(), "bullets": lambda v: answer.rlike(r"(?m)^\s*[-*•]"),
    }
    total = F.lit(0.0)
    for kind, v in constraints:
        total = total + (F.coalesce(held[kind](v), F.lit(False)).cast("double") if kind in held else F.lit(0.5))
    return F.round(total / len(constraints), 4)


def tool_call_accuracy(args: Column, properties: dict[str, str], required: list[str]) -> Column:
    """Share of a schema's properties that a JSON argument object fills rightly; absent optional ones count."""
    if not properties:
        return F.lit(1.0)
    total = F.lit(0.0)
    for name, kind in properties.items():
        v = F.get_json_object(args, f"$.{name}")
        typed = {"integer": v.rlike(r"^-?\d+$"), "number": v.try_cast("double").isNotNull(), "boolean": v.isin("true", "false")}.get(kind, v.isNotNull())
        total = total + F.when(v.isNull(), F.lit(0.0 if name in required else 1.0)).otherwise(F.coalesce(typed, F.lit(False)).cast("double"))
    return F.round(total / len(properties), 4)
