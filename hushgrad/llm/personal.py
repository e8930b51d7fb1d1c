"""Personal data: candidate spans by patterns, boosted trees that judge them, all in DataFrame functions.

Base patterns give spans that always stay. Generators of high recall propose more, which overlap; each candidate has
features of its form and of the text around it, and boosted trees over those, written as one SQL expression, keep the
candidates that reach their kind's threshold. The trees are fitted on the driver over made-up candidates that go
through the same feature expressions; thresholds come from made-up candidates kept apart.

Patterns have only possessive or bounded repetitions of groups and begin where a run of their characters begins, so
they take linear time and no deep stack, however long a text is.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting

#: Kinds in the order of results; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
_LOCAL = "A-Za-z0-9._%+-"
#: Base spans, equal to the plain patterns' leftmost matches: each starts at the start of its run, and what a plain
#: pattern takes greedily is taken possessively. Lengths that never pass are left out by the card's pattern itself.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind: cheap to test.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{14}", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Generators: number -> kind, pattern, what a text needs. Secrets may be of any length, with base64's padding.
MORE = (
    ("secret", r"(?<![A-Za-z0-9])[A-Z]{4}[A-Z0-9]{12,28}(?![A-Za-z0-9])", "[A-Z]{4}[A-Z0-9]{12}"),
    ("secret", r"(?i)(?<=(?:password|passwd|pwd|token|secret|api_key|apikey|access_key)[\"']?[ \t]{0,2}[:=][ \t]{0,2}[\"']?)[^\s\"',;:=]{4,}+(?:={1,2}(?![^\s\"',;:]))?", "(?i)(?:passw|pwd|token|secret|key)[a-z]{0,4}[\"']?[ \t]{0,2}[:=]"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/=_-])", "[A-Za-z0-9+/_-]{24}"),
    ("email", r"(?i)[A-Za-z0-9._%+-]{2,64}[ ]?(?:\(at\)|\[at\]|[ ]at[ ])[ ]?[A-Za-z0-9-]{2,63}[ ]?(?:\(dot\)|\[dot\]|[ ]dot[ ])[ ]?[A-Za-z]{2,10}(?![A-Za-z])", r"(?i)(?:\(dot\)|\[dot\]| dot )"),
    ("phone", r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "[0-9]{3}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9])00[1-9][0-9]{0,2}(?:[ .-]?[0-9]){7,12}+(?![0-9])", "00[1-9]"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}+(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", "[0-9][0-9 -]{11}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "[0-9A-Fa-f]:[0-9A-Fa-f]"),
)
#: Elements of an array that are gathered together.
STEP = 64
#: Characters before a span that features look at, and words there that speak for each kind.
AROUND = 28
CONTEXT = {
    "asks": "(?i)passw|pwd|token|secret|api|key|login|auth",
    "calls": "(?i)phone|call|tel|mobile|cell|fax|whatsapp|contact",
    "pays": "(?i)card|visa|credit|debit|pay|account|iban|bank",
    "is_id": "(?i)ssn|social|tax|passport",
    "mails": "(?i)mail|write|reach|contact",
    "other": "(?i)version|license|section|chapter|isbn|order|page|figure|commit|sha|build|part|model|item|invoice|ref|room|code",
}
FEATURES = ("rule", "size", "digits", "upper", "lower", "signs", "distinct", "changes", "luhn", *CONTEXT)
TREES, DEPTH = 24, 4
#: Wrongly added spans for each rightly added one that thresholds allow on made-up candidates kept apart.
WRONG = 0.02


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f refers to it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def chunks(items: Column) -> Column:
    """An array in pieces of STEP elements."""
    return bound(items, lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int")), lambda i: F.slice(a, i * STEP + 1, STEP))).otherwise(F.slice(F.array(a), 1, 0)))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What step(state, item) -> (state, result) gives for all items in turn, an array of type out.

    A growing array is copied at each step, so results of STEP items are gathered apart, and those of all pieces then.
    """
    none = F.array().cast(f"array<{out}>")

    def inner(acc: Column, x: Column) -> Column:
        state, result = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

    def outer(acc: Column, piece: Column) -> Column:
        ran = F.aggregate(piece, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return bound(ran, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    return F.aggregate(chunks(items), F.struct(zero.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))


def spans(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, value, before>>: matches in order, by code points, with up to AROUND characters before.

    Gaps and matches in turn add up to places, so the work grows with the text and its matches, not with their product.
    """
    kind = "struct<start:int,end:int,value:string,before:string>"
    gaps = F.split(text, pattern, -1)
    pairs = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(g.alias("gap"), v.alias("value"))))
    last = lambda x: F.substring(x, -AROUND, AROUND)

    def place(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        before = last(F.concat(state["tail"], last(x["gap"])))
        return F.struct(end.alias("at"), last(F.concat(before, last(x["value"]))).alias("tail")), F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    return F.when(text.rlike(needs), scanned(pairs, zero, place, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's sum."""
    d = F.reverse(digits_of(value))

    def part(c: Column, i: Column) -> Column:
        doubled = (F.ascii(c) - 48) * (1 + i % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    # An array, since places in long texts are found by counting from the start.
    total = F.aggregate(F.transform(F.split(d, ""), part), F.lit(0), lambda a, x: a + x)
    return (F.length(d) > 0) & (total % 10 == 0)


def passes(kind: str, x: Column) -> Column:
    """What a base match must meet."""
    v = x["value"]
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return luhn(v)
    if kind == "phone":
        return F.length(digits_of(v)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> by kind and start."""
    parts = []
    for i, kind in enumerate(BASE):
        good = F.filter(spans(text, BASE[kind], NEEDS[kind]), partial(passes, kind))
        parts.append(F.transform(good, partial(_placed, i)))
    return F.concat(*parts)


def _placed(kind: int, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def features_of(x: Column) -> Column:
    """Numbers about one candidate, by the names of FEATURES."""
    v, before = x["value"], x["before"]
    n = F.length(v).cast("double")
    share = lambda cls: F.length(F.regexp_replace(v, f"[^{cls}]", "")) / n
    # Each word of one kind of characters becomes one sign, so the length that is left counts the changes of kind.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]++", "a"), "[A-Z]++", "A"), "[0-9]++", "0")
    values = {
        "rule": x["rule"].cast("double"), "size": n, "digits": share("0-9"), "upper": share("A-Z"), "lower": share("a-z"), "signs": 1 - share("A-Za-z0-9"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double"), "changes": F.length(kinds).cast("double"), "luhn": luhn(v).cast("double"),
    } | {name: before.rlike(p).cast("double") for name, p in CONTEXT.items()}
    return F.struct(*[values[f].alias(f) for f in FEATURES])


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, f>> of all generators, by start."""
    parts = []
    for rule, (kind, pattern, needs) in enumerate(MORE):
        parts.append(F.transform(spans(text, pattern, needs), partial(_proposed, KINDS.index(kind), rule)))
    return F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), features_of(x).alias("f")))


def _proposed(kind: int, rule: int, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), x["value"].alias("value"), x["before"].alias("before"))


_made: dict[str, tuple[Column, Column]] = {}


def _of_text(spark: SparkSession) -> tuple[Column, Column]:
    """Base spans and candidates of the column text; put together once in each application, since that takes a while."""
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made[key] = base_spans(F.col("text")), candidates(F.col("text"))
    return _made[key]


def made_up(n: int = 1500, seed: int = 5) -> list[tuple[int, str, int, int, int]]:
    """Texts with one planted string each: (id, text, start, end, whether it is personal)."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, rng.randint(2, 9))

    def luhned(k: int, good: bool) -> str:
        body = pick("123456789", 1) + pick(dig, k - 2)
        for last in dig:
            d = [int(c) for c in reversed(body + last)]
            if (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
                return body + (last if good else str((int(last) + rng.randint(1, 9)) % 10))
        raise AssertionError

    def grouped(x: str) -> str:
        return " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    yes = [
        lambda: ("", pick(up, 4) + pick(up + dig, 16)), lambda: ("key ", "AKIA" + pick(up + dig, 16)),
        lambda: (rng.choice(["password=", "pwd: ", "secret = ", 'token = "', "api_key: '"]), pick(low + dig, rng.choice([8, 12, 18, 24, 40]))),
        lambda: (rng.choice(['token = "', "secret=", "password="]), pick("0123456789abcdef", rng.choice([18, 32, 40, 64]))),
        lambda: (rng.choice(["password=", "password: "]), word() + pick(dig, 3) + "!"),
        lambda: ("", pick(low + up + dig + "_-", rng.choice([32, 40, 48]))),
        lambda: (rng.choice(["", "mail ", "write to "]), f"{word()}.{word()}{rng.choice([' at ', ' (at) ', '[at]'])}{word()}{rng.choice([' dot ', ' (dot) ', '[dot]'])}{rng.choice(['com', 'org', 'net'])}"),
        lambda: (rng.choice(["", "call ", "phone: ", "tel "]), f"{rng.choice(['(', ''])}{pick('23456789', 3)}" + rng.choice([") ", "-", "."]) + pick(dig, 3) + "-" + pick(dig, 4)),
        lambda: (rng.choice(["", "call ", "phone "]), "00" + pick("123456789", 2) + " " + pick(dig, 3) + " " + pick(dig, 7)),
        lambda: (rng.choice(["", "ssn ", "social security "]), f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}"),
        lambda: (rng.choice(["", "iban ", "bank account "]), rng.choice(["DE", "FR", "ES", "GB"]) + pick(dig, 2) + pick(dig, 18)),
        lambda: (rng.choice(["", "card ", "visa "]), luhned(15, True)), lambda: ("card ", grouped(luhned(15, True))),
        lambda: ("", ":".join(pick("0123456789abcdef", 4) for _ in range(8))),
    ]
    no = [
        lambda: (rng.choice(["", "section "]), pick(up, rng.randint(17, 24))), lambda: ("", "".join(word() for _ in range(6))), lambda: ("", "-".join(word() for _ in range(6))), lambda: ("", "/".join(word() for _ in range(6))),
        lambda: ("", "_" * 40), lambda: ("", "-" * 32), lambda: ("", "ABCD" + "".join(rng.choice(["ING", "THE", "ED", "ER"]) for _ in range(5))),
        lambda: (rng.choice(["the password: ", "token = ", "key: "]), rng.choice(["required", "optional", "string", "none", word()])),
        lambda: (rng.choice(["order ", "invoice ", "item ", "ref "]), luhned(rng.choice([13, 14, 15]), False)), lambda: ("isbn ", pick(dig, 13)),
        lambda: (rng.choice(["part ", "model ", "page "]), f"{pick(dig, 3)}.{pick(dig, 3)}.{pick(dig, 4)}"), lambda: ("build ", "00" + pick("123456789", 1) + pick(dig, 9)),
        lambda: (rng.choice(["commit ", "sha "]), pick("0123456789abcdef", 40)), lambda: (rng.choice(["code ", "model "]), rng.choice(up) + rng.choice(up) + pick(dig, 2) + " " + " ".join("".join(rng.choice(up) for _ in range(4)) for _ in range(4))),
        lambda: ("figure ", f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}"), lambda: ("", f"{word()} at {word()} dot dot"), lambda: ("look ", f"{word()} at {word()} dot {word()}"),
    ]
    out = []
    for i in range(n):
        personal = i % 2
        lead, value = rng.choice(yes if personal else no)()
        before = " ".join(word() for _ in range(rng.randint(3, 8))) + " " + lead
        text = f"{before}{value}{chr(34) if lead.endswith(chr(34)) else ''} {' '.join(word() for _ in range(4))}"
        out.append((i, text, len(before), len(before) + len(value), personal))
    return out


def _sum_of(forest: boosting.Forest) -> str:
    """The forest as an SQL expression of features c.f.<name>."""

    def of(i: int) -> str:
        if forest.left[i] == i:
            return f"{float(forest.value[i])!r}D"
        return f"CASE WHEN c.f.{FEATURES[forest.feature[i]]} <= {float(forest.threshold[i])!r}D THEN {of(forest.left[i])} ELSE {of(forest.right[i])} END"

    return " + ".join([f"{forest.base!r}D", *(f"({of(r)})" for r in forest.roots)])


_judged: list[tuple[str, list[float]]] = []


def judge(spark: SparkSession) -> tuple[str, list[float]]:
    """The trees as an SQL expression, and for each kind the log odds from which on a candidate is personal.

    They depend on nothing but this module, so one fit serves a process.
    """
    if not _judged:
        _judged.append(_judge(spark))
    return _judged[0]


def _judge(spark: SparkSession) -> tuple[str, list[float]]:
    rows = made_up()
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("y", T.IntegerType())])
    made = spark.createDataFrame(rows, schema).withColumn("cands", _of_text(spark)[1]).select("id", "b", "e", "y", F.explode("cands").alias("c")).where("c.start < e and c.end > b").orderBy("id", "c.start", "c.end", "c.kind").collect()
    x = np.array([[r.c.f[f] for f in FEATURES] for r in made])
    # A candidate that covers little of what was planted counts as wrong.
    y = np.array([r.y and min(r.e, r.c.end) - max(r.b, r.c.start) >= 0.6 * max(r.e - r.b, r.c.end - r.c.start) for r in made], float)
    apart = np.array([r.id // 2 % 4 == 0 for r in made])
    forest = boosting.grown(x[~apart], y[~apart], trees=TREES, depth=DEPTH, least=4.0)
    z, t = forest.margin(x[apart]), y[apart]
    kinds = np.array([r.c.kind for r in made])[apart]
    cuts = []
    for k in range(len(KINDS)):
        own = np.flatnonzero(kinds == k)
        order = own[np.argsort(-z[own])]
        wrong, right = np.cumsum(t[order] == 0), np.cumsum(t[order] == 1)
        fine = np.flatnonzero(wrong <= WRONG * np.maximum(right, 1))
        cuts.append(float(z[order[fine[-1]]]) - 1e-9 if len(fine) else 99.0)
    return _sum_of(forest), [max(c, 0.0) for c in cuts]


_SPAN = "struct<kind:int,start:int,end:int>"


def _free(base: Column, good: Column) -> Column:
    """Candidates that overlap no base span and no earlier accepted one, in order: three walks over the sorted spans."""
    event = "struct<start:int,base:int,end:int,kind:int,blocked:boolean>"
    tagged = lambda spans_, base_: F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), F.lit(base_).alias("base"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(False).alias("blocked")))
    mark = lambda x, blocked: F.struct(x["start"].alias("start"), x["base"].alias("base"), x["end"].alias("end"), x["kind"].alias("kind"), blocked.alias("blocked"))

    # Base spans that begin before a candidate reach into it, or those that begin behind its start begin before its end.
    def onward(state: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["base"] == 0, F.greatest(state, x["end"])).otherwise(state), mark(x, state > x["start"])

    def backward(state: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["base"] == 0, x["start"]).otherwise(state), mark(x, x["blocked"] | (state < x["end"]))

    def taken(state: Column, x: Column) -> tuple[Column, Column]:
        out = x["blocked"] | (state > x["start"])
        return F.when(out, state).otherwise(x["end"]), mark(x, out)

    events = F.array_sort(F.concat(tagged(base, 0), tagged(good, 1)))
    seen = scanned(F.reverse(scanned(events, F.lit(0), onward, event)), F.lit((1 << 31) - 1), backward, event)
    own = F.filter(F.reverse(seen), lambda x: x["base"] == 1)
    free = F.filter(scanned(own, F.lit(0), taken, event), lambda x: ~x["blocked"])
    return F.transform(free, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _good(candidates_: str, expression: str, cuts: list[float]) -> Column:
    """The candidates that the trees keep."""
    limit = "array(" + ", ".join(f"{c!r}D" for c in cuts) + ")[c.kind]"
    return F.expr(f"transform(filter({candidates_}, c -> ({expression}) >= {limit}), c -> struct(c.kind as kind, c.start as start, c.end as end))")


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans: arrays of (kind, start, end) by kind and start; kind is a place in KINDS.

    Added spans do not overlap base spans or each other: of overlapping ones the earlier, then the shorter, counts.
    """
    expression, cuts = judge(docs.sparkSession)
    base, cands = _of_text(docs.sparkSession)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base).withColumn("cands", cands)
    good = found.withColumn("good", _good("cands", expression, cuts))
    added = good.withColumn("added", F.when(F.size("good") > 0, _free(F.col("base"), F.col("good"))).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return added.select("doc_id", "text", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def _joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def reported(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for each row's whole text.

    Null and empty texts have no spans; repeated rows each give a row; an empty table gives none; other columns are
    not read. The work grows with a text's length and its matches, however many there are.
    """
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return detected(docs).select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows with every span of their texts replaced by its kind in brackets, e.g. [EMAIL].

    All columns stay as they are, whatever they are called, but for text and, where present, n_chars; null texts stay
    null, repeated rows are each redacted, an empty table stays empty, and texts may be of any length.
    """
    expression, cuts = judge(docs.sparkSession)
    own = {n: f"hushgrad_{n}" for n in ("base", "cands", "order", "text")}
    base, cands = _of_text(docs.sparkSession)
    found = docs.withColumn(own["base"], base).withColumn(own["cands"], cands)
    plain = F.transform(own["base"], lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    by_start = F.array_sort(F.transform(F.concat(plain, _good(own["cands"], expression, cuts)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    found = found.withColumn(own["order"], by_start)
    has = F.size(own["order"]) > 0
    found = found.withColumn(own["text"], F.when(has, _covered(F.col("text"), F.col(own["order"]))).otherwise(F.col("text")))
    keep = [F.col(own["text"]).alias("text") if c == "text" else F.when(has, F.length(own["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return found.select(*keep)


def _covered(text: Column, order: Column) -> Column:
    """The text with sorted spans covered; overlapping ones as one, under the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    gap = "struct<from:int,to:int,kind:int>"

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(state, s["end"]), F.struct(state.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))

    gaps = F.filter(scanned(order, F.lit(0), step, gap), lambda g: g["to"] >= g["from"])

    # Places in a long text are found by counting from its start, so gaps are cut from pieces of the text.
    def joined(piece: Column) -> Column:
        begin = F.element_at(piece, 1)["from"]
        cut = F.substring(text, begin + 1, F.element_at(piece, -1)["to"] - begin)
        return bound(cut, lambda c: F.array_join(F.transform(piece, lambda g: F.concat(F.substring(c, g["from"] - begin + 1, g["to"] - g["from"]), F.element_at(names, g["kind"] + 1))), ""))

    end = F.array_max(F.transform(order, lambda s: s["end"]))
    return F.concat(F.array_join(F.transform(chunks(gaps), joined), ""), F.substring(text, end + 1, F.length(text)))
