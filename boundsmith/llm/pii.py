"""Personal data spans, in DataFrame functions only.

Four base kinds are found by pattern and checked (octets, digits, Luhn); the
patterns are written so that Java's matcher needs no recursion and no rescan, and
give the same matches as the plain ones.  Positions come from the lengths of the
matches and of what lies between them, in code points.

Beyond those, high-recall generators propose further spans (other separators,
national numbers, spelled-out addresses, IPv6), which may overlap.  A candidate is
described by ``FEATURES`` format and context bits, none of which tells the check (Luhn,
octets, digits) or the identifier words that decide labels.  Boosted trees score it; they
are fitted on counts of bit patterns over all documents, at most ``2**FEATURES`` for each
kind whatever the corpus.  Candidates that coincide with a base span of their kind are the
positive examples; those that fail their check or follow a word for an identifier
(an order, a version) are the negative ones, and are never added.  What else there is the model
decides.  The threshold of each kind is the lowest score at which ``precision`` still
holds on the examples of held-out documents, a fifth of them, taken at whole scores: equal
scores are accepted or not together.  Base spans always stay; a candidate that touches
one is left out, and of candidates that touch each other the better one stays,
from left to right.

Defined cases: a null text is an empty text without spans; rows that repeat are
answered alike; columns of other names don't matter; without examples nothing is
added; an empty table gives an empty result.  Work in a text is in proportion to its
length and spans: overlaps are found by scans of sorted spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, and patterns that match as the plain ones do.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # The maximal runs of digits with single blanks or hyphens that hold 14 to 19 digits.
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals: kind and pattern; two patterns may propose overlapping spans.
GENERATORS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]++\x20(?:dot|DOT)\x20))[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2}[\x20._/-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])3[0-9]{3}[\x20._/-]?[0-9]{6}[\x20._/-]?[0-9]{5}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])0[0-9](?:[\x20.-][0-9]{2}){4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:0[0-9]{1,4}[\x20/-][0-9]{5,9}|[2-9][0-9]{9})(?![0-9A-Za-z])"),
)
#: Words before a candidate that speak for its kind, or for an identifier.
WORDS = {
    "email": "e-?mail|contact|write|mailto|correo|courriel",
    "ip": "ip|host|server|address|adresse|client",
    "card": "card|visa|mastercard|amex|credit|tarjeta|carte|karte",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|sms|telefon",
}
OTHER_WORDS = "order|invoice|isbn|issn|serial|version|build|token|hash|sha|uuid|ref|doi|build|page"
CONTEXT = 24
FEATURES = 9
ROUNDS, RATE = 30, 0.3
PRECISION = 0.9
#: One in so many documents calibrates the thresholds instead of fitting the trees.
FOLDS = 5
_BLOCK = 256


def _scan(values: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each element of an array, in blocks so that long arrays stay cheap."""
    none = F.array().cast(f"array<{kind}>")

    def over(part: Column, first: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            state = step(acc["s"], x)
            return F.struct(state.alias("s"), F.concat(acc["a"], F.array(state)).alias("a"))

        return F.aggregate(part, F.struct(first.cast(kind).alias("s"), none.alias("a")), one)

    def joined(acc: Column, block: Column) -> Column:
        done = over(block, acc["s"])
        return F.struct(done["s"].alias("s"), F.concat(acc["a"], done["a"]).alias("a"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    whole = F.aggregate(blocks, F.struct(zero.cast(kind).alias("s"), none.alias("a")), joined)["a"]
    return F.when(F.size(values) > _BLOCK, whole).otherwise(over(values, zero)["a"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(back) - 1), F.lit(0), add) % 10 == 0


_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _guard(kind: str, wide: bool) -> Column:
    """Cheap tests that a text must pass to hold a match of the base or wide pattern."""
    text, digit = F.col("text"), F.col("digit")
    if kind == "email":
        at = text.contains("@")
        spelled = [text.contains(c) for c in ("(at)", "[at]", "(AT)", "[AT]")]
        apart = [text.contains(f" {a} ") & text.contains(f" {d} ") for a in ("at", "AT") for d in ("dot", "DOT")]
        return at | spelled[0] | spelled[1] | spelled[2] | spelled[3] | apart[0] | apart[1] | apart[2] | apart[3] if wide else at
    if kind == "ip":
        return digit & text.contains(".") | text.contains(":") & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|::") if wide else digit & text.contains(".")
    if kind == "phone" and not wide:
        return digit & text.contains("+")
    return digit


def _matched(rows: DataFrame, patterns: Sequence[tuple[str, str]], wide: bool, *keep: str) -> DataFrame:
    """For each pattern the matches ``m_`` and the lengths ``g_`` of what lies between them.

    A text without matches, most texts, isn't split.
    """
    none = F.array().cast("array<string>")
    found = [F.when(_guard(k, wide), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{n}") for n, (k, p) in enumerate(patterns)]
    rows = rows.select(*keep, *found)
    gaps = [
        F.when(F.size(f"m_{n}") > 0, F.transform(F.split("text", p, -1), F.length)).otherwise(F.array().cast("array<int>")).alias(f"g_{n}")
        for n, (_, p) in enumerate(patterns)
    ]
    return rows.select("*", *gaps)


def _placed(number: int) -> Column:
    """Structs ``start, end, value`` of a pattern's matches, in code points."""
    found, gaps = F.col(f"m_{number}"), F.col(f"g_{number}")
    lens = F.transform(found, F.length)
    n = F.size(found)
    deltas = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(F.concat(F.array(F.lit(0)), lens), F.lit(1), n), lambda g, m: g + m)
    starts = _scan(deltas, F.lit(0), "int", lambda total, x: total + x)
    spans = F.zip_with(starts, found, lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row_id, text, base`` with ``base`` an array of ``start, kind, end``, sorted."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("row_id", "text", F.col("text").rlike("[0-9]").alias("digit"))
    rows = _matched(rows, tuple(BASE.items()), False, "row_id", "text", "digit")

    def checked(n: int, k: str) -> Column:
        good = F.filter(_placed(n), lambda s: _valid(k, s["value"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    return rows.select("row_id", "text", "digit", F.sort_array(F.concat(*[checked(n, k) for n, k in enumerate(KINDS)])).alias("base"))


def _passes(name: str, value: Column) -> Column:
    """The check of a kind, for proposals too."""
    if name == "email":
        return value.rlike(r"[A-Za-z]{2,}$")
    if name == "ip":
        return F.when(value.contains(":"), value.rlike("[0-9A-Fa-f]")).otherwise(_valid(name, value))
    return _valid(name, value)


def _features(name: str, value: Column, before: Column, after: Column) -> Column:
    separators = F.size(F.array_distinct(F.split(F.regexp_replace(value, r"[0-9A-Za-z()+]", ""), "")))
    bits = [
        separators <= 1,
        value.rlike(r"^[0-9]{4}([ ._/-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{3}.[0-9]{3}.[0-9]{4}$|^\+?[0-9]*.?\([0-9]{3}\).?[0-9]{3}.[0-9]{4}$|^[^ ]*$"),
        before.rlike(rf"(?i)\b(?:{WORDS[name]})\b"),
        before.rlike(r"(?:^|[\s(\[:,;<\"'])$") & after.rlike(r"^(?:$|[\s)\],;:.>\"'!?])"),
        value.rlike(r"^[+(]|^00"),
        value.rlike(r"[A-Za-z:]"),
        value.rlike(r"^4"),
        value.rlike(r"^[356]"),
        value.rlike(r"([0-9])\1\1"),
    ]
    return sum((F.coalesce(b, F.lit(False)).cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))


_EVENT = "struct<start:int,kind:int,end:int,given:boolean,bits:int,good:boolean>"
_ENDS, _NEXTS = ([f"{n}{k}" for k in range(len(KINDS))] for n in "en")
_FAR = 2**31 - 1


def _with_meetings(events: Column) -> Column:
    """Candidates of sorted ``events``, base spans among them, with ``same`` and ``meets``.

    One scan carries the largest end of each kind's base spans so far, one from the
    right their next start.
    """

    def ends(state: Column, e: Column) -> Column:
        return F.struct(*[F.when(e["given"] & (e["kind"] == k), F.greatest(state[n], e["end"])).otherwise(state[n]).alias(n) for k, n in enumerate(_ENDS)])

    def nexts(state: Column, e: Column) -> Column:
        return F.struct(*[F.when(e["given"] & (e["kind"] == k), e["start"]).otherwise(state[n]).alias(n) for k, n in enumerate(_NEXTS)])

    shape = lambda names: f"struct<{','.join(f'{n}:int' for n in names)}>"
    start = lambda names, v: F.struct(*[F.lit(v).alias(n) for n in names])
    left = _scan(events, start(_ENDS, -1), shape(_ENDS), ends)
    right = F.reverse(_scan(F.reverse(events), start(_NEXTS, _FAR), shape(_NEXTS), nexts))
    both = F.arrays_zip(events.alias("e"), left.alias("l"), right.alias("r"))

    def told(x: Column) -> Column:
        e = x["e"]
        touch = [(x["l"][a] > e["start"]) | (x["r"][b] < e["end"]) for a, b in zip(_ENDS, _NEXTS, strict=True)]
        same = F.lit(False)
        for k, t in enumerate(touch):
            same = F.when(e["kind"] == k, t).otherwise(same)
        any_ = touch[0] | touch[1] | touch[2] | touch[3]
        label = F.when(~e["good"], 0).when(same, 1)
        return F.struct(e["start"].alias("start"), e["kind"].alias("kind"), e["end"].alias("end"), e["bits"].alias("bits"), label.alias("label"), any_.alias("meets"))

    return F.transform(F.filter(both, lambda x: ~x["e"]["given"]), told)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, base, found, held_out`` for each row: base spans, and described candidates.

    Holds no text; write it once, then :func:`fit` and :func:`find_spans` read it.
    """
    rows = _matched(_base(docs, id_col, text_col), GENERATORS, True, "row_id", "text", "base")

    def proposed(number: int, k: str) -> Column:
        n = KINDS.index(k)

        def described(s: Column) -> Column:
            before = F.substring(F.col("text"), F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
            after = F.substring(F.col("text"), s["end"] + 1, F.lit(1))
            good = _passes(k, s["value"]) & ~before.rlike(rf"(?i)\b(?:{OTHER_WORDS})\b")
            return F.struct(
                s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), F.lit(False).alias("given"),
                _features(k, s["value"], before, after).alias("bits"), good.alias("good"),
            ).cast(_EVENT)

        return F.transform(_placed(number), described)

    given = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(True).alias("given"), F.lit(0).alias("bits"), F.lit(True).alias("good")).cast(_EVENT))
    rows = rows.select("row_id", "base", (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).alias("held_out"), F.concat(*[proposed(n, k) for n, (k, _) in enumerate(GENERATORS)]).alias("found"), given.alias("given"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,bits:int,label:int,meets:boolean>>")
    rows = rows.select("row_id", "base", "held_out", F.when(F.size("found") > 0, F.sort_array(F.concat("found", "given"))).alias("events"))
    return rows.select("row_id", "base", "held_out", F.when(F.col("events").isNotNull(), _with_meetings(F.col("events"))).otherwise(none).alias("found"))


@dataclass(frozen=True)
class Model:
    """Trees as ``(first bit, second bit, four leaf values)``, and each kind's prior and threshold."""

    priors: tuple[float, ...]
    trees: tuple[tuple[tuple[int, int, tuple[float, float, float, float]], ...], ...]
    thresholds: tuple[float, ...]

    def score(self, kind: int, bits: int) -> float:
        return self.priors[kind] + sum(leaf[(bits >> i & 1) * 2 + (bits >> j & 1)] for i, j, leaf in self.trees[kind])

    def accepted(self, kind: int) -> dict[int, float]:
        scores = {bits: self.score(kind, bits) for bits in range(1 << FEATURES)}
        return {bits: s for bits, s in scores.items() if s >= self.thresholds[kind]}


Counts = dict[int, tuple[int, int]]


def boost(counts: Counts, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, tuple]:
    """Prior and trees by gradient boosting with logistic loss on ``bits -> (negative, positive)`` counts.

    Each tree asks two bits; of all pairs the one with the largest Newton gain wins.
    """
    neg, pos = sum(n for n, _ in counts.values()), sum(p for _, p in counts.values())
    prior = math.log((pos + 1) / (neg + 1))
    value = dict.fromkeys(sorted(counts), prior)
    trees = []
    for _ in range(rounds if neg and pos else 0):
        slope = {}
        for bits in value:
            n, p = counts[bits]
            q = 1 / (1 + math.exp(-value[bits]))
            slope[bits] = (p - (n + p) * q, (n + p) * q * (1 - q))
        top = None
        for i in range(FEATURES):
            for j in range(i + 1, FEATURES):
                g, h = [0.0] * 4, [1.0] * 4  # a unit of ridge in each leaf
                for bits, (s, c) in slope.items():
                    leaf = (bits >> i & 1) * 2 + (bits >> j & 1)
                    g[leaf] += s
                    h[leaf] += c
                gain = sum(a * a / b for a, b in zip(g, h, strict=True))
                if top is None or gain > top[0]:
                    top = (gain, i, j, tuple(rate * a / b for a, b in zip(g, h, strict=True)))
        _, i, j, leaf = top
        trees.append((i, j, leaf))
        for bits in value:
            value[bits] += leaf[(bits >> i & 1) * 2 + (bits >> j & 1)]
    return prior, tuple(trees)


def calibrated(score: Callable[[int], float], counts: Counts, precision: float = PRECISION) -> float:
    """The lowest score at which those with at least that score are positive often enough.

    Scores are taken as a whole: equal ones count together.  An example of each class
    is added, so that few examples don't calibrate anything.
    """
    by_score: dict[float, list[int]] = {}
    for bits, (n, p) in counts.items():
        both = by_score.setdefault(round(score(bits), 9), [0, 0])
        both[0] += n
        both[1] += p
    threshold, n_sum, p_sum = math.inf, 0, 0
    for value in sorted(by_score, reverse=True):
        n_sum, p_sum = n_sum + by_score[value][0], p_sum + by_score[value][1]
        if (p_sum + 1) / (n_sum + p_sum + 2) >= precision:
            threshold = value - 1e-9
    return threshold


def fit(described: DataFrame, precision: float = PRECISION) -> Model:
    """Fit on the candidates of all documents; only counts of bit patterns reach the driver."""
    found = described.select("held_out", F.explode("found").alias("c")).where("c.label is not null")
    rows = found.groupBy("c.kind", "held_out", "c.bits").agg(F.sum(1 - F.col("c.label")).alias("n"), F.sum("c.label").alias("p")).collect()
    fitted, thresholds = [], []
    for kind in range(len(KINDS)):
        parts = [{r.bits: (r.n, r.p) for r in rows if r.kind == kind and r.held_out == held} for held in (False, True)]
        fitted.append(boost(parts[0]))
        one = Model((fitted[-1][0],), (fitted[-1][1],), (math.inf,))
        thresholds.append(calibrated(lambda bits, m=one: m.score(0, bits), parts[1], precision))
    return Model(tuple(p for p, _ in fitted), tuple(t for _, t in fitted), tuple(thresholds))


def find_spans(described: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col, base, spans``: arrays of ``start, kind, end``, ``kind`` by ``KINDS``."""
    known = [model.accepted(kind) for kind in range(len(KINDS))]
    if not any(known):
        return described.select(F.col("row_id").alias(id_col), "base", F.col("base").alias("spans"))
    scores = F.array(*[F.lit(known[kind].get(bits)).cast("double") for kind in range(len(KINDS)) for bits in range(1 << FEATURES)])
    of = lambda c: F.element_at(scores, c["kind"] * (1 << FEATURES) + c["bits"] + 1)
    free = F.transform(
        F.filter("found", lambda c: ~c["meets"] & c["label"].isNull() & of(c).isNotNull()),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), of(c).alias("score")),
    )
    rows = described.select("row_id", "base", F.sort_array(free).alias("free"))
    shape = "struct<start:int,kind:int,end:int,score:double>"

    def step(last: Column, c: Column) -> Column:
        """The span that stands after ``c``: a better one replaces what it touches."""
        stays = (c["start"] < last["end"]) & (c["score"] <= last["score"])
        return F.when(stays, last).otherwise(c)

    zero = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("kind"), F.lit(-1).alias("end"), F.lit(0.0).alias("score"))
    standing = _scan(F.col("free"), zero, shape, step)
    # A span is final where the next one that stands doesn't touch it.
    after = F.concat(F.slice(standing, 2, F.greatest(F.size(standing) - 1, F.lit(0))), F.array(F.lit(None).cast(shape)))
    final = F.filter(F.arrays_zip(standing.alias("s"), after.alias("n")), lambda x: x["n"].isNull() | (x["n"]["start"] >= x["s"]["end"]))
    added = F.transform(final, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))
    spans = F.when(F.size("free") > 0, F.sort_array(F.concat("base", added))).otherwise(F.col("base"))
    return rows.select(F.col("row_id").alias(id_col), "base", spans.alias("spans"))


def as_string(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
