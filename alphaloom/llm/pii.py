"""Personal data with DataFrame functions only: rules, generators, and boosted trees that choose among candidates.

Base rules find e-mail addresses, IPv4 addresses, payment cards (16 to 19 digits, Luhn) and phone
numbers (+, 8 to 15 digits); their spans always stay. High-recall generators propose further,
overlapping spans: obfuscated addresses, numbers without "+", short cards, IPv6, national id and
account numbers, and secrets such as tokens. Each candidate is described by format features (digits,
separators, a mark of its kind, whether its own checksum or form is sound) and context features (what
touches it, words before it that speak for or against). Per kind, gradient-boosted trees of depth two
are fitted to the labelled candidates of ``pii_examples``, which hold every kind, sound and unsound, in
good, neutral and misleading contexts; the kind's threshold is calibrated to a precision of PRECISION on
contexts and made values that the trees have not seen. The examples, some thousand rows, are a fixed bound, so the
model does not depend on the input or its size. The trees become SQL expressions. Selected candidates
that overlap a base span, or a better selected neighbour, are dropped.

The patterns are written so that no text makes them slow: a run of characters is tried from its
first position only, and repeated groups do not backtrack. Positions come from the lengths of the
matches and of the texts between them, summed up in a logarithmic number of array passes. Spans and
redacted text come from the row itself, so nothing is joined or shuffled.

Defined cases: a null text is empty for ``find`` and stays null for ``redact``; an empty text has no spans;
repeated rows are judged alike, each by itself; a null doc_id stays as it is; other columns are ignored
by ``find`` and passed through by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import table
from alphaloom.llm.pii_examples import labelled

KINDS = ["email", "ip", "card", "phone", "id", "iban", "secret"]
PRECISION, TREES, RATE = 0.98, 12, 0.3
#: Running sums take passes of this fan, enough for the longest array there is (2**31 matches of one text).
_SCAN, _FAN = 31, 128

#: The rules' patterns; those in the comment match the same spans, but can be slow or overflow the stack.
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be tried.
BASE_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Generators: kind, what a text must hold, pattern.
MORE = [
    ("email", r"(?i)[(\[{<]\x20?(?:at|dot)\x20?[)\]}>]|\x20dot\x20", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?|\x20at\x20|@)[a-z0-9-]{1,63}+(?:(?:\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}+){1,5}+"),
    ("phone", r"[0-9](?:[\x20./-]|\)\x20?)[0-9]", r"(?<![0-9A-Za-z.+/-])(?<!\+[0-9]\x20|\+[0-9]{2}\x20)(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}(?:[\x20.-]?[0-9]{2,4}){1,3}+(?![0-9A-Za-z])"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9A-Za-z.-])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{4,5}|[0-9]{13,19}+)(?![0-9A-Za-z])"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f:]", r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,40}[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"),
    ("id", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("secret", r"[A-Za-z0-9+/_-]{20}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"),
]
_FOR = r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|number\x20is|mail|e-mail|email|contact|reach|write|card|visa|mastercard|amex|account|iban|ssn|social|ip|address|host|server|telefon|anruf|konto|karte|tarjeta|llame|carte|appel)\b"
_AGAINST = r"(?i)\b(?:order|invoice|isbn|issn|version|ref|reference|page|pages|token|hash|key|sku|item|serial|total|price|rfc|doi)\b|[=$#]\s*\"?$"
_SECRET = r"(?i)(?:token|secret|key|passwd|password|pwd|auth|authorization|bearer|credentials?)\b\W{0,6}$"
_NO_SECRET = r"(?i)\b(?:commit|sha-?[0-9]*|checksum|md5|file|build|etag|revision|digest|uuid|blob|hash|version|path|url)\b|[/.]$"
#: A mark of the kind in the match itself.
_MARKS = {"secret": r"^(?:sk|pk|rk)_|^gh[a-z]_|^xox|^AKIA|^AIza|^eyJ", "ip": "[A-Fa-f]"}
_MARK = r"^[+(]|@|\bat\b"
FEATURES = ["digits", "seps", "valid", "touches", "for", "against", "mark"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op: Callable[[list[Column]], Column], left: bool = True) -> Column:
    """Running ``op`` of an array (from the right if not ``left``): each pass takes _FAN partial results together, and small arrays skip passes."""

    def passes(a: Column, width: int) -> Column:
        if width >= 1 << _SCAN:
            return a

        def step(own: Column, i: Column) -> Column:
            if _FAN <= 16:  # written out: fewer levels of lambdas, but larger expressions
                return op([F.get(a, i - j * width if left else F.try_add(i, F.lit(j * width))) for j in range(_FAN) if j * width < 1 << 31])
            room = i if left else F.size(a) - 1 - i
            more = F.sequence(F.lit(1), F.least(F.floor(room / width).cast("int"), F.lit(_FAN - 1)))
            return F.when(room < width, own).otherwise(F.aggregate(more, own, lambda sum_, j: op([sum_, F.get(a, i - j * width if left else i + j * width)])))

        return F.when(F.size(a) <= width, a).otherwise(_let(F.transform(a, step), lambda b: passes(b, width * _FAN)))

    return _let(values, lambda a: passes(a, 1))


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out + F.coalesce(x, F.lit(0))
    return out


def _found(text: Column, needs: str, pattern: str) -> Column:
    """Matches of ``pattern``: start, stop, match, and some of the text before and after each."""

    def spans(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
            return _let(_running(lengths, _total), lambda ends: F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("stop"), m.alias("match"), F.right(F.get(gaps, i), F.lit(28)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(3)).alias("after"))))

        return _let(F.split(text, pattern, -1), placed)

    none = F.array().cast("array<struct<start:int,stop:int,match:string,before:string,after:string>>")
    return F.when(F.rlike(text, F.lit(needs)), _let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m)))).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weight(c: Column, i: Column) -> Column:
        v = c.cast("int") * (i % 2 + 1)
        return F.when(v > 9, v - 9).otherwise(v)

    ones = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(ones, weight), F.lit(0), lambda s, v: s + v) % 10 == 0


def _mod97(text: Column) -> Column:
    """The check of account numbers: letters count as 10 to 35, the first four characters go last."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    value = F.transform(F.filter(turned, lambda c: c != ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda s, v: F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97) == 1


def _accepted(kind: str, match: Column) -> Column:
    """A base rule's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15)


def _plausible(kind: str, match: Column) -> Column:
    """A generator's own check."""
    digits = _digits(match)
    if kind == "email":
        return F.rlike(match, F.lit(r"(?i)[a-z]{2,12}$")) & ~F.rlike(match, F.lit(r"(?i)^(?:the|is|was|are|look|be|meet|a|an|in)\x20at\x20"))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits) & (digits != F.repeat(F.left(digits, F.lit(1)), F.length(digits)))).otherwise(F.lit(False))
    if kind == "id":
        return ~F.rlike(match, F.lit("^(?:000|666|9)|-00-|-0000$"))
    if kind == "iban":
        return F.coalesce(_mod97(match), F.lit(False))
    if kind == "ip":
        return (F.regexp_count(match, F.lit(":")) == 7) | F.rlike(match, F.lit("::")) & F.rlike(match, F.lit("[0-9]")) & (F.regexp_count(match, F.lit(":")) < 8)
    return F.rlike(match, F.lit("[0-9]")) & F.rlike(match, F.lit("[A-Za-z]"))


def _described(kind: str, x: Column) -> Column:
    """Features and place of a candidate."""
    match = x["match"]
    number = F.length(_digits(match))
    bucket = F.when(number < 4, 0).when(number < 8, 1).when(number < 12, 2).when(number < 16, 3).otherwise(4)
    touches = F.rlike(x["before"], F.lit(r"[\p{L}0-9_.@/-]$")).cast("int") + F.rlike(x["after"], F.lit(r"^[\p{L}0-9_@/]")).cast("int")
    speaks, denies = (_SECRET, _NO_SECRET) if kind == "secret" else (_FOR, _AGAINST)
    return F.struct(
        bucket.alias("digits"),
        F.least(F.length(F.regexp_replace(match, "[^ ()./:-]", "")), F.lit(4)).alias("seps"),
        _plausible(kind, match).cast("int").alias("valid"),
        touches.alias("touches"),
        F.rlike(x["before"], F.lit(speaks)).cast("int").alias("for"),
        F.rlike(x["before"], F.lit(denies)).cast("int").alias("against"),
        F.rlike(match, F.lit(_MARKS.get(kind, _MARK))).cast("int").alias("mark"),
        x["start"].alias("start"),
        x["stop"].alias("stop"),
    )


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["stop"].alias("stop"))


def _kept(column: str, kind: str) -> Column:
    """Base spans: the matches that pass the rule's check."""
    return F.transform(F.filter(column, lambda x: _accepted(kind, x["match"])), _span)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one kind: (feature, cut, feature, cut, four leaf values), and a threshold on the score."""

    bias: float
    trees: list[tuple[int, int, int, int, list[float]]]
    threshold: float

    def score(self, field: Callable[[str], Column]) -> Column:
        total = F.lit(self.bias)
        for a, cut_a, b, cut_b, leaf in self.trees:
            low_a, low_b = field(FEATURES[a]) <= cut_a, field(FEATURES[b]) <= cut_b
            total = total + F.when(low_a & low_b, leaf[0]).when(low_a, leaf[1]).when(low_b, leaf[2]).otherwise(leaf[3])
        return total

    def value(self, x: tuple) -> float:
        return self.bias + sum(leaf[2 * (x[a] > ca) + (x[b] > cb)] for a, ca, b, cb, leaf in self.trees)


def described_examples(spark: SparkSession, examples: list[tuple] | None = None) -> DataFrame:
    """Per candidate of the labelled texts: kind, the features, label, held."""
    rows = spark.createDataFrame(labelled() if examples is None else examples, "n long, kind string, text string, first int, stop int, good int, held int")
    parts = []
    for kind, needs, pattern in MORE:
        found = rows.where(F.col("kind") == kind).select("first", "stop", "good", "held", F.explode(F.transform(_found(F.col("text"), needs, pattern), partial(_described, kind))).alias("c"))
        label = F.when((F.col("c.start") < F.col("stop")) & (F.col("c.stop") > F.col("first")), F.col("good")).otherwise(F.lit(0))
        parts.append(found.select(F.lit(kind).alias("kind"), *(F.col(f"c.{f}").alias(f) for f in FEATURES), label.alias("label"), "held"))
    return reduce(DataFrame.unionByName, parts)


def boost(train: list[tuple[tuple, int, int]]) -> Trees:
    """Trees for (features, label, count) rows, without a threshold."""
    good, total = sum(n for _, y, n in train if y), sum(n for _, _, n in train)
    bias = math.log((good + 0.5) / (total - good + 0.5))
    score = [bias] * len(train)
    cuts = [(f, v) for f in range(len(FEATURES)) for v in sorted({x[f] for x, _, _ in train})[:-1]] or [(0, 0)]
    trees = []
    for _ in range(TREES):
        grads = [(n * (y - 1 / (1 + math.exp(-s))), n * (p := 1 / (1 + math.exp(-s))) * (1 - p)) for (_, y, n), s in zip(train, score)]
        best = None
        for i, (a, ca) in enumerate(cuts):
            for b, cb in cuts[i:]:
                sums = [[0.0, 1.0] for _ in range(4)]
                for (x, _, _), (g, h) in zip(train, grads):
                    cell = sums[2 * (x[a] > ca) + (x[b] > cb)]
                    cell[0] += g
                    cell[1] += h
                gain = sum(g * g / h for g, h in sums)
                if best is None or gain > best[0]:
                    best = (gain, a, ca, b, cb, [RATE * g / h for g, h in sums])
        _, a, ca, b, cb, leaf = best
        trees.append((a, ca, b, cb, leaf))
        score = [s + leaf[2 * (x[a] > ca) + (x[b] > cb)] for (x, _, _), s in zip(train, score)]
    return Trees(bias, trees, math.inf)


def calibrated(model: Trees, held: list[tuple[tuple, int, int]]) -> Trees:
    """``model`` with the lowest threshold from zero whose selection of the held-out rows is precise enough; equal scores are taken together."""
    groups: dict[float, list[int]] = {}
    for x, y, n in held:
        cell = groups.setdefault(round(model.value(x), 9), [0, 0])
        cell[0] += n * y
        cell[1] += n
    threshold, right, chosen = math.inf, 0, 0
    for s in sorted(groups, reverse=True):
        right, chosen = right + groups[s][0], chosen + groups[s][1]
        if s >= 0 and right >= PRECISION * chosen:
            threshold = s - 1e-6
    return Trees(model.bias, model.trees, threshold)


_FITTED: dict[str, Trees] = {}


def fit(spark: SparkSession) -> dict[str, Trees]:
    """Per kind its trees and threshold. The labelled set is fixed, so they are fitted once in a driver's life; only counts of equal feature rows reach it."""
    if not _FITTED:
        rows = described_examples(spark).groupBy("kind", *FEATURES, "label", "held").count().collect()
        for kind in dict.fromkeys(k for k, _, _ in MORE):
            mine = [(r["held"], (tuple(r[f] for f in FEATURES), r["label"], r["count"])) for r in sorted(rows, key=str) if r["kind"] == kind]
            _FITTED[kind] = calibrated(boost([x for held, x in mine if not held]), [x for held, x in mine if held])
    return _FITTED


def _select(model: dict[str, Trees]) -> Column:
    """All spans of a row with columns base_<kind> and text: base spans and selected candidates, by kind and start."""
    whole = "array<struct<kind:int,start:int,stop:int,base:int,score:double>>"

    def held(n: int, kind: str) -> Column:
        return F.transform(f"base_{kind}", lambda x: F.struct(F.lit(n).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(1).alias("base"), F.lit(0.0).alias("score")))

    base = F.concat(*(held(n, k) for n, k in enumerate(BASE))).cast(whole)
    base = F.when(F.size(base) == 0, F.array().cast(whole)).otherwise(base)
    chosen = F.concat(F.array().cast(whole), *(F.col(f"more_{n}") for n, (kind, _, _) in enumerate(MORE) if not math.isinf(model[kind].threshold)))

    def ordered(a: Column) -> Column:
        return F.array_sort(a, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["stop"] != y["stop"], y["stop"] - x["stop"]).otherwise(y["base"] - x["base"]))

    def merged(all_: Column) -> Column:
        ends = _running(F.transform(all_, lambda x: F.when(x["base"] == 1, x["stop"]).otherwise(F.lit(-1))), lambda parts: F.greatest(*parts))
        begins = _running(F.transform(all_, lambda x: F.when(x["base"] == 1, x["start"]).otherwise(F.lit(2**31 - 1))), lambda parts: F.least(*parts), left=False)
        free = _let(ends, lambda e: _let(begins, lambda b: F.filter(all_, lambda x, i: (x["base"] == 0) & (F.get(e, i) <= x["start"]) & (F.get(b, i) >= x["stop"]))))

        def apart(f: Column) -> Column:
            # of overlapping neighbours the better one stays, the earlier one if they are equal
            def beaten(x: Column, i: Column) -> Column:
                p, q = F.get(f, i - 1), F.get(f, i + 1)
                return F.coalesce((p["stop"] > x["start"]) & (p["score"] >= x["score"]), F.lit(False)) | F.coalesce((q["start"] < x["stop"]) & (q["score"] > x["score"]), F.lit(False))

            return F.filter(f, lambda x, i: ~beaten(x, i))

        return _let(free, apart)

    both = _let(base, lambda b: _let(chosen, lambda c: F.when(F.size(c) == 0, b).otherwise(F.concat(b, _let(ordered(F.concat(b, c)), merged)))))
    plain = F.transform(both, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return F.array_sort(plain)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _passes(threshold: float, c: Column) -> Column:
    return c["score"] >= threshold


def _with_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with columns base_<kind> and found, worked out in the row itself; the text is in _text."""
    model = fit(spark)
    text = F.col("_text")
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))

    def chosen(kind: str, number: int) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            scored = lambda f: F.struct(F.lit(number).alias("kind"), f["start"].alias("start"), f["stop"].alias("stop"), F.lit(0).alias("base"), model[kind].score(lambda name: f[name]).alias("score"))
            return _let(_described(kind, x), scored)

        return one

    columns = {f"all_{kind}": _found(text, BASE_NEEDS[kind], BASE[kind]) for kind in BASE}
    for n, (kind, needs, pattern) in enumerate(MORE):
        scored = F.transform(_found(text, needs, pattern), chosen(kind, KINDS.index(kind)))
        columns[f"more_{n}"] = F.filter(scored, partial(_passes, min(model[kind].threshold, 1e9)))
    out = out.withColumns(columns)
    out = out.withColumns({f"base_{kind}": _kept(f"all_{kind}", kind) for kind in BASE})
    return out.withColumn("found", _select(model))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and spans as structs (found)."""

    def held(n: int, kind: str) -> Column:
        return F.transform(f"base_{kind}", lambda x: F.struct(F.lit(n).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))

    base = F.concat(*(held(n, k) for n, k in enumerate(BASE)))
    out = _with_spans(spark, docs.select("doc_id", "text"))
    return out.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "found")


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; all columns stay, n_chars follows the text."""
    # the columns as they are travel in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").cast("string").alias("text"))
    order = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def pieces(s: Column) -> Column:
        # overlapping base spans of different kinds (a card inside a phone) become one gap
        stops = _running(F.transform(s, lambda x: x["stop"]), lambda parts: F.greatest(*parts))
        return _let(stops, lambda e: F.concat(
            F.flatten(F.transform(s, lambda x, i: _let(F.coalesce(F.get(e, i - 1), F.lit(0)), lambda p: F.when(p > x["start"], F.array(F.lit(""))).otherwise(F.array(F.substr("_text", p + 1, x["start"] - p), F.get(names, x["kind"])))))),
            F.array(F.substr("_text", F.element_at(e, -1) + 1)),
        ))

    clean = F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(_let(order, pieces), ""))
    out = _with_spans(spark, rows).select("_doc", clean.alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed = ~F.col("_clean").eqNullSafe(F.col("_doc.text"))
        new["n_chars"] = F.when(changed, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return out.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, table(spark, sf_dir, "documents")).drop("found")
