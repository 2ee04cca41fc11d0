"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

Candidates are the base spans (strict patterns with their checks) and looser spans: numbers that look like phone numbers, card numbers
glued to other digits, masked addresses.  Five labelers vote 1, 0 or -1 on each.  Expectation-maximisation over the vote
patterns estimates how reliable each labeler is per kind, without labels; a logistic span classifier is then trained on the
posteriors and keeps the looser spans it scores at 0.5 or more.  Base spans always stay.

Only DataFrame functions run on the texts.  What the fit sees is one row per pattern of votes and features, of which
there are at most ``PATTERNS`` however large the corpus is; the few numbers of the model are fitted on the driver and come back as literals.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import once
from gapwise.scale import durable

KINDS = ["email", "ip", "card", "phone"]
# fixed patterns; possessive forms and starts at the head of a run match the same spans in linear time and constant stack
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without this has no base span of the kind
NEEDS = {"email": "@[A-Za-z0-9-]++[.]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-]?)[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z-])",
}
LOOSE_NEEDS = {"email": r"[\[(]at[\])]", "card": r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}", "phone": "[0-9]{4}"}
# fixed: gazetteers (top-level domains, issuer prefixes, special address ranges, calling codes) and context words
DOMAINS = "com org net edu gov mil int info biz io ai app dev co me tv de fr es it nl be ch at pl pt se no fi dk cz ie uk eu us ca au nz jp cn kr in br mx ru example"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35|62)"
SPECIAL = r"^0*(?:0|127|255|22[4-9]|23[0-9])\."
CALLING = r"^\+?(?:1[^0-9]*[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
FOR = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|courriel|correo|an|to)[\s:<]*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr|adresse|from)[\s:=]*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)[^0-9]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp|sms)[^0-9]{0,8}$",
}
AGAINST = r"(?i)(?:order|invoice|isbn|issn|ticket|serial|sku|version|\bv|\bid|\bno|number|code|=|#|€|\$)[\s.:#]*$"
CONTEXT = 24
LABELERS = ["pattern", "check", "gazetteer", "context", "shape"]
FEATURES = ["long", "marks"]
#: kinds x votes x features
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 2 ** len(FEATURES)
ROUNDS, STEPS = 25, 300


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def is_card(text: Column) -> Column:
    return once(digits(text), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def valid(kind: str, text: Column) -> Column:
    """Checks that a base match must pass."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
        return text.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "card":
        return is_card(text)
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


_NONE = "array<struct<k:int,start:int,end:int,loose:boolean>>"


def _spans(text: Column, kind: str, pattern: str, needs: str, keep: Callable[[Column], Column], loose: bool) -> Column:
    """Spans of the matches that ``keep`` accepts: offsets follow from the lengths of matches and of the text between."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        hit = F.coalesce(piece["hit"], F.lit(""))
        span = F.struct(F.lit(KINDS.index(kind)).alias("k"), start.alias("start"), (start + F.length(hit)).alias("end"), F.lit(loose).alias("loose"))
        found = F.when((hit != "") & keep(hit), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((start + F.length(hit)).alias("at"), found.alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("found"))
    return F.when(text.rlike(needs), F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> Column:
    """Base spans by kind, then start; offsets in code points, end exclusive."""
    return F.concat(*[_spans(text, k, BASE[k], NEEDS[k], lambda hit, k=k: valid(k, hit), False) for k in KINDS])


def loose_spans(text: Column) -> Column:
    return F.concat(*[_spans(text, k, LOOSE[k], LOOSE_NEEDS[k], lambda hit: F.lit(True), True) for k in LOOSE])


def candidate_spans(text: Column) -> Column:
    """Base spans, and looser spans that overlap none of them, each with its text and what stands around it."""
    apart = lambda x, base: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    every = once(base_spans(text), lambda base: F.concat(base, F.filter(loose_spans(text), lambda x: apart(x, base))))
    return F.transform(
        every,
        lambda x: F.struct(
            x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["loose"].alias("loose"),
            F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("text"),
            F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT))).alias("before"),
            F.substring(text, x["end"] + 1, F.lit(1)).alias("after"),
        ),
    )


def votes(span: Column) -> dict[str, Column]:
    """Vote of each labeler on a candidate: 1 personal data, -1 not, 0 no opinion."""
    text, before = span["text"], span["before"]
    number = digits(text)
    by = lambda of: F.element_at(F.array(*[of(k) for k in KINDS]), span["k"] + 1)
    sign = lambda yes: F.when(yes, 1).otherwise(-1)
    domain = F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1))
    check = {
        "email": F.length(text) <= 254, "ip": F.lit(True), "card": is_card(text), "phone": F.length(number).between(10, 13),
    }
    listed = {
        "email": domain.isin(DOMAINS.split()), "ip": ~text.rlike(SPECIAL), "card": number.rlike(ISSUERS), "phone": text.rlike(CALLING) & F.startswith(text, F.lit("+")),
    }
    return {
        "pattern": F.when(span["loose"], 0).otherwise(1),
        "check": by(lambda k: sign(check[k])),
        "gazetteer": by(lambda k: sign(listed[k])),
        "context": F.when(before.rlike(AGAINST), -1).when(by(lambda k: before.rlike(FOR[k])), 1).otherwise(0),
        "shape": F.when(before.rlike(r"[A-Za-z0-9_@/]$") | span["after"].rlike(r"[A-Za-z0-9_@/]"), -1).otherwise(1),
    }


def features(span: Column) -> dict[str, Column]:
    return {"long": (F.length(span["text"]) > 12).cast("int"), "marks": span["text"].rlike(r"[^A-Za-z0-9]").cast("int")}


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier per kind, in the order intercept, votes, features."""

    weights: dict[str, list[float]]
    reliability: dict[str, dict[str, float]]

    def score(self, span: Column) -> Column:
        inputs = [F.lit(1), *votes(span).values(), *features(span).values()]
        by_kind = F.array(*[F.array(*[F.lit(float(w)) for w in self.weights[k]]) for k in KINDS])
        w = F.element_at(by_kind, span["k"] + 1)
        z = sum((F.element_at(w, i + 1) * x for i, x in enumerate(inputs)), F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _posteriors(patterns: list[tuple[list[int], float]]) -> tuple[list[float], dict[str, float]]:
    """EM for a two-class model in which labelers vote independently given the class; patterns are votes and counts.

    The pattern labeler is taken as 95 % right at the start, which fixes which class is which.  Sums are smoothed by 1.
    """
    total = sum(n for _, n in patterns)
    p = [0.95 if v[0] == 1 else 0.3 for v, _ in patterns]
    chance: list[list[dict[int, float]]] = []
    for _ in range(ROUNDS):
        prior = (sum(q * n for q, (_, n) in zip(p, patterns, strict=True)) + 1) / (total + 2)
        chance = []
        for j in range(len(LABELERS)):
            sides = []
            for side in (1, 0):
                of = {v: 1.0 for v in (-1, 0, 1)}
                for q, (v, n) in zip(p, patterns, strict=True):
                    of[v[j]] += n * (q if side else 1 - q)
                whole = sum(of.values())
                sides.append({v: x / whole for v, x in of.items()})
            chance.append(sides)
        for i, (v, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][0][x] / chance[j][1][x]) for j, x in enumerate(v))
            p[i] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    right = {name: chance[j][0][1] / (chance[j][0][1] + chance[j][1][1]) for j, name in enumerate(LABELERS)}
    return p, right


def _logistic(rows: list[tuple[list[float], float, float]]) -> list[float]:
    """Weights of a ridge logistic regression on inputs, soft label and count, by gradient steps."""
    total = sum(n for _, _, n in rows)
    w = [0.0] * len(rows[0][0])
    for _ in range(STEPS):
        slope = [0.001 * x for x in w]
        for x, y, n in rows:
            z = max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x, strict=True))))
            off = (1 / (1 + math.exp(-z)) - y) * n / total
            for i, a in enumerate(x):
                slope[i] += off * a
        w = [a - 1.0 * s for a, s in zip(w, slope, strict=True)]
    return w


def fit(found: DataFrame, spans_col: str = "spans") -> Model:
    """Reliabilities and span classifier from the candidates of all rows; a kind without candidates scores 0.5 or less."""
    one = found.select(F.explode(spans_col).alias("span")).select(F.col("span.k").alias("k"), *[
        c.cast("int").alias(name) for name, c in {**votes(F.col("span")), **features(F.col("span"))}.items()
    ])
    counts = one.groupBy("k", *LABELERS, *FEATURES).count().collect()  # at most PATTERNS rows
    weights, reliability = {}, {}
    for k, kind in enumerate(KINDS):
        rows = sorted(([r[c] for c in LABELERS], [r[c] for c in FEATURES], float(r["count"])) for r in counts if r["k"] == k)
        if not rows:
            weights[kind], reliability[kind] = [-1.0] + [0.0] * (len(LABELERS) + len(FEATURES)), {}
            continue
        p, reliability[kind] = _posteriors([(v, n) for v, _, n in rows])
        weights[kind] = _logistic([([1.0, *map(float, v), *map(float, f)], q, n) for q, (v, f, n) in zip(p, rows, strict=True)])
    return Model(weights, reliability)


def _accepted(model: Model, spans: Column) -> Column:
    """Base spans and the looser ones that the model keeps, by kind, then start."""
    kept = F.filter(spans, lambda x: ~x["loose"] | (model.score(x) >= 0.5))
    return F.sort_array(F.transform(kept, lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``base`` and ``spans`` (arrays of kind number, start, end; by kind, then start).

    Null and blank texts have no spans.  Repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = durable(docs.select(F.col(id_col).alias(id_col), candidate_spans(text).alias("spans")))
    model = fit(found)
    bare = F.transform(F.filter("spans", lambda x: ~x["loose"]), lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select(id_col, bare.alias("base"), _accepted(model, F.col("spans")).alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["start"], x["end"])), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, digest of the base listing, listing of all spans."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    of = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(id_col, *of, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with each span (overlapping ones as one) replaced by its kind in brackets.

    ``length_col``, if the input has it, becomes the new number of code points.  A null text stays null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    model = fit(durable(docs.select(candidate_spans(text).alias("spans"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        parts = F.when(x["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.element_at(names, x["k"] + 1)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), parts.alias("parts"))

    def masked(spans: Column) -> Column:
        ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
        return F.aggregate(ordered, start, step, end)

    clean = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(
        once(_accepted(model, candidate_spans(text)), lambda spans: F.when(F.size(spans) > 0, masked(spans)).otherwise(text))
    )
    out = docs.withColumn(text_col, clean)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
