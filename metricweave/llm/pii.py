"""Personal data: weak labelers vote, EM weighs them, a classifier keeps spans.

Strict patterns give the base spans, which always stay. Looser patterns give
further candidates. On every candidate a regex, a gazetteer, a context and a
format labeler vote, or abstain; expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, and a logistic classifier, fitted to
the resulting probabilities, decides the candidates that are not base spans. It sees
the votes and what no labeler looks at: length, separators, groups of digits, and the
characters on either side.

All work on rows is built-in column expressions. The texts are scanned once: the
candidates with their votes are written, then counted for the fit and scored. What
reaches the driver is one row per distinct feature pattern, of which there are at most
MAX_PATTERNS, whatever the table holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from metricweave.llm.columns import let, quoted, whole, with_columns
from metricweave.session import store

BASE_KINDS = ("email", "ip", "card", "phone")
LOOSE_KINDS = ("email", "card", "phone", "ssn")
KINDS = (*BASE_KINDS, "ssn")

# Each pattern finds what its plain form in BASE_PLAIN finds. Possessive repeats and the
# look-behind only keep Java from trying again what cannot match: a run of characters is
# entered at its start or where the match before ended.
BASE_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
LOOSE = {
    "email": r"(?i)\b[a-z0-9][a-z0-9._-]{0,63}+ ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]{2,63}+){1,4}+",
    "card": r"(?<![0-9+.-])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9.])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{3,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: Gazetteers: final labels of mail hosts, issuer prefixes of cards, calling codes.
TOP_LEVEL = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|mx|ar|br|jp|cn|in|au"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|36|38|35|6011|65"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Words on either side of a span that speak for its kind, and words before it that speak against any.
CUES = {
    "email": r"e-?mail|mail|contact|write|reach|address|correo|adresse",
    "ip": r"\bip\b|host|server|address|login|client|from",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|call|tel|fax|mobile|dial|telefon|contact",
    "ssn": r"\bssn\b|social|security|insurance",
}
COUNTER_CUES = r"version|order|invoice|isbn|sku|serial|model|build|page|chapter|ticket|tracking"
#: Characters before and after a span that are looked at; classes of length and of digit groups.
CONTEXT, BEHIND, LENGTHS, GROUPS = 40, 24, 4, 5
LABELERS = ("regex", "gazetteer", "context", "format")
#: What the classifier sees beside kind and votes.
SHAPES = ("size", "cut", "groups", "joined", "ended")
MAX_PATTERNS = len(KINDS) * 3 ** len(LABELERS) * LENGTHS * 2 * GROUPS * 2 * 2
#: A prefix sum over so many matches is formed at once.
CHUNK = 128


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, match, before, after>>``.

    Positions are code points, the end exclusive. The text is split at its
    matches and lengths are summed, so no match is searched for again. ``before`` and
    ``after`` are the last CONTEXT and first BEHIND characters of what lies between a
    match and its second neighbour, so the text is not walked again either.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(gaps, lambda g: _placed(m, g))))


def _placed(found: Column, gaps: Column) -> Column:
    sizes = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    add = lambda total, size: total + size
    part = lambda s, c, n: F.aggregate(F.slice(s, c * CHUNK + 1, n), zero, add)
    chunks = lambda s: F.sequence(F.lit(0), F.call_function("div", F.size(s) - 1, F.lit(CHUNK)).cast("int"))
    # rows before each chunk: one entry per CHUNK matches
    before = lambda s: F.aggregate(
        F.transform(chunks(s), lambda c: part(s, c, CHUNK)),
        F.array(zero),
        lambda known, size: F.concat(known, F.array(F.element_at(known, -1) + size)),
    )

    def place(s: Column, b: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            chunk = F.call_function("div", i, F.lit(CHUNK)).cast("int")
            start = F.get(b, chunk) + part(s, chunk, i % CHUNK) + F.length(F.get(gaps, i))
            other = lambda k: F.coalesce(F.get(found, k), F.lit(""))
            before = F.right(F.concat(other(i - 1), F.get(gaps, i)), F.lit(CONTEXT))
            after = F.left(F.concat(F.get(gaps, i + 1), other(i + 1)), F.lit(BEHIND))
            return F.struct(
                start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), before.alias("before"), after.alias("after")
            )

        return F.transform(found, one)

    return let(sizes, lambda s: let(before(s), lambda b: place(s, b)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _of_kind(text: Column, kind: str, pattern: str, keep=None) -> Column:
    spans = find_spans(text, pattern)
    return F.filter(spans, lambda s: keep(kind, s["match"])) if keep else spans


def base_spans(text: Column) -> Column:
    """Strict spans as a struct of one array per kind, each in order."""
    return F.struct(*[_of_kind(text, kind, BASE_FAST[kind], _valid).alias(kind) for kind in BASE_KINDS])


def _covered(spans: Column) -> Column:
    """One byte per code point up to the last span's end: ``1`` inside a span, ``0`` outside."""
    gap = lambda s, i: (s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0).cast("bigint"))).cast("int")
    parts = F.transform(spans, lambda s, i: F.concat(F.repeat(F.lit("0"), gap(s, i)), F.repeat(F.lit("1"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(parts, "").cast("binary")


def candidates(text: Column) -> Column:
    """Base and loose spans with their votes: one array of structs.

    A loose span that shares a character with a base span is not a candidate; that is
    read off the covered characters, so dense texts cost no comparison of all pairs.
    """
    loose = F.struct(*[_of_kind(text, kind, LOOSE[kind]).alias(kind) for kind in LOOSE_KINDS])

    def clear(spans: Column, covers: Column) -> Column:
        part = lambda c, s: F.substring(c, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.filter(spans, lambda s: ~F.exists(covers, lambda c: F.contains(part(c, s), F.lit(b"1"))))

    def both(found: Column) -> Column:
        base, more = found["base"], found["loose"]
        judged = lambda kind, strict: lambda s: _voted(kind, s, strict)
        strict = F.concat(*[F.transform(base[k], judged(k, True)) for k in BASE_KINDS])
        any_loose = sum((F.size(more[k]) for k in LOOSE_KINDS[1:]), F.size(more[LOOSE_KINDS[0]])) > 0
        covers = F.array(*[_covered(base[k]) for k in BASE_KINDS])
        voted = lambda c: F.concat(*[F.transform(clear(more[k], c), judged(k, False)) for k in LOOSE_KINDS])
        return F.when(any_loose, F.concat(strict, let(covers, voted))).otherwise(strict)

    return let(F.struct(base_spans(text).alias("base"), loose.alias("loose")), both)


def _voted(kind: str, span: Column, strict: bool) -> Column:
    match, before, after = span["match"], F.lower(span["before"]), F.lower(span["after"])
    digits = _digits(match)
    vote = lambda good, bad=None: (
        F.when(good, 1).when(bad, -1).otherwise(0) if bad is not None else F.when(good, 1).otherwise(-1)
    )
    tail = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = {
        "email": lambda: vote(tail.rlike(f"^(?:{TOP_LEVEL})$")),
        "ip": lambda: vote(~match.rlike(r"^(?:0|127|255|22[4-9]|2[34][0-9])\.")),
        "card": lambda: vote(digits.rlike(f"^(?:{ISSUERS})")),
        "phone": lambda: vote(match.rlike(rf"^\+(?:{CALLING})"), match.startswith("+")),
        "ssn": lambda: vote(~match.rlike("^(?:000|666|9)")),
    }
    shape = {
        "email": lambda: vote(~match.rlike(r"\.\.|^\.|-\.")),
        "ip": lambda: vote(match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": lambda: vote(F.call_function("luhn_check", digits)),
        "phone": lambda: vote(F.length(digits).between(10, 13)),
        "ssn": lambda: vote(~match.rlike("-00-|-0000$")),
    }
    cue = before.rlike(CUES[kind]) | after.rlike(rf"^\W{{0,4}}(?:is (?:my|the|our|your) |\()?(?:{CUES[kind]})")
    # another number next to it, as in a list or table of numbers
    row_of_numbers = (before.rlike(r"[0-9][0-9.-]{3,}[\s,;|]+$") | after.rlike(r"^[\s,;|]+[0-9][0-9.-]{3,}")) if kind != "email" else F.lit(False)
    return F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lit(strict).alias("base"),
        F.lit(1 if strict else 0).alias("regex"),
        gazetteer[kind]().alias("gazetteer"),
        vote(cue, before.rlike(COUNTER_CUES) | row_of_numbers).alias("context"),
        shape[kind]().alias("format"),
        F.least(F.call_function("div", F.length(match), F.lit(6)), F.lit(LENGTHS - 1)).cast("int").alias("size"),
        match.rlike(r"[\x20().-]").cast("int").alias("cut"),
        F.least(F.regexp_count(match, F.lit("[0-9]+")), F.lit(GROUPS - 1)).cast("int").alias("groups"),
        before.rlike(r"[\w.#/=-]$").cast("int").alias("joined"),
        after.rlike(r"^(?:[.,;:!?)]?(?:\s|$))").cast("int").alias("ended"),
    )


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier and, for the record, each labeler's reliability."""

    weights: dict[str, float]
    reliability: dict[str, float]

    def score(self, span: Column) -> Column:
        total = F.lit(self.weights.get("bias", 0.0))
        for kind in KINDS:
            total = total + F.when(span["kind"] == kind, self.weights.get(kind, 0.0)).otherwise(0.0)
        for name in (*LABELERS, *SHAPES):
            total = total + span[name] * F.lit(self.weights.get(name, 0.0))
        return total


def fit_span_model(df: DataFrame, text: str = "text", rounds: int = 50) -> SpanModel:
    """Reliabilities by EM over all candidates of ``df``, then the classifier.

    The table is reduced to counts per feature pattern, at most MAX_PATTERNS
    rows, before anything leaves Spark. Without a candidate the model keeps
    base spans only.
    """
    return _fitted(df.select(candidates(whole(quoted(text))).alias("spotted")), "spotted", rounds)


def _fitted(df: DataFrame, spotted: str, rounds: int = 50) -> SpanModel:
    rows = (
        df.select(F.explode(quoted(spotted)).alias("c"))
        .groupBy("c.kind", *[f"c.{x}" for x in (*LABELERS, *SHAPES)])
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    if not rows:
        return SpanModel({"bias": -1.0}, {})
    rows.sort(key=lambda r: tuple(r))
    weight = np.array([r["n"] for r in rows], dtype=float)
    kinds = np.array([KINDS.index(r["kind"]) for r in rows])
    votes = np.array([[r[x] + 1 for x in LABELERS] for r in rows])
    likely, right = _em(kinds, votes, weight, rounds)
    features = np.column_stack([
        np.ones(len(rows)), np.eye(len(KINDS))[kinds], votes - 1, [[r[x] for x in SHAPES] for r in rows],
    ])
    names = ("bias", *KINDS, *LABELERS, *SHAPES)
    return SpanModel(dict(zip(names, _logistic(features, likely, weight))), dict(zip(LABELERS, right)))


def _em(kinds: np.ndarray, votes: np.ndarray, weight: np.ndarray, rounds: int):
    """P(personal | votes) per pattern, and each labeler's share of right votes.

    Two classes; a labeler that votes says no or yes with its own probabilities in
    each, and one that abstains says nothing about the class. Counts are smoothed by
    one, and the start is the mean vote.
    """
    likely = np.clip(0.5 + (votes - 1).mean(axis=1) / 2, 0.05, 0.95)
    for _ in range(rounds):
        mass = np.stack([weight * (1 - likely), weight * likely])
        prior = (np.stack([np.bincount(kinds, m, len(KINDS)) for m in mass]) + 1) / (
            np.bincount(kinds, weight, len(KINDS)) + 2
        )
        log = np.log(prior[:, kinds])
        right = []
        for j in range(votes.shape[1]):
            cast = votes[:, j] != 1
            seen = np.stack([np.bincount(votes[cast, j] // 2, m[cast], 2) for m in mass]) + 1
            share = seen / seen.sum(axis=1, keepdims=True)
            log[:, cast] += np.log(share[:, votes[cast, j] // 2])
            right.append(float((share[0, 0] + share[1, 1]) / 2))
        likely = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return likely, right


def _logistic(x: np.ndarray, likely: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton steps for a weighted logistic fit to probabilities."""
    w, weight = np.zeros(x.shape[1]), weight / weight.sum() * 1000
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - likely)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return [float(v) for v in w]


def find_pii(df: DataFrame, text: str = "text", model: SpanModel | None = None, keep_text: bool = True) -> DataFrame:
    """Append ``pii``: ``array<struct<kind, start, end, base>>`` by kind as listed, then place.

    Base spans are always in it; other candidates if the classifier scores them
    above even. No row is dropped, repeated rows get equal spans, a null or
    empty text gives an empty array, an empty table an empty table; an input
    column named ``pii`` is replaced. Without ``keep_text`` the text is left out.

    Without a ``model`` two jobs run while the query is being defined: the rows are
    written with their candidates, and the model is fitted to counts of those.
    """
    spotted = with_columns(df, {"__spotted": candidates(whole(quoted(text)))})
    if not keep_text:
        spotted = spotted.drop(quoted(text))
    if model is None:
        spotted = store(spotted, "candidates")
        model = _fitted(spotted, "__spotted")
    kept = F.filter("__spotted", lambda c: c["base"] | (model.score(c) > 0))
    place = lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("at"), s["start"].alias("start"),
        s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"),
    )
    sorted_spans = F.array_sort(F.transform(kept, place))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    return with_columns(spotted, {"pii": F.transform(sorted_spans, plain)}).drop("__spotted")


def mask_pii(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace every span of the text by ``[KIND]``; overlapping spans become one.

    A null text stays null. Of spans that overlap, the one that begins first
    (the longer, if they begin together) names the mask and the others extend it.
    """
    value = quoted(text)
    ordered = F.array_sort(F.transform(quoted(spans), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    piece = "array<struct<start:bigint,end:bigint,kind:string>>"

    def merge(known: Column, s: Column) -> Column:
        last, end = F.element_at(known, -1), -s["back"]
        new = F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind"))
        joined = F.concat(F.slice(known, 1, F.size(known) - 1), F.array(wider))
        return F.when((F.size(known) > 0) & (s["start"] < F.get(known, F.size(known) - 1)["end"]), joined).otherwise(F.concat(known, F.array(new)))

    def rebuilt(m: Column) -> Column:
        cut = lambda a, b: F.substring(value, (a + 1).cast("int"), (b - a).cast("int"))
        ends = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0).cast("bigint"))
        parts = F.transform(m, lambda s, i: F.concat(cut(ends(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        tail = cut(F.element_at(m, -1)["end"], F.length(value).cast("bigint"))
        return F.when(F.size(m) == 0, value).otherwise(F.concat(F.array_join(parts, ""), tail))

    meets = lambda o: F.exists(F.transform(o, lambda s, i: F.coalesce(s["start"] < -F.get(o, i - 1)["back"], F.lit(False))), lambda x: x)
    alone = lambda o: F.transform(o, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind")))
    merged = let(ordered, lambda o: F.when(meets(o), F.aggregate(o, F.array().cast(piece), merge)).otherwise(alone(o)))
    return with_columns(df, {text: let(merged, rebuilt)})
