"""Quality rules: a table of thresholds compiled into one projection.

Every metric is a built-in expression over the whole text, and every rule a
pair of bounds on a ratio of metrics. ``quality_rules`` turns both into columns
of one ``select``; no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from metricweave.llm.columns import let, quoted, space_words, whole, with_columns

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the languages served (en, de, fr, es).
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by from an at "
    "der die das und von den ist mit ein eine zu auf nicht sich des dem für "
    "le la les de et en un une du des que dans pour est au par "
    "el los las y del se una con no su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * over / under <= high`` keeps a document; an open end is None.

    Bounds are whole per cent and no division is made, so integers decide
    exactly, and a zero ``under`` asks for a zero ``over``.
    """

    name: str
    over: str
    under: str | None = None
    low: int | None = None
    high: int | None = None

    def broken(self, metric: dict[str, Column]) -> Column:
        over, under = metric[self.over] * 100, metric[self.under] if self.under else F.lit(1)
        found = F.lit(False)
        if self.low is not None:
            found = found | (over < under * self.low)
        if self.high is not None:
            found = found | (over > under * self.high)
        return found


#: Any broken rule here rejects, whatever else is configured.
BASE_RULES = (
    Rule("too_short", "n_words", low=2000),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=30),
)
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclaims", "n_words", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
)
METRICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_exclaims", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines",
)


def _size(items: Column) -> Column:
    return F.size(items).cast("bigint")


def _repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` that occur twice or more in the text.

    ``width`` is a power of two. Windows are compared by hash, built by doubling: of one word, of two, of
    four, of eight. Only a text with equal hashes sorts them: the starts of
    repeated windows, in order, each add the words that the window before did
    not cover.
    """
    join = lambda step: lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))
    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < width:
        hashes, step = let(hashes, join(step)), 2 * step
    hashes = F.slice(hashes, 1, F.size(words) - (width - 1))

    def covered(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(tagged, lambda t: F.aggregate(F.array_sort(_starts(t)), _start_state(), _extend, lambda s: s["n"]))

    def _starts(t: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(t, at)["h"] == x["h"], F.lit(False))
        again = F.filter(t, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.transform(again, lambda x: x["i"])

    def _start_state() -> Column:
        return F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last"))

    def _extend(state: Column, start: Column) -> Column:
        added = F.least(F.lit(width), start - state["last"])
        return F.struct((state["n"] + added).alias("n"), start.alias("last"))

    once = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    none = F.lit(0).cast("bigint")
    counted = let(hashes, lambda h: F.when(once(h), none).otherwise(covered(h)))
    return F.when(F.size(words) < width, none).otherwise(counted)


def measure(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """All METRICS of a text as one struct of bigints; null is an empty text."""
    text = whole(text)
    blank = "[ \\t-\\r]*"

    def of(words: Column, lines: Column) -> Column:
        # $ would also match before a line end that is no line feed, which is a word here
        told = F.filter(lines, lambda line: line.rlike("[^ \\t-\\r]"))
        lacking = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")
        return F.struct(
            _size(words).alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
            lacking(SYMBOLS).alias("n_symbols"),
            let(told, lambda x: _size(x) - _size(F.array_distinct(x))).alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            _size(told).alias("n_lines"),
            lacking("!").alias("n_exclaims"),
            _size(F.filter(words, lambda w: F.lower(w).isin(*stop_words))).alias("n_stop_words"),
            _size(F.filter(told, lambda x: x.rlike(f"^{blank}(?:[-*•‣◦·])[ \\t-\\r]"))).alias("n_bullet_lines"),
            _size(F.filter(told, lambda x: x.rlike(f"(?:…|\\.\\.\\.){blank}\\z"))).alias("n_ellipsis_lines"),
        )

    parts = F.struct(space_words(text).alias("words"), F.split(text, "\n", -1).alias("lines"))
    return let(parts, lambda p: of(p["words"], p["lines"]))


def quality_rules(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    base: Sequence[Rule] = BASE_RULES,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Append every metric, ``base_failed``, ``broken_rules`` (names) and ``kept``.

    Rows stay as they are: nothing is dropped, repeated rows are judged alike,
    columns whose names clash with the appended ones are replaced. A null or
    empty text has no words, hence fails the base; an empty table gives an
    empty table.
    """
    found = let(measure(quoted(text), stop_words), lambda m: _verdict(m, rules, base))
    judged = with_columns(df, {"_quality": found})
    inner = quoted("_quality")
    columns = {name: inner["metrics"][name] for name in METRICS}
    columns |= {name: inner[name] for name in ("base_failed", "broken_rules", "kept")}
    return with_columns(judged, columns).drop("_quality")


def _verdict(m: Column, rules: Sequence[Rule], base: Sequence[Rule]) -> Column:
    metric = {name: m[name] for name in METRICS}
    marks = [F.when(rule.broken(metric), F.lit(rule.name)) for rule in [*base, *rules]]
    failed = F.lit(False)
    for rule in base:
        failed = failed | rule.broken(metric)
    broken = F.array_compact(F.array(*marks))
    return F.struct(
        m.alias("metrics"), failed.alias("base_failed"), broken.alias("broken_rules"), (F.size(broken) == 0).alias("kept")
    )
