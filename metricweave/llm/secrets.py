"""Secret scans: candidates from one pattern, false positives removed by a random forest.

Candidates are long runs of key-like characters, and shorter values that are assigned
to a name for secrets. Length, changes of character class, dictionary coverage, path
and neighbouring words describe them; a forest fitted to labelled findings decides. The
findings are lines set by hand (``findings.py``), or any others with a label. The trees
are compiled into one column expression, so that every text is scanned once and judged
where it lies: no Python runs on the executors and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricweave.llm.columns import let, quoted, whole, with_columns
from metricweave.llm.findings import labelled_lines
from metricweave.llm.pii import find_spans
from metricweave.session import store

#: Shortest candidate by its characters alone, and shortest one that is assigned to a name for secrets.
SHORTEST, ASSIGNED = 16, 8
#: Names that a short value may be assigned to, and what may stand between.
NAMED = "(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key)[\"'`]?[ \\t]{0,3}[:=][ \\t]{0,3}[\"'`]?"
VALUE = "[^\\s\"'`,;&<>]"
#: A key ends its name at the first equals sign, which is part of a run only as padding at its end.
CANDIDATE = f"{NAMED}{VALUE}{{{ASSIGNED},}}+|[A-Za-z0-9+/_.-]{{{SHORTEST},}}+={{0,2}}+"
BEFORE, AFTER = 40, 12
#: Labelled findings per class that the forest is fitted on, at most; trees and depth.
SAMPLE, TREES, DEPTH = 10_000, 25, 8
SECRET_WORDS = "token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer"
HARMLESS_WORDS = "example|sample|dummy|test|placeholder|changeme|checksum|sha1|sha256|sha384|md5|commit|digest|uuid|hash|etag|integrity|index|base64"
#: How well-known issuers begin their keys.
ISSUED = "^(?:gh[opsu]_|AKIA|ASIA|sk_live_|rk_live_|xox[abprs]-|glpat-|AIza|npm_|eyJ[A-Za-z0-9_-]+[.]|SG[.])"
#: What stands where a key is to be filled in.
FILLER = "your|here|change|replace|insert|example|sample|dummy|placeholder|test|xxx|[*]{3}"
#: Words and word parts of running text; what they cover of a candidate speaks against it.
DICTIONARY = (
    "the|and|ing|ion|tion|ent|that|with|for|this|from|her|ere|ted|able|ough|ver|ein|sch|ung|heit|keit|lich|"
    "der|die|das|und|ent|ment|eur|eux|que|aux|elle|ique|ción|mente|ado|los|las|con|rest|here|str|com|org|www|"
    "http|html|index|example|test|your|key|token|file|path|name|list|data|user|type|value"
)
TEST_PATH = "(?i)test|spec|example|sample|fixture|mock|doc"
FEATURES = (
    "length", "digits", "letters_between", "class_changes", "distinct", "covered", "upper", "vowels", "hex", "uuid", "slashes",
    "separators", "issued", "filler", "secret_word", "harmless_word", "named", "assigned", "quoted", "asked", "in_address", "test_path",
)


def _features(match: Column, before: Column, after: Column, path: Column) -> Column:
    size = F.length(match).cast("double")
    share = lambda pattern: F.regexp_count(match, F.lit(pattern)) / size
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    # the words on the line before the candidate
    words = F.lower(before)
    return F.struct(
        size.alias("length"),
        share("[0-9]").alias("digits"),
        share("(?<=[0-9])[A-Za-z]+(?=[0-9])").alias("letters_between"),
        share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])").alias("class_changes"),
        (F.size(F.array_distinct(F.split(F.lower(match), ""))) / size).alias("distinct"),
        (1 - F.length(F.regexp_replace(F.lower(match), DICTIONARY, "")) / size).alias("covered"),
        share("[A-Z]").alias("upper"),
        share("[aeiouAEIOU]").alias("vowels"),
        flag(match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        flag(match.rlike("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$")).alias("uuid"),
        share("[/]").alias("slashes"),
        share("[._/-]").alias("separators"),
        flag(match.rlike(ISSUED)).alias("issued"),
        flag(F.lower(match).rlike(FILLER)).alias("filler"),
        flag(words.rlike(SECRET_WORDS)).alias("secret_word"),
        flag(words.rlike(HARMLESS_WORDS) | F.lower(after).rlike(HARMLESS_WORDS)).alias("harmless_word"),
        flag(words.rlike(f"(?:{SECRET_WORDS})[\"'`]?[\\s]*(?:[:=]|value=)?[\\s\"'`(]*$")).alias("named"),
        flag(before.rlike("[=:][\\s\"'`]*$")).alias("assigned"),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).alias("quoted"),
        flag(before.rlike("[?&][^?&=\\s]*=$")).alias("asked"),
        flag(before.rlike("://[^\\s/]*$")).alias("in_address"),
        flag(path.rlike(TEST_PATH)).alias("test_path"),
    )


def candidates(text: Column, path: Column) -> Column:
    """``array<struct<start, end, match, features>>`` of a text, in order.

    A value that is assigned to a name for secrets begins after the assignment.
    """

    def described(span: Column) -> Column:
        named = F.length(F.regexp_extract(span["match"], f"^{NAMED}(?={VALUE})", 0))
        before = F.right(F.concat(span["before"], F.left(span["match"], named)), F.lit(BEFORE))
        after = F.substring_index(F.left(span["after"], F.lit(AFTER)), "\n", 1)
        match = F.substring(span["match"], named + 1, F.length(span["match"]))
        return F.struct(
            (span["start"] + named).alias("start"), span["end"].alias("end"), match.alias("match"),
            _features(match, F.substring_index(before, "\n", -1), after, path).alias("features"),
        )

    return F.transform(find_spans(text, CANDIDATE), described)


def label_findings(lines: DataFrame, text: str = "text", value: str = "value", path: str | None = None) -> DataFrame:
    """Findings in labelled lines: ``match``, the features and ``label``.

    The candidate that holds the line's ``value``, or is held by it, has the line's ``label``;
    any other candidate on the line, such as the name of a key, is a false positive.
    """
    where = quoted(path).cast("string") if path else F.lit(None).cast("string")
    rows = lines.select(F.explode(candidates(whole(quoted(text)), where)).alias("c"), quoted(value).alias("v"), F.col("label").alias("l"))
    own = F.contains("c.match", F.col("v")) | F.contains("v", F.col("c.match"))
    return rows.select("c.match", "c.features.*", F.when(own, F.col("l").cast("double")).otherwise(0.0).alias("label"))


def reviewed_findings(spark: SparkSession) -> DataFrame:
    """The findings of the lines set by hand."""
    return label_findings(spark.createDataFrame(labelled_lines(), "text string, value string, label double"))


def fit_forest(findings: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> list[str]:
    """A random forest as SQL conditions on FEATURES, one expression per tree.

    The fit sees at most ``2 * sample`` rows, which one task holds. ``findings`` holds FEATURES and ``label``; of each label at most ``sample``
    rows are used, those with the smallest hash of their features, whatever the
    order of the rows. Without findings of both labels a single tree says the
    one that there is, or no.
    """
    key = F.xxhash64(*[quoted(c) for c in (*FEATURES, *(["match"] if "match" in findings.columns else []))])
    keyed = findings.select(*FEATURES, "label", key.alias("_key"))
    of = lambda label: keyed.where(F.col("label") == label).orderBy("_key").limit(sample)
    chosen = store(of(0.0).unionByName(of(1.0)).fillna(0.0).coalesce(1).sortWithinPartitions("_key").drop("_key"), "findings")
    labels = {r["label"] for r in chosen.select("label").distinct().collect()}
    if len(labels) < 2:
        return [repr(labels.pop() if labels else 0.0)]
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(chosen)
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8
    )
    return _compiled(forest.fit(vectors).toDebugString)


def _compiled(printed: str) -> list[str]:
    """Printed trees to nested conditions: every line is an If, an Else or a Predict."""
    trees = []
    for body in re.split(r"Tree \d+ \(weight [\d.]+\):", printed)[1:]:
        lines = iter([line.strip() for line in body.strip().splitlines()])
        trees.append(_node(lines))
    return trees


def _node(lines) -> str:
    line = next(lines)
    if line.startswith("Predict"):
        return line.split(":")[1].strip()
    feature, bound = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line).groups()
    low = _node(lines)
    next(lines)  # Else
    return f"CASE WHEN {FEATURES[int(feature)]} <= {bound}D THEN {low} ELSE {_node(lines)} END"


def votes(features: Column, forest: Sequence[str]) -> Column:
    """Share of the trees that call a finding real."""
    total = F.lit(0.0)
    for tree in forest:
        total = total + _column(tree, features)
    return total / len(forest)


def _column(tree: str, features: Column) -> Column:
    parts = re.match(r"CASE WHEN (\w+) <= ([-\d.eE]+)D THEN (.*) END$", tree)
    if not parts:
        return F.lit(float(tree))
    low, high = _halves(parts[3])
    return F.when(features[parts[1]] <= float(parts[2]), _column(low, features)).otherwise(_column(high, features))


def _halves(body: str) -> tuple[str, str]:
    """``low ELSE high`` cut at the ELSE that belongs to the outermost CASE."""
    depth = 0
    for m in re.finditer(r"CASE|END|ELSE", body):
        if m[0] == "ELSE" and depth == 0:
            return body[: m.start()].strip(), body[m.end() :].strip()
        depth += {"CASE": 1, "END": -1}.get(m[0], 0)
    raise ValueError(body)


def find_secrets(
    df: DataFrame, forest: Sequence[str], text: str = "text", path: str | None = None, least: float = 0.5
) -> DataFrame:
    """Append ``n_candidates`` and ``secrets``: ``array<struct<start, end, score>>`` in text order.

    A secret is a candidate that over ``least`` of the trees call real; places
    are code points, the end exclusive. No row is dropped or repeated; a null
    text is empty, a null path no test path; an empty table gives an empty
    table, clashing input columns are replaced.
    """
    where = quoted(path).cast("string") if path else F.lit(None).cast("string")

    def judged(found: Column) -> Column:
        scored = F.transform(
            found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), votes(c["features"], forest).alias("score"))
        )
        return F.struct(F.size(found).cast("bigint").alias("n"), F.filter(scored, lambda c: c["score"] > least).alias("kept"))

    out = with_columns(df, {"_secrets": let(candidates(whole(quoted(text)), where), judged)})
    return with_columns(out, {"n_candidates": F.col("_secrets.n"), "secrets": F.col("_secrets.kept")}).drop("_secrets")
