"""One query per operator over its whole table, next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricweave.llm.decontaminate import find_contamination
from metricweave.llm.licenses import scan_licenses
from metricweave.llm.merkle import build_manifest, fold, proof_digest, row_digest
from metricweave.llm.negatives import mine_negatives
from metricweave.llm.packing import pack
from metricweave.llm.pii import BASE_KINDS, find_pii
from metricweave.llm.quality import quality_rules
from metricweave.llm.repeats import remove_repeats
from metricweave.llm.secrets import find_secrets, fit_forest, reviewed_findings
from metricweave.llm.sharding import record_size, shuffle_into_shards, text_crc32
from metricweave.llm.simhash import near_duplicates
from metricweave.llm.urls import TRACKING, filter_urls
from metricweave.llm.wrappers import extract_articles

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined_digest(parts) -> F.Column:
    return F.sha2(F.array_join(parts, ","), 256)


QUALITY_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM texts),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
            FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 8)) AS t(k) GROUP BY r),
metrics AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words,
           len(lines) AS n_lines,
           length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
           len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stops,
           len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦·][\x20\x09-\x0D]'))) AS n_bullets,
           len(list_filter(lines, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\x09-\x0D]*$'))) AS n_dots
    FROM words LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_symbols > n_words OR 2 * n_exclaims > n_words OR 50 * n_stops < n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_bullets > 9 * n_lines OR 10 * n_dots > 3 * n_lines) AS kept
FROM metrics
"""


def quality_sql(rows: str = "documents") -> str:
    from metricweave.llm.quality import STOP_WORDS

    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return QUALITY_SQL.replace("{stops}", stops).replace("FROM documents", f"FROM {rows}")


@query("op10_quality_rules", quality_sql())
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

#: (verdict, host/path), fixed by the query's contract.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: The query's list holds the canonical URLs of all tracked links in ``pages``.
LISTED_LINKS = "[?&]utm_source="

URL_SQL = r"""
WITH cut AS (
    SELECT page_id, coalesce(url, '') AS u,
           translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)', 2, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(.*?)://[^/?#]*([^?#]*)', 2, 's') AS path,
           regexp_extract(coalesce(url, ''), '^(.*?)://[^?#]*\?([^#]*)', 2, 's') AS asked
    FROM pages),
canon AS (
    SELECT *, list_filter(string_split(asked, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(TRACKING)(=|$)')) AS kept
    FROM cut),
keyed AS (
    SELECT *, CASE WHEN host <> '' THEN
        regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key
    FROM canon),
list AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches(u, 'LISTED') AND key IS NOT NULL),
rules(verdict, rule, site, start) AS (VALUES
    ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
    ('block', 'net/fr/', 'net', '/fr/')),
fit AS (
    SELECT page_id, host, path, key, (
        SELECT max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) FROM rules
        WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)) AS best
    FROM keyed)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN key IN (SELECT key FROM list) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""


@query("op9_url_filters", URL_SQL.replace("TRACKING", TRACKING).replace("LISTED", LISTED_LINKS))
def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL; where no rule fits, the list of tracked links decides."""
    pages = table(spark, folder, "pages")
    listing = pages.select("url").where(F.col("url").rlike(LISTED_LINKS))
    return filter_urls(pages.select("page_id", "url"), URL_RULES, listing).drop("url")


@query("op6_pii")
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of personal data in every document."""
    found = find_pii(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("pii", lambda s: s["base"])
    listing = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, joined_digest(listing(base)).alias("base_sha256"), F.array_join(listing(F.col("pii")), ",").alias("spans")
    )


CONTAMINATION_SQL = r"""
WITH folded AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM places JOIN windows USING (n, g)),
marked AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, 10)) AS t(k) WHERE k < n GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN marked USING (r) LEFT JOIN found USING (r)
"""


@query("op5_decontamination", CONTAMINATION_SQL)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of ten words of any benchmark item."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        joined_digest("items").alias("items_sha256"), "contaminated",
    )


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and class of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    narrow = near_duplicates(docs, shingle=3, radius=3, keep_text=False)
    return narrow.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers  # only this query needs the vocabulary files

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op8_repeats")
def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur elsewhere."""
    return remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), span=200).drop("text")


@query("op2_licenses")
def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licences named or quoted in every document."""
    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda x: x["score"])).alias("best_score"),
    )


@query("op3_secrets")
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, by a forest fitted to findings labelled by hand."""
    docs = table(spark, folder, "documents")
    forest = fit_forest(reviewed_findings(spark))
    found = find_secrets(docs.select("doc_id", "text", "source"), forest, path="source")
    places = F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"), F.array_join(places, ",").alias("secrets")
    )


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = extract_articles(table(spark, folder, "pages").select("page_id", "url", "html"), keep_html=False)
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op11_sharding")
def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; the law is equal counts of rows."""
    sharded = shuffle_into_shards(table(spark, folder, "documents").select("doc_id", "text"), shards=8, seed=11)
    return sharded.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


MANIFEST_SQL = r"""
WITH RECURSIVE rows_ AS (
    SELECT doc_id, source, lang, n_chars, text,
           CASE WHEN odd THEN text ELSE replace(text, chr(10), '') END AS changed
    FROM (SELECT *, coalesce(CRC % 2 = 1, true) AS odd FROM documents)),
hashed AS (
    SELECT doc_id, source, sha256(FIELDS_TEXT) AS leaf, sha256(FIELDS_CHANGED) AS tampered FROM rows_),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS n
    FROM hashed),
nodes(h, tree, idx, n, digest) AS (
    SELECT 0, tree, idx, n, leaf FROM leaves
    UNION ALL
    SELECT h + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY h, tree, idx // 3, (n + 2) // 3),
subroots AS (SELECT tree, h AS height, digest FROM nodes WHERE n = 1),
tops(h, idx, n, digest) AS (
    SELECT 0, tree, (SELECT count(*) FROM subroots), digest FROM subroots
    UNION ALL
    SELECT h + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
    FROM tops WHERE n > 1 GROUP BY h, idx // 3, (n + 2) // 3),
steps(h, tree, idx, subroot, acc, seen) AS (
    SELECT 0, l.tree, l.idx, s.digest, tampered, ''
    FROM leaves l JOIN subroots s USING (tree)
    UNION ALL
    SELECT h + 1, tree, idx, subroot, sha256(lefts || acc || rights), seen || lefts || rights
    FROM (
        SELECT s.h, s.tree, s.idx, s.subroot, s.acc, s.seen,
            coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (k.idx < s.idx // pow(3, s.h)::BIGINT), '') AS lefts,
            coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (k.idx > s.idx // pow(3, s.h)::BIGINT), '') AS rights
        FROM steps s JOIN nodes k ON k.tree = s.tree AND k.h = s.h AND k.n > 1 AND k.idx // 3 = s.idx // pow(3, s.h + 1)::BIGINT
        GROUP BY ALL)),
lower_ AS (SELECT s.* FROM steps s JOIN subroots r ON r.tree = s.tree AND r.height = s.h),
upper_(h, tree, idx, subroot, acc, seen) AS (
    SELECT 0, tree, idx, subroot, acc, seen FROM lower_
    UNION ALL
    SELECT h + 1, tree, idx, subroot, sha256(lefts || acc || rights), seen || lefts || rights
    FROM (
        SELECT s.h, s.tree, s.idx, s.subroot, s.acc, s.seen,
            coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (k.idx < s.tree // pow(3, s.h)::BIGINT), '') AS lefts,
            coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (k.idx > s.tree // pow(3, s.h)::BIGINT), '') AS rights
        FROM upper_ s JOIN tops k ON k.h = s.h AND k.n > 1 AND k.idx // 3 = s.tree // pow(3, s.h + 1)::BIGINT
        GROUP BY ALL)),
root_ AS (SELECT h, digest FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, digest AS root, sha256(seen) AS proof_sha256, acc AS folded_root, acc = digest AS verified
FROM leaves JOIN upper_ u USING (tree, idx) JOIN root_ r ON r.h = u.h
"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text in SQL, one shift per bit."""
    byte = f"list_reduce([c] || range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    table_ = f"list_transform(range(256), lambda c: {byte})"
    codes = f"list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295] || {codes}, lambda x, d: xor(x >> 8, ({table_})[(xor(x, d) & 255) + 1])))"


def manifest_sql() -> str:
    fields = lambda text: " || ".join(
        f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
        for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    filled = MANIFEST_SQL.replace("FIELDS_TEXT", fields("text")).replace("FIELDS_CHANGED", fields("changed"))
    return filled.replace("CRC", crc32_sql("doc_id::VARCHAR"))


@query("op12_merkle_manifest", manifest_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Digests, proofs and the check of a tampered copy for every document."""
    docs = table(spark, folder, "documents")
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lost = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    hashed = docs.select(
        "doc_id",
        "source",
        row_digest([*named, F.col("text")]).alias("leaf"),
        row_digest([*named, F.coalesce(lost, F.col("text"))]).alias("tampered"),
    )
    manifest = build_manifest(hashed, "source", ["doc_id"])
    folded = fold(F.col("tampered"), F.col("proof"))
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


NEGATIVES_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           list_dot_product(a.v, b.v)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0)
