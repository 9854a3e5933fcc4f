"""URL filters: host and path rules, then a list of canonical URLs.

The list is tested in two steps. A blocked Bloom filter, one 64-bit word per
block and several bits of it per listed URL, lets through every listed URL and
a small share of the others; only those go to an exact hash join, which removes
the false positives. The filter is a table built by Spark itself: it is broadcast
while its counted size stays below a bound, and joined by block beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from metricweave.llm.columns import ascii_lower, quoted, whole, with_columns

#: Listed URLs per 64-bit block, on average, and bits set per URL.
PER_BLOCK, BITS = 4, 4
#: Up to so many blocks (24 bytes each) the filter is broadcast.
MAX_BLOCKS = 4_000_000
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|ref"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """One spelling per page: no scheme, ``www.``, default port, fragment, tracking
    parameter or final slash; the host in lower case. Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(whole(url), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)"))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), asked))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct<verdict, rule>``, null where none fits.

    A rule is ``(verdict, "host/path")``: it fits its host and all subdomains,
    if the URL's path starts with the rule's. Rules are configuration and
    become one expression; for equal lengths the first in order wins.
    """
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        site, start = rule.split("/", 1)
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{start}")
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """BITS bits of a 64-bit word, from a second hash cut into pieces of six bits."""
    spread = F.xxhash64(key, F.lit("bits"))
    word = F.lit(0).cast("bigint")
    for k in range(BITS):
        place = F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return word


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, word``: the bits of all keys, or-ed per block; blocks without a key are absent."""
    column = quoted(key)
    return keys.groupBy(_block(column, blocks).alias("block")).agg(F.bit_or(_bits(column)).alias("word"))


def listed(df: DataFrame, url: str, listing: DataFrame, listed_url: str, name: str = "listed") -> DataFrame:
    """Append whether the row's canonical URL is listed.

    Null or hostless URLs, on either side, match nothing; repeated entries of
    the list count once, so no row multiplies. An empty list marks all rows
    false. Columns named like the appended one are replaced.
    """
    wanted = listing.select(canonical_url(quoted(listed_url)).alias("_url")).where("_url IS NOT NULL").distinct()
    entries = wanted.count()
    if entries == 0:
        return with_columns(df, {name: F.lit(False)})
    keyed = df.withColumn("_url", canonical_url(quoted(url)))
    blocks = -(-entries // PER_BLOCK)
    columns = [quoted(c) for c in df.columns if c.lower() != name.lower()]
    found = wanted.withColumn("_found", F.lit(True))
    words = bloom_filter(wanted, "_url", blocks).withColumnsRenamed({"block": "_block", "word": "_word"})
    if blocks <= MAX_BLOCKS:
        words = F.broadcast(words)
    known = keyed.where("_url IS NOT NULL")
    tested = known.withColumn("_block", _block(F.col("_url"), blocks)).join(words, "_block", "left")
    bits = _bits(F.col("_url"))
    passes = F.coalesce(F.col("_word").bitwiseAND(bits) == bits, F.lit(False))
    hits = tested.where(passes).join(found, "_url", "left").select(*columns, F.coalesce("_found", F.lit(False)).alias(name))
    missed = tested.where(~passes).select(*columns, F.lit(False).alias(name))
    # only possible hits are moved to the exact join; the others stay where they are
    return hits.unionByName(missed).unionByName(keyed.where("_url IS NULL").select(*columns, F.lit(False).alias(name)))


def filter_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str]],
    listing: DataFrame,
    url: str = "url",
    listed_url: str = "url",
) -> DataFrame:
    """Append ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``).

    The longest fitting rule decides; where none fits, a listed URL is blocked
    and any other allowed. No row is dropped or repeated; a null URL has an
    empty host and path, fits no rule and is allowed.
    """
    judged = listed(df, url, listing, listed_url, "_listed")
    host, path = host_of(quoted(url)), path_of(quoted(url))
    judged = judged.withColumn("_rule", rule_for(host, path, rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    columns = {"host": host, "path": path, "rule": F.col("_rule.rule"), "verdict": verdict}
    return with_columns(judged, columns).drop("_listed", "_rule")
