"""URL filtering: a blocked Bloom filter before an exact hash join.

Listed canonical URLs are rules: a host (which stands for its subdomains too) and
the beginning of a path, with a verdict.  A URL is looked up under each of its host's
suffixes of as many labels as some listed host has, with each beginning of its path that
is as long as some listed path.  The keys go through a blocked Bloom filter: a key's hash picks one block of 256 bits and
one bit in each of its four words, so a test reads one block.  Keys that pass are
possible hits; an exact hash join with the list removes the false ones, and the
longest rule that is left decides.

The filter is built by aggregation (words combined by bitwise or), of a size that
follows the list.  Up to ``LITERAL_BLOCKS`` blocks (a proven bound of 32 bytes each)
it is a constant in the plan; a larger one stays a table, joined on the block number.
The list is broadcast only where its counted rows and bytes are within
``BROADCAST_BYTES``; a larger one is joined by shuffling.

Only DataFrame functions are used.

Defined results: null URLs, and those without ``://``, have an empty host and path
and match no rule; an empty table gives no rows; rows that repeat are judged alike;
rules that repeat or contradict each other for one (host, path) count once, as
block; null rules are ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
KEYS_PER_BLOCK = 16  # 16 bits a key
LITERAL_BLOCKS = 512
BROADCAST_BYTES = 32 << 20
#: Distinct path lengths or numbers of host labels in a list that are named in the plan; with more, all from the least to the greatest are tried.
MAX_NAMED = 4096


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(n_blocks)).cast("int")


def _bit(h: Column, word: int) -> Column:
    """The bit of a key in one of its block's words."""
    return F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63)).cast("int")


def build_filter(rules: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w3) from rules with a column ``h``."""
    bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h"), k))).alias(f"w{k}") for k in range(WORDS)]
    return rules.groupBy(_block(F.col("h"), n_blocks).alias("block")).agg(*bits)


def _passes(words: list[Column], h: Column) -> Column:
    test = F.lit(True)
    for k, w in enumerate(words):
        test = test & (F.call_function("getbit", w, _bit(h, k)) == 1)
    return test


def canonical(rules: DataFrame) -> DataFrame:
    """Distinct rules: host, path, rule, size (characters), verdict, h."""
    named = rules.select(F.lower("host").alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    one = named.groupBy("host", "path").agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("verdict"))
    return one.withColumns({"rule": F.concat("host", "path"), "size": F.char_length("host") + F.char_length("path"), "h": F.xxhash64("host", "path")})


def _labels(host: str) -> Column:
    """How many labels a host has."""
    return F.char_length(host) - F.char_length(F.replace(F.col(host), F.lit("."))) + 1


def _fitting(numbers: list[int], most: Column) -> Column:
    """Those of ``numbers`` up to ``most``, as an array."""
    if len(numbers) <= MAX_NAMED:
        return F.filter(F.array(*map(F.lit, sorted(numbers))), lambda n: n <= most)
    low = F.lit(min(numbers))
    return F.when(most >= low, F.sequence(low, F.least(most, F.lit(max(numbers))))).otherwise(F.array().cast("array<int>"))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row a page: page_id, host, path, rule (null if none) and verdict."""
    listed = canonical(rules)
    facts = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("rule")), F.lit(0)).alias("bytes"), F.collect_set(F.char_length("path")).alias("lengths"), F.collect_set(_labels("host")).alias("labels")).first()
    parts = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not facts["n"]:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_blocks = max(1, -(-facts["n"] // KEYS_PER_BLOCK))
    small = facts["n"] * 64 + facts["bytes"] <= BROADCAST_BYTES
    filter_ = build_filter(listed, n_blocks)

    suffixes = F.transform(_fitting(facts["labels"], _labels("host")), lambda k: F.call_function("substring_index", "host", F.lit("."), -k))
    starts = _fitting(facts["lengths"], F.char_length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.struct(s.alias("host"), F.substring("path", 1, n).alias("path"), F.xxhash64(s, F.substring("path", 1, n)).alias("h")))))

    if n_blocks <= LITERAL_BLOCKS:
        have = {r["block"]: [r[f"w{k}"] for k in range(WORDS)] for r in filter_.collect()}  # at most LITERAL_BLOCKS rows
        flat = [F.lit(w).cast("long") for b in range(n_blocks) for w in have.get(b, [0] * WORDS)]
        block = F.array(*flat)
        hits = F.filter(keys, lambda x: _passes([F.element_at(block, _block(x["h"], n_blocks) * WORDS + k + 1) for k in range(WORDS)], x["h"]))
        tried = parts.select("row", "page_id", "host", "path", F.explode_outer(hits).alias("key"))
    else:
        tried = parts.select("row", "page_id", "host", "path", F.explode_outer(keys).alias("key"))
        tried = tried.withColumn("block", _block(F.col("key.h"), n_blocks))
        # A block is 40 bytes; the filter is broadcast where all of them are within the bound.
        table = F.broadcast(filter_) if n_blocks * 64 <= BROADCAST_BYTES else filter_
        tried = tried.join(table, "block", "left").withColumn("key", F.when(_passes([F.col(f"w{k}") for k in range(WORDS)], F.col("key.h")), F.col("key")))
    exact = listed.select(F.col("host").alias("l_host"), F.col("path").alias("l_path"), "rule", "size", F.col("verdict").alias("listed"))
    exact = F.broadcast(exact) if small else exact
    found = tried.join(exact, (F.col("key.host") == F.col("l_host")) & (F.col("key.path") == F.col("l_path")), "left")
    # The longest rule; of equally long ones that of the longer host.
    best = F.max_by(F.struct("rule", "listed"), F.when(F.col("rule").isNotNull(), F.struct("size", F.char_length("l_host")))).alias("best")
    judged = found.groupBy("row", "page_id", "host", "path").agg(best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.listed", F.lit(default)).alias("verdict"))
