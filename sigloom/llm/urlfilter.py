"""URL filtering: path rules first, then a list of canonical URLs behind a blocked Bloom filter.

Rules are a short fixed list; a rule fits its host and all subdomains if the URL's path starts with the
rule's, and the longest fitting rule decides. All other URLs are looked up in the listed canonical URLs. The filter
has 512-bit blocks: one hash picks the block, eight others one bit in each of its 64-bit words. Blocks are built with
partial bit_or aggregation; the filter's size follows the list up to MAX_FILTER_BYTES, which bounds the broadcast;
beyond, only its false positives grow. URLs that pass it go to an exact hash join with the list, which removes
false positives; all others skip the join.

Canonical form: scheme dropped, host A-Z lower-cased without a leading `www.`, path without a trailing slash, query
without utm_* and ref parameters and sorted, fragment dropped.

Defined cases: a null URL or one without `://` has an empty host and path, no canonical form and is allowed. Null,
repeated and non-canonical list entries are fine. Repeated rows are each returned. Empty tables give empty results, an
empty list blocks nothing. Other columns pass through; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .stage import staged

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: What the query lists: pages on these sites, and single pages that hold the first LEAK_WORDS words of a benchmark item.
LISTED_SITES = ("casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com", "spam-farm.example.com", "adult-x.example.net")
LEAK_WORDS = 8
_TAG = re.compile("<[^>]*>")

MAX_FILTER_BYTES = 32 << 20
BITS_PER_URL = 16
WORDS = 8
U64 = np.uint64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("host", "path", "rule", "verdict")


def _rest(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Null without a host."""
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|\z)")))
    bare = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/\z", ""))
    full = F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.array_join(kept, "&"))).otherwise(bare)
    return F.when(host(url) != "", full)


def on_site(of: Column, sites: Sequence[str]) -> Column:
    found = F.lit(False)
    for site in sites:
        found = found | (of == site) | of.endswith("." + site)
    return found


def fitting(of: Column, at: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = text.partition("/")
        fits = on_site(of, [site]) & at.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its eight 64-bit words with one bit each."""
    block = ((hashes >> U64(32)) * U64(blocks)) >> U64(32)
    seeds = np.arange(1, WORDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    bit = tk.mix(hashes[:, None] ^ seeds[None, :]) & U64(63)
    return block.astype(np.int64), U64(1) << bit


class BlockedBloom:
    """A broadcast filter; `build` makes it from a column of canonical URLs."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def build(listed: DataFrame, column: str, max_bytes: int = MAX_FILTER_BYTES) -> BlockedBloom:
        n = listed.count()
        blocks = int(min(max(1, -(-n * BITS_PER_URL // 512)), max_bytes // 64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, bits = _places(np.asarray(batch.column(0)).view(U64), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(bits[:, i].copy().view(np.int64)) for i in range(WORDS))], names=["block", *(f"w{i}" for i in range(WORDS))])

        hashed = listed.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
        rows = hashed.mapInArrow(run, "block long, " + ", ".join(f"w{i} long" for i in range(WORDS)))
        merged = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        words = np.zeros((blocks, WORDS), U64)
        # At most max_bytes / 64 rows, whatever the list.
        for part in merged.toArrow().to_batches():
            at = np.asarray(part.column(0))
            for i in range(WORDS):
                words[at, i] = np.asarray(part.column(1 + i)).view(U64)
        return BlockedBloom(words)

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = _places(hashes, len(self.words))
        return ((self.words[block] & bits) == bits).all(axis=1)


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The pages with host, path, rule and verdict. `listed` holds canonical URLs."""
    pages = pages.drop(*ADDED)
    listed = listed.select(F.col(listed_col).alias("_uf_listed")).where("_uf_listed IS NOT NULL").distinct()
    bloom = pages.sparkSession.sparkContext.broadcast(BlockedBloom.build(listed, "_uf_listed").words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = BlockedBloom(bloom.value)
            passed = known.might_contain(np.asarray(batch.column(0)).view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(passed), *batch.columns[1:]], names=["_uf_pass", *batch.schema.names[1:]])

    url = F.col(url_col)
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    split = pages.withColumns({"host": host(url), "path": path(url), "_uf_url": canonical(url)})
    ruled = split.withColumns({"rule": rule, "verdict": verdict}).withColumn("_uf_hash", F.coalesce(F.xxhash64("_uf_url"), F.lit(0)))
    kept = [*pages.columns, *ADDED]
    types = ", ".join(f"`{c}` {ruled.schema[c].dataType.simpleString()}" for c in [*kept, "_uf_url"])
    tested = staged(ruled.select("_uf_hash", *kept, "_uf_url").mapInArrow(run, "_uf_pass boolean, " + types), "urls")
    asks = F.col("verdict").isNull() & F.col("_uf_url").isNotNull() & F.col("_uf_pass")
    rest = tested.where(~asks).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    hits = tested.where(asks).join(listed, F.col("_uf_url") == F.col("_uf_listed"), "left")
    hits = hits.withColumn("verdict", F.when(F.col("_uf_listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rest.select(*kept).unionByName(hits.select(*kept))


def _windows(words: int):
    """Text (column 0) to the hashes of its windows of so many words, tags left out; other columns follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for large in batches for small in tk.small_batches(large)):
            plain = pa.array([_TAG.sub(" ", t or "") for t in batch.column(0).to_pylist()], pa.string())
            for piece in tk.row_slices(plain):
                s, e, bounds = piece.words()
                lists = tk.long_lists(*tk.windows(piece.digests(s, e, True), bounds, words))
                yield pa.RecordBatch.from_arrays([lists, *(c.slice(piece.lo, piece.rows) for c in batch.columns[1:])], names=["windows", *batch.schema.names[1:]])

    return run


def listed_pages(pages: DataFrame, items: DataFrame, sites: Sequence[str] = LISTED_SITES, words: int = LEAK_WORDS) -> DataFrame:
    """url: the canonical URLs of the pages (url, html) on the given sites, and of those that hold the first words of an item (text).

    Words are those of the page without tags, A-Z lower-cased; an item of fewer words lists nothing.
    """
    url = canonical(F.col("url")).alias("url")
    bad = pages.where(on_site(host(F.col("url")), sites)).select(url)
    held = pages.select(F.col("html").cast("string"), url).mapInArrow(_windows(words), "windows array<long>, url string").select("url", F.explode("windows").alias("window"))
    first = items.select(F.col("text").cast("string")).mapInArrow(_windows(words), "windows array<long>").select(F.get("windows", F.lit(0)).alias("window"))
    leaks = held.join(first.where("window IS NOT NULL").distinct(), "window").select("url")
    return bad.unionByName(leaks).distinct()


_SITES = " OR ".join(f"host = '{s}' OR suffix(host, '.{s}')" for s in LISTED_SITES)
_CASES = "\n".join(
    f"  WHEN (host = '{site}' OR suffix(host, '.{site}')) AND starts_with(path, '/{rest}') THEN '{rule}'"
    for rule, site, rest in sorted(((r, *r.split("/", 1)) for _, r in RULES), key=lambda x: -len(x[0]))
)
_KINDS = " ".join(f"WHEN '{r}' THEN '{k}'" for k, r in RULES)
ORACLE = f"""
WITH b AS (SELECT list_distinct(list(array_to_string(ws[1:{LEAK_WORDS}], ' '))) AS firsts FROM (SELECT regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark) t WHERE len(ws) >= {LEAK_WORDS}),
h AS (SELECT page_id, regexp_extract_all(translate(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM pages),
leak AS (SELECT DISTINCT page_id FROM h, b WHERE len(ws) >= {LEAK_WORDS} AND list_has_any(list_transform(range(1, len(ws) - {LEAK_WORDS - 2}), lambda i: array_to_string(ws[i:i + {LEAK_WORDS - 1}], ' ')), firsts)),
p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
      regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*\\?([^#]*)', 1) AS query FROM p),
c AS (SELECT page_id, host, path, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|\\z)'))) AS ps,
      regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/\\z', '') AS bare FROM q),
d AS (SELECT page_id, host, path, CASE WHEN host = '' THEN NULL WHEN len(ps) > 0 THEN bare || '?' || array_to_string(ps, '&') ELSE bare END AS canon,
      CASE
{_CASES}
      END AS rule FROM c),
l AS (SELECT DISTINCT canon FROM d LEFT JOIN leak ON leak.page_id = d.page_id WHERE canon IS NOT NULL AND (leak.page_id IS NOT NULL OR {_SITES}))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {_KINDS} END WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM d LEFT JOIN l ON d.canon = l.canon
"""
