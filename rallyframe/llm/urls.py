"""URL filters as a sort-merge range join.

A rule names a host and a path; it fits its host and all subdomains where the
url's path starts with the rule's.  Hosts become keys of their labels in reverse,
each closed by U+0001, so a rule's host is a prefix of every key it fits and its
keys are the interval from that prefix to the same with U+0002 for the last sign.
Rules and pages are dealt to ranges of keys and sorted together; one sweep keeps
the stack of rules whose interval is open, which are always nested, and judges
each page by the longest rule on the stack whose path fits.

Ranges are cut at quantiles of a bounded sample of keys (SAMPLE rows at most);
the cuts only balance the work.  A host that covers several cuts is dealt over
all of its ranges by page, and a rule goes to every range its interval meets.

Defined cases: null urls and those without "://" have an empty host and path and
fit no rule; of rules that fit the longest (host and path together) wins, at a
tie the longer host, then the smaller text; a rule that is repeated with both
verdicts blocks; rules with a null host or path are left out; repeated pages are
each judged; an empty table of pages gives an empty result, an empty table of
rules gives the default verdict; other columns are passed over.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az

SAMPLE, RANGE_ROWS = 10_000, 200_000
END, AFTER = "\x01", "\x02"


def url_host(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), END), F.lit(END))


def sweep(default: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, rules before pages) -> the pages with rule and verdict."""
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    now = None
    for pdf in batches:
        out = []
        for part, key, page_id, host, path, rule, verdict in zip(pdf["part"], pdf["key"], pdf["page_id"].astype(object).where(pdf["page_id"].notna(), None), pdf["host"], pdf["path"], pdf["rule"], pdf["verdict"]):
            if part != now:
                stack, now = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if verdict is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((path, rule, verdict))
                continue
            fits = [(-len(r), -len(k), r, v != "block", v) for k, own in stack for p, r, v in own if path.startswith(p)]
            best = min(fits, default=None)
            out.append((page_id, host, path, best[2] if best else None, best[4] if best else default))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url), rules (host, path, verdict) -> page_id, host, path, rule (host and path of the one that won), verdict."""
    own = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    size = own.count()
    share = min(1.0, 0.5 * SAMPLE / max(1, size))
    keys = sorted(r["key"] for r in own.select("key").sample(share, 7).limit(SAMPLE).collect())
    n = min(len(keys), -(-size // RANGE_ROWS) * 4)
    cuts = [keys[i * len(keys) // n] for i in range(1, n)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo = [bisect_left(cuts, k) for k in pdf["key"]]
            hi = [bisect_right(cuts, k) for k in pdf["key"]]
            yield pdf.assign(part=[a + s % (b - a + 1) for a, b, s in zip(lo, hi, pdf["salt"])]).drop(columns="salt")

    def open_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = [bisect_left(cuts, k) for k in pdf["key"]]
            last = [bisect_left(cuts, k[:-1] + AFTER) for k in pdf["key"]]
            yield pdf.assign(part=[list(range(a, b + 1)) for a, b in zip(first, last)])

    judged = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 20)).cast("int")).mapInPandas(deal, "page_id long, host string, path string, key string, part int")
    given = rules.where("host is not null and path is not null and verdict is not null").select(lower_az(F.col("host")).alias("host"), "path", "verdict").distinct()
    given = given.select("host", "path", "verdict", F.concat("host", "path").alias("rule"), host_key(F.col("host")).alias("key")).mapInPandas(open_in, "host string, path string, verdict string, rule string, key string, part array<int>").withColumn("part", F.explode("part"))
    none = F.lit(None)
    both = judged.select("part", "key", "page_id", "host", "path", none.cast("string").alias("rule"), none.cast("string").alias("verdict")).unionByName(given.select("part", "key", none.cast("long").alias("page_id"), "host", "path", "rule", "verdict"))
    swept = both.repartition("part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "page_id")
    return swept.mapInPandas(lambda batches: sweep(default, batches), "page_id long, host string, path string, rule string, verdict string")
