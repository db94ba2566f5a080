"""URL filter: allow and block rules, then a list of canonical URLs behind a blocked Bloom filter.

Rules (host, path) fit a host and its subdomains where the path starts with the rule's; the longest
decides. Other URLs are blocked if their canonical form is listed. The list is hashed into a blocked
Bloom filter, a table of bounded size that is broadcast. Only URLs whose bits are all set take part
in the exact join with the list, which removes the false positives. Everything is a DataFrame
expression.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
never listed, so it is allowed; repeated URLs are judged alike; an empty list blocks nothing; an
empty table gives an empty result; other columns pass through unless they bear a result's name.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import bloom
from quern.session import scope, table

# Verdict, host and path of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MADE = ("host", "path", "rule", "verdict")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Host without www., path without slashes at its end, query without utm_ parameters; no scheme
    and no fragment. Null where there is no host."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    query = F.regexp_replace(F.regexp_replace(_part(url, 3), r"^\?", "&"), r"&utm_[^&]*", "")
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), r"/+$", ""), F.regexp_replace(query, r"^&", "?")))


def verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (with ``url``) with host, path, rule and verdict. ``listed``: a column ``url``."""
    kept = [c for c in pages.columns if c not in MADE]
    # Other columns travel in a struct, so that no name of theirs meets one of these.
    out = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    rule = decided = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, decided = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    # Only what no rule decides asks the filter.
    out = out.withColumns({"rule": rule, "decided": decided}).withColumn("key", F.when(F.col("decided").isNull(), F.col("key")))
    with scope(pages.sparkSession) as s:
        keys = s.keep(table(listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct(), "listed-urls"))
        blocks = bloom.size(keys.count())
        bits = table(bloom.build(keys, "key", blocks), "listed-bits") if blocks else None
        out = s.keep(table(bloom.probe(out, "key", bits, blocks), "pages-probed", compression="zstd"))
    sure = out.filter("not _possible").withColumn("verdict", F.coalesce("decided", F.lit("allow")))
    hits = out.filter("_possible").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    hits = hits.withColumn("verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    made = [*(F.col(f"row.`{c}`").alias(c) for c in kept), *MADE]
    return sure.select(*made).unionByName(hits.select(*made))


def listed_by_label(pages: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A list: the URLs of all hosts that have one of the labels."""
    return pages.filter(F.arrays_overlap(F.split(host(F.col("url")), r"\."), F.array(*map(F.lit, labels)))).select("url")
