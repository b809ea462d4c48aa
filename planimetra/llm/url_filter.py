"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

URLs that a rule decides are the labelled ones. Trees boosted on features of the URL alone
(length, depth, digit ratio, entropy, parameter and label counts, statistics of its suffix)
judge those that no rule fits.

Defined cases: a null URL, or one without ://, has an empty host and path, fits no rule and
is judged like any other; of rules that fit, the longest holds; repeated rows are judged
alike; if the labelled URLs are all of one verdict, that verdict goes to the rest, and
without any, they are allowed; a very long URL is judged whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, small_or_not

#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Most labelled URLs that are learned from (those with the least hashes), trees and their depth.
SAMPLE, TREES, DEPTH = 20_000, 10, 4

FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "symbols", "longest_label", "https", "suffix_share", "suffix_hosts")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)\A.*?://", ""), "#", 1)).otherwise("")
    after = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    host = F.substring_index(after, "/", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.substr(after, F.length(host) + 1)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + start)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """pages (with url, host and path) with the FEATURES; suffix is the host's last two labels."""
    url = F.coalesce("url", F.lit(""))
    count = lambda pattern, of: F.regexp_count(of, F.lit(pattern)).cast("double")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    label_lengths = F.transform(F.split("host", r"\."), lambda x: F.length(x))
    rows = pages.withColumns({
        "suffix": F.substring_index("host", ".", -2), "length": n, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count("/[^/]", F.col("path")), "digit_ratio": count("[0-9]", url) / n, "entropy": entropy, "parameters": count(r"[?&][^=&#]+=", url),
        "labels": F.size(F.split("host", r"\.")).cast("double"), "hyphens": count("-", F.col("host")), "symbols": count(r"[^A-Za-z0-9:/.\-]", url),
        "longest_label": F.array_max(label_lengths).cast("double"), "https": url.startswith("https:").cast("double"),
    })
    # how common the suffix is, and how many hosts have it
    by_suffix = rows.groupBy("suffix").agg(F.count("*").alias("pages"), F.approx_count_distinct("host").alias("hosts"))
    by_suffix = materialise(by_suffix.select(F.col("suffix").alias("_suffix"), F.log1p("pages").alias("_pages"), F.log1p("hosts").alias("suffix_hosts")))
    total = by_suffix.agg(F.max("_pages")).first()[0] or 1.0
    joined = rows.join(small_or_not(by_suffix), rows.suffix == F.col("_suffix"), "left")
    return joined.withColumn("suffix_share", F.coalesce(F.col("_pages"), F.lit(0.0)) / total).withColumn("suffix_hosts", F.coalesce("suffix_hosts", F.lit(0.0))).drop("_suffix", "_pages")


def learned(pages: DataFrame, rules: tuple = RULES) -> tuple[DataFrame, GBTClassificationModel | str]:
    """page_id, host, path, rule, ruled (the rule's verdict) and FEATURES of each page, and the
    trees, or the only verdict (allow, if there is none) where the labelled URLs don't have both."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = materialise(lexical(rows.withColumns({"rule": rule, "ruled": verdict})).select("page_id", "host", "path", "rule", "ruled", F.xxhash64("url").alias("url_hash"), *FEATURES))
    labelled = rows.where("ruled is not null").orderBy("url_hash", "page_id").limit(SAMPLE)
    labelled = materialise(labelled.select((F.col("ruled") == "block").cast("double").alias("label"), *FEATURES))
    kinds = [r[0] for r in labelled.select("label").distinct().collect()]
    if len(kinds) < 2:
        return rows, "block" if kinds == [1.0] else "allow"
    return rows, GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, cacheNodeIds=False).fit(_vectors(labelled))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict."""
    rows, model = learned(pages, rules)
    if isinstance(model, str):
        rest = F.lit(model)
    else:
        rows = model.transform(_vectors(rows))
        rest = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", rest).alias("verdict"))
