"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict); the rules that the registered query judges by.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Hex digits of the digest that are joined on; the full digest confirms.
PREFIX = 8
#: Parts that rows of one url, or under one rule, are split into.
SALTS = 16


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def lower_ascii(column):
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return lower_ascii(F.coalesce(host, empty)), F.coalesce(path, empty)


def _slashes(path):
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _folder(path):
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    A rule (host, path, verdict) fits its host and all subdomains if the url's
    path starts with the rule's. The longest rule (host and path together) wins;
    of equally long ones the longer host, then the larger text and verdict. No
    rule: null and ``default``.

    Each distinct url (of a salt, so that a url of most rows is no hot key)
    becomes one expression per *shape* of the rules (labels of
    the host, folders of the path), however long it is: its last labels and its
    first folders. Expressions meet rules on a short prefix of their SHA-256;
    the digest over host and whole rule path confirms. The shapes are all that
    the driver sees of the rules. The rules are an ordinary join side, there for
    every salt: Spark broadcasts them only if their size allows.

    Null or malformed urls have empty host and path and fit no rule; null ones
    pass by the joins. Repeated rows are judged each. Only page_id and url are read. An empty table, or
    no rules, is fine.
    """
    key = F.concat("host", _folder(F.col("path")))
    rules = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    ready = rules.select(
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("rule_host"),
        F.length("path").alias("rule_path"),
        F.sha2(F.concat("host", "path"), 256).alias("digest"),
        F.left(F.sha2(key, 256), F.lit(PREFIX)).alias("prefix"),
        "verdict",
    )
    shapes = sorted(
        (r.labels, r.folders)
        for r in rules.select(
            F.size(F.split("host", r"\.", -1)).alias("labels"), _slashes(F.col("path")).alias("folders")
        ).distinct().collect()
    ) or [(1, 0)]

    host, path = host_and_path(F.col("url"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")
    salted = pages.select("page_id", "url", salt)
    urls = salted.where(F.col("url").isNotNull()).select("url", "salt").distinct()
    urls = urls.select("url", "salt", host.alias("host"), path.alias("path"))
    ready = ready.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    has_labels = F.size(F.split("host", r"\.", -1))
    has_folders = _slashes(F.col("path"))
    expressions = [
        F.when(
            (F.col("host") != "") & (has_labels >= labels) & (has_folders >= folders),
            F.struct(
                F.substring_index("host", ".", -labels).alias("suffix"),
                (F.concat(F.substring_index("path", "/", folders), F.lit("/")) if folders else F.lit("")).alias("folder"),
            ),
        )
        for labels, folders in shapes
    ]
    spread = (
        urls.select("url", "salt", "path", F.explode(F.array(*expressions)).alias("e")).where("e is not null")
        .select("url", "salt", "path", "e.suffix", F.left(F.sha2(F.concat("e.suffix", "e.folder"), 256), F.lit(PREFIX)).alias("prefix"))
    )
    fits = spread.join(ready, ["prefix", "salt"]).where(
        F.sha2(F.concat("suffix", F.left("path", F.col("rule_path"))), 256) == F.col("digest")
    )
    best = fits.groupBy("url", "salt").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule_host", "rule", "verdict")).alias("best")
    ).select("url", "salt", "best.rule", "best.verdict")
    with_url = salted.where(F.col("url").isNotNull()).join(best, ["url", "salt"], "left")
    none = F.lit(None).cast("string")
    without = salted.where(F.col("url").isNull()).select("url", "salt", "page_id", none.alias("rule"), none.alias("verdict"))
    return with_url.select("url", "salt", "page_id", "rule", "verdict").union(without).select(
        "page_id", host.alias("host"), path.alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
