"""URL filters by a sort-merge range join.

A rule ``(host, path)`` fits its host and all subdomains when the url's path
starts with the rule's. In canonical form a host is reversed by labels
(``www.example.com`` -> ``com.example.www``), so a rule is a prefix, that is
an interval, of the keys ``reversed host + path``. A url has one key for each
of its host's suffixes. Keys and rules are sorted together and swept: the last
rule that starts at or before a key carries the stack of rules that were open
there, and the deepest of them that still covers the key is the match.

The sweep runs in cells of (host suffix, salt): a suffix shared by many urls
is spread over as many salts as its row count asks for, and its rules are
repeated in each of them. Equal rows are counted first and swept once.

Defined cases: a null url, or one without ``://``, has empty host and path;
an empty host matches no rule; a url no rule fits gets the default verdict and
a null rule; of rules on several suffixes the longest host wins, then the
longest path; of equal rules the smaller verdict (``allow``) wins; no rules or
no pages are fine; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CELL = 256  # keys swept together, about


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    tail = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(tail, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www``."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _suffix_keys(host: Column) -> Column:
    """The reversed forms of a host and of its parent domains."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Judge every row of ``pages``. ``rules``: ``host``, ``path``, ``verdict``.
    Returns ``page_id`` (the id column), ``host``, ``path``, ``rule``, ``verdict``."""
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    same = ["id", "host", "path"]

    rule = (rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host <> '' and (path = '' or path like '/%')")
            .groupBy("host", "path").agg(F.min("verdict").alias("verdict")))
    rule = rule.select(reversed_host(F.col("host")).alias("suffix"), "path", F.struct(
        F.length("host").alias("host_len"), F.length("path").alias("path_len"),
        F.concat("host", "path").alias("rule"), "verdict", F.col("path").alias("prefix")).alias("hit"))

    cand = rows.where("host <> ''").withColumn("suffix", F.explode(_suffix_keys(F.col("host"))))
    cand = cand.join(rule.select("suffix").distinct(), "suffix", "left_semi")
    cand = stage(cand, "url-keys")
    per = cand.groupBy("suffix").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("salts"))
    per = stage(per, "url-salts")
    keys = (cand.join(per, "suffix")
            .withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.col("salts")))
            .select("suffix", "salt", "path", F.lit(1).alias("is_key"), *[F.col(c).alias(f"k_{c}") for c in same],
                    F.lit(None).cast(rule.schema["hit"].dataType).alias("hit")))
    starts = (rule.join(per, "suffix").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
              .select("suffix", "salt", "path", F.lit(0).alias("is_key"),
                      *[F.lit(None).cast(rows.schema[c].dataType).alias(f"k_{c}") for c in same], "hit"))
    line = Window.partitionBy("suffix", "salt").orderBy("path", "is_key")
    up_to = line.rowsBetween(Window.unboundedPreceding, 0)
    opened = _with_stacks(rule)
    both = keys.unionByName(starts)
    swept = both.withColumn("last", F.last(F.when(F.col("is_key") == 0, F.col("hit.rule")), True).over(up_to))
    found = (swept.where("is_key = 1 and last is not null").join(opened, "last")
             .withColumn("best", F.try_element_at(F.filter("stack", lambda h: F.col("path").startswith(h["prefix"])), F.lit(-1)))
             .where("best is not null"))
    hits = found.select(*[F.col(f"k_{c}").alias(c) for c in same], "best", F.lit(0).alias("n"))
    every = rows.select(*same, F.lit(None).cast(rule.schema["hit"].dataType).alias("best"), F.lit(1).alias("n"))
    judged = every.unionByName(hits).groupBy(*same).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    copies = judged.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _with_stacks(rule: DataFrame) -> DataFrame:
    """``last``, ``stack``: of every rule, the rules open where it starts, by
    growing length, itself last. A rule is open on another when its path is
    a prefix of the other's, so each rule looks up its own prefixes."""
    r = rule.select("suffix", "path", "hit")
    inner = r.select("suffix", F.col("hit.rule").alias("last"), F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("path"))
    return (inner.join(r, ["suffix", "path"]).groupBy("last")
            .agg(F.sort_array(F.collect_list("hit")).alias("stack")))
