"""URL allow and block rules by a sort-merge range join.

A rule is a host and a path prefix; it fits its host and all subdomains. Keys are canonical: the host's labels
reversed, then the path, so the urls that one host's rule fits form one interval of the sorted keys. A url is asked
once for each of its parent hosts (a.b.org: org, org.b, org.b.a), since the labels below the rule's host would
otherwise stand between host and path. Rules and asked keys are then sorted together and swept: the latest rule that
began at or before a key carries the stack of rules nested around it, and the longest of the stack that the key
starts with is the rule that wins. No rule can be missing from that stack: a rule that is a prefix of the key is also
a prefix of every rule that sorts between the two.

Keys are made distinct before anything is shuffled by host; a host with many keys is swept in several salted runs,
each with its own copy of that host's rules, and with at least as many keys as rules. Everything is DataFrame operations.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; an empty path starts with
no rule's path; of equal rules with different verdicts `block` wins; among fitting rules the longest host and path
together wins, then the longer host; repeated pages give repeated rows; without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabiya.llm.common import ascii_lower, table, written

#: Above so many hosts with rules they are joined by sorting and not broadcast. Keys of a host in one sweep.
BROADCAST_HOSTS, KEYS_PER_SWEEP = 100_000, 2_000
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def parents(host: Column) -> Column:
    """The reversed keys of a host and its parent hosts."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule, verdict) as host_key, path and the stack of rules nested around each, shortest first."""
    at = F.locate("/", F.col("rule"))
    split = rules.where(F.col("rule").isNotNull()).select(
        reversed_host(ascii_lower(F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule")))).alias("host_key"),
        F.when(at > 0, F.substring("rule", at, F.length("rule"))).otherwise(F.lit("/")).alias("path"),
        "rule",
        "verdict",
    )
    unique = split.groupBy("host_key", "path").agg(F.max(F.struct("verdict", "rule")).alias("v"))
    one = unique.select("host_key", "path", F.col("v.rule").alias("rule"), F.col("v.verdict").alias("verdict"))
    lengths = one.groupBy("host_key").agg(F.collect_set(F.length("path")).alias("lengths"))
    around = one.join(lengths, "host_key").select(
        "host_key", F.col("path").alias("inner_path"), F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    )
    around = around.select("host_key", "inner_path", F.expr("left(inner_path, n)").alias("path"))
    entry = F.struct(F.length("path").alias("n"), "path", "rule", "verdict")
    return (
        around.join(one, ["host_key", "path"])
        .groupBy("host_key", F.col("inner_path").alias("path"))
        .agg(F.sort_array(F.collect_list(entry)).alias("stack"))
    )


def judge(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and verdict of the distinct (host, path) keys that some rule fits."""
    ruled = written(canonical_rules(rules), "rules")
    asked = keys.select("host", "path", F.explode(parents(F.col("host"))).alias("host_key"))
    rule_hosts = ruled.groupBy("host_key").agg(F.count("*").alias("n_rules"))
    few = rule_hosts.count() <= BROADCAST_HOSTS
    small = F.broadcast if few else (lambda frame: frame)
    counted = asked.join(small(rule_hosts), "host_key").groupBy("host_key", "n_rules").agg(F.count("*").alias("n"))
    sweeps = F.ceil(F.col("n") / F.greatest(F.lit(KEYS_PER_SWEEP), "n_rules")).cast("int")
    hosts = written(counted.select("host_key", sweeps.alias("salts")), "rule-hosts")
    runs = asked.join(small(hosts), "host_key").select(
        "host_key", F.pmod(F.xxhash64("path"), "salts").cast("int").alias("salt"), "path", "host", F.lit(1).alias("kind"), F.lit(None).cast(ruled.schema["stack"].dataType).alias("stack")
    )
    starts = ruled.join(hosts, "host_key").select(
        "host_key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "path", F.lit(None).cast("string").alias("host"), F.lit(0).alias("kind"), "stack"
    )
    sweep = Window.partitionBy("host_key", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = runs.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    best = F.element_at(F.filter("open", lambda e: F.col("path").startswith(e["path"])), -1)
    hits = swept.withColumn("open", F.coalesce("open", F.array().cast(ruled.schema["stack"].dataType)))
    hits = hits.where(F.exists("open", lambda e: F.col("path").startswith(e["path"]))).withColumn("best", best)
    longest = F.max(F.struct((F.length("host_key") + F.col("best.n")).alias("n"), F.length("host_key").alias("h"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    return hits.groupBy("host", "path").agg(longest.alias("b")).select("host", "path", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns with host, path, rule and verdict; one row for each row of pages."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    found = judge(rows.select("host", "path").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE = r"""
WITH r(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT k, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT k, r.rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.rule) DESC, length(r.host) DESC) AS place
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE place = 1) USING (k)
"""
