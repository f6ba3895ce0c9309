"""URL rules by a sort-merge range join.

A rule is a host and a path prefix. A url's canonical keys are its host and each parent domain, with labels reversed,
followed by its path, so that "com.example.www./en/" covers an interval of sorted keys: those that begin with it. Rules
on one host nest or are apart. Sorting keys and rule starts together and carrying along the stack of rules that are open
at the last start gives, at each key, the rules that can hold it; the innermost that does is the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RULES = "host string, path string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to / ? # or the end, A-Z lower-cased) and path (then up to ? or #); both empty without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, upper, lower), path


def reversed_host(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Rules with the paths of their own host's rules that contain them, outermost first and themselves last.

    A chain is found by an equality join of every rule with the proper prefixes of its path, so it is as long as rules
    nest. Of rules that agree in host and path, the one with the smallest verdict counts; a null host or path is no rule.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    inner = rules.select("host", F.col("path").alias("inner"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("path"))
    outer = F.struct(F.length("path").alias("n"), "path", "verdict")
    stacks = inner.join(rules, ["host", "path"]).groupBy("host", "inner").agg(F.sort_array(F.collect_list(outer)).alias("stack"))
    return stacks.select(F.col("host").alias("level"), F.col("inner").alias("path"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of the longest rule that fits each url: (id, url, host, path, rule, verdict), one row for each row of pages.

    A rule fits its host and all subdomains if the path begins with the rule's; of those that fit, the one with most
    characters of host and path wins, then the longer host. Without a rule, `rule` is null and the verdict `default`.
    A null url has an empty host and path. Equal rows are judged once and returned as often as they came. Only `id` and
    `url` are read, so other columns of pages can't clash. An empty table gives no rows; without rules all get `default`.

    Rules go to the slices of their host's urls; a host has slices in proportion to its share of all rows, so no window
    holds more than a fixed share of the input, however hot a host is.
    """
    spark = pages.sparkSession
    pieces = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url")).groupBy("id", "url").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"host": host, "path": path})
    stacks = rule_stacks(rules)
    # only a host's last labels, as many as the longest host of a rule has, can be a rule's
    deepest = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 1
    labels = F.split("host", "\\.")
    last = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.lit(deepest))
    own = F.transform(F.sequence(F.lit(1), F.size(last)), lambda n: F.array_join(F.slice(last, n, F.lit(deepest)), "."))
    levels = rows.withColumn("level", F.explode(own))
    # how many slices the urls under a rule's host get: counts of hosts meet in the map tasks first
    hosts = stacks.select("level").distinct()
    sizes = levels.groupBy("level").agg(F.count("*").alias("n")).join(hosts, "level")
    whole = rows.agg(F.count("*").alias("total"))
    sizes = sizes.crossJoin(F.broadcast(whole)).select("level", F.ceil(F.col("n") * pieces / F.col("total")).cast("int").alias("slices"))
    keys = levels.join(sizes, "level").select("level", F.pmod(F.xxhash64("id", "url"), F.col("slices")).alias("slice"), F.concat(reversed_host(F.col("level")), "path").alias("key"), F.lit(1).alias("kind"), "path", "id", "url", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.join(sizes, "level").select("level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint") - 1)).alias("slice"), F.concat(reversed_host(F.col("level")), "path").alias("key"), F.lit(0).alias("kind"), "path", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("url"), "stack")
    sweep = Window.partitionBy("level", "slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = keys.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    best = swept.withColumn("fits", fits).where(F.size("fits") > 0).withColumn("best", F.element_at("fits", -1))
    found = best.select("id", "url", F.struct((F.length("level") + F.col("best.n")).alias("n"), F.length("level").alias("m"), F.concat("level", "best.path").alias("rule"), F.col("best.verdict").alias("verdict")).alias("found"))
    none = F.lit(None).cast(found.schema["found"].dataType)
    either = rows.select("id", "url", "copies", none.alias("found")).unionByName(found.withColumn("copies", F.lit(0).cast("bigint")))
    chosen = either.groupBy("id", "url").agg(F.max("found").alias("found"), F.sum("copies").alias("copies"))
    out = chosen.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.select(F.col("id").alias(id), F.col("url").alias(url), host.alias("host"), path.alias("path"), F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
