"""URL filters: a sort-merge range join over reversed-host keys, in DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains. A URL is put under
each of its host suffixes, so that under one reversed host key (``com,example,``) a rule is
exactly the interval ``[path, path + 0xFF)`` of byte strings. Sorted together, a rule's
start pushes it and its end pops it; a URL takes the top of the stack that stands there.
The longest of the tops over a URL's suffixes wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.skew import join_unique
from cairn.plans.durable import durable, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules that the query judges by.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as a table of literals."""
    rows = ", ".join("(" + ", ".join("'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.substring_index(F.substring(url, F.locate("://", url) + 3, F.length(url)), "/", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.translate(rest, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    path = F.substring(bare, F.length(F.substring_index(bare, "/", 1)) + 1, F.length(bare))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, path).otherwise("")


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), ","), F.lit(","))


def stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule with the rules around it on its host, outermost first.

    A rule's path is cut at each length that a rule of its host has, and the cuts are
    looked up with an equi-join: never a pair of rules that don't nest. Of rules with one
    host and path, a ``block`` goes before an ``allow``.
    """
    r = pick(rules, host="host", path="path", verdict="verdict").filter("host is not null and path is not null and verdict is not null")
    r = r.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = r.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    cuts = r.join(lengths, "host").select("host", F.col("path").alias("inner"), F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    cuts = cuts.select("host", "inner", F.expr("substring(`inner`, 1, n)").alias("path"))
    around = cuts.join(r, ["host", "path"]).groupBy("host", "inner").agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), F.concat("host", "path").alias("rule"), "verdict"))).alias("stack"))
    return around.select("host", F.col("inner").alias("path"), "stack")


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", rows_per_sweep: int = 20_000) -> DataFrame:
    """Host, path, the longest fitting rule (or null) and verdict of every row of ``urls``.

    Columns: those of ``keep``, host, path, rule, verdict. A rule is longer by the length of
    host and path together, then of the host. Null URLs and URLs without ``://`` have an
    empty host and path and the default verdict; repeated and tied rows each give a row;
    empty tables and empty rules are fine; other columns don't matter.

    Only distinct (host, path) pairs are swept, under suffixes that have a rule. A suffix
    with more rows than ``rows_per_sweep`` (``com,``) is dealt into as many sweeps as it
    takes, each with the suffix's rules: no task holds a whole hot host.
    """
    named = {f"_keep{i}": k for i, k in enumerate(keep)}
    u = pick(urls, _url=url_col, **named)
    u = u.select(*named, host_of(F.col("_url").cast("string")).alias("_host"), path_of(F.col("_url").cast("string")).alias("_path"))
    s = stacks(rules)

    pairs = u.filter("_host <> ''").select("_host", "_path").distinct()
    labels = F.split("_host", "\\.", -1)
    levels = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    under = pairs.select("_host", "_path", F.explode(levels).alias("_suffix"))
    keys = s.select(F.col("host").alias("_suffix")).distinct()
    under = under.join(keys, "_suffix", "left_semi").withColumn("_key", _reversed(F.col("_suffix")))
    counts = durable(under.groupBy("_key").agg(F.count(F.lit(1)).alias("__n")), "suffixes")
    counted = counts.select("_key", F.ceil(F.col("__n") / rows_per_sweep).cast("int").alias("_sweeps"))
    total = int(counts.agg(F.sum("__n")).first()[0] or 0)

    start = s.select(_reversed(F.col("host")).alias("_key"), F.encode("path", "UTF-8").alias("_at"), F.lit(1).alias("_kind"), "stack")
    # A rule's end gives the stack back as it was before: the rules around it.
    end = start.select("_key", F.concat("_at", F.lit(b"\xff")).alias("_at"), F.lit(0).alias("_kind"), F.slice("stack", 1, F.size("stack") - 1).alias("stack"))
    events = start.unionByName(end).join(counted, "_key").withColumn("_sweep", F.explode(F.sequence(F.lit(0), F.col("_sweeps") - 1)))
    none = F.lit(None)
    events = events.select("_key", "_sweep", "_at", "_kind", "stack", none.cast("string").alias("_host"), none.cast("string").alias("_path"))
    rows = join_unique(under, counted, "_key", total, inner=True, counts=counts).select(
        "_key",
        F.pmod(F.xxhash64("_host", "_path"), F.col("_sweeps")).cast("int").alias("_sweep"),
        F.encode("_path", "UTF-8").alias("_at"),
        F.lit(2).alias("_kind"),
        none.cast(s.schema["stack"].dataType).alias("stack"),
        "_host",
        "_path",
    )
    # One column, so that rows that a join has dealt by suffix are dealt again by sweep.
    sweep = Window.partitionBy("_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(rows).withColumn("_part", F.struct("_key", "_sweep")).withColumn("_stack", F.last("stack", ignorenulls=True).over(sweep)).filter("_kind = 2 and size(_stack) > 0")
    top = F.element_at("_stack", -1)
    best = F.max(F.struct(F.length(top["rule"]).alias("n"), (F.length(top["rule"]) - top["n"]).alias("h"), top["rule"].alias("rule"), top["verdict"].alias("verdict")))
    found = swept.groupBy("_host", "_path").agg(best.alias("_best"))
    # URLs without a host meet nothing, and a URL in many rows needn't move.
    key = F.when(F.col("_host") != "", F.concat_ws("\x1f", "_host", "_path")).alias("_url_key")
    found = durable(found.select(key, "_best"), "rules-found")
    return join_unique(u.withColumn("_url_key", key), found, "_url_key", u.count()).select(
        *[F.col(i).alias(k) for i, k in named.items()],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT r, x.host || x.path AS rule, x.verdict, row_number() OVER (PARTITION BY r ORDER BY length(x.host || x.path) DESC, length(x.host) DESC) AS k
  FROM h JOIN rules x ON (h.host = x.host OR ends_with(h.host, '.' || x.host)) AND starts_with(h.path, x.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f ON h.r = f.r AND f.k = 1"""
