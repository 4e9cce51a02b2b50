"""URL filters: allow and block rules over hosts and path prefixes, by hashed expressions.

DataFrame functions only. Each url is expanded into its host suffixes times those of its path
prefixes whose length some rule has; an expression meets the rules by the first bytes of its SHA-256,
the full digest confirms the match, and of the rules that fit the longest decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Between host and path of a hashed expression; a host can't hold it.
_BETWEEN = "/"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table; the verdict is ``allow`` or ``block``."""
    import pyarrow as pa

    # An Arrow table becomes a local relation, whose size the planner knows.
    columns = list(zip(*rules)) or [(), (), ()]
    return spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in columns], names=["verdict", "host", "path"]))


def _key(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(_BETWEEN), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", keep: Iterable[str] = ("page_id",), default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """The columns ``keep``, then host, path, rule and verdict, for every row of ``pages``.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest
    (host and path together, then the longer host) wins, ``rule`` is its text, and ``verdict`` its
    own. Where none fits, rule is null and the verdict ``default``. A null url, or one without
    ``://``, has an empty host and path. Rows that repeat are judged each; of equal rules that
    disagree, ``block`` wins; rules with a null host or path never fit. Only the columns named are
    read, so others may clash. The rules are joined as a table of their own and broadcast only if
    Spark's size limit allows it; hot expressions then fall to the skew join.
    """
    keep = list(keep)
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    #: At most as many as a rule's path can have characters.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    hashed = rules.groupBy("host", "path").agg(F.max("verdict").alias("_verdict")).select(
        F.substring(_key(F.col("host"), F.col("path")), 1, prefix_hex).alias("_short"),
        _key(F.col("host"), F.col("path")).alias("_full"),
        (F.length("host") + F.length("path")).alias("_long"),
        F.length("host").alias("_host_long"),
        F.concat("host", "path").alias("_rule"),
        "_verdict",
    )
    rows = pages.select(F.struct(*keep).alias("_kept"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    full = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: _key(h, p))))
    wide = rows.select("_row", "_kept", "_host", "_path", F.explode_outer(full).alias("_digest"))
    met = wide.withColumn("_short", F.substring("_digest", 1, prefix_hex)).join(hashed, "_short", "left")
    best = F.when(F.col("_digest") == F.col("_full"), F.struct("_long", "_host_long", "_rule", "_verdict"))
    # All expressions of a row are in one task: this sums to one row each before the exchange.
    found = met.groupBy("_row").agg(F.first("_kept").alias("_kept"), F.first("_host").alias("host"), F.first("_path").alias("path"), F.max(best).alias("_best"))
    return found.select("_kept.*", "host", "path", F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))


#: The production query's rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by RULES."""
    from .common import read

    return judge_urls(read(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL THEN '' ELSE
           translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN url IS NULL THEN '' ELSE regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 2) END AS path,
         row_number() OVER () AS rn
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
                                ('block','example.net','/de/8'), ('block','org','/es/')),
fit AS (
  SELECT rn, h || p AS rule, verdict, row_number() OVER (PARTITION BY rn ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN (SELECT * FROM fit WHERE k = 1) f USING (rn)
"""
