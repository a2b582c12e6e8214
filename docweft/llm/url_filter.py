"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is filed under that of its literal tokens which the fewest addresses have. The tokens of an address
fetch the rules filed under them by an equi-join, and only those rules run their regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.shared import hint, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path rules of the registered query.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The method's own patterns for addresses without such a rule: a whole token of the host, and the regular expression.
HOST_PATTERNS = tuple((word, rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|$)") for word in ("adult", "bet", "bets", "casino", "gambling", "jackpot", "poker", "porn", "slots", "xxx"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    """Distinct runs of letters and digits; the empty token stands for rules without a literal."""
    return F.array_distinct(F.split(F.concat(F.lit(" "), text), r"[^\p{L}\p{N}]+"))


def host_rules(rules: DataFrame) -> DataFrame:
    """Rules such as ``example.net/en/`` (columns ``rule``, ``verdict``) as patterns over host and path.

    A rule fits its host, all subdomains, and paths that begin with its path. The last token of a path that does
    not end in a separator may go on, so it is no literal token.
    """
    host = F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    quoted = lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}])", r"\\$1")
    fits = F.when(path == "", F.lit("(?:/|$)")).otherwise(quoted(path))
    sure = F.concat(host, F.lit("/"), F.regexp_replace(path, r"[\p{L}\p{N}]+$", ""))
    return rules.select("rule", "verdict", F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host), fits).alias("pattern"), tokens_of(sure).alias("tokens"), F.lit(1).alias("rank"))


def patterns(spark: SparkSession, words: tuple[tuple[str, str], ...] = HOST_PATTERNS) -> DataFrame:
    """The method's own patterns: they block, and any rule outranks them."""
    rows = spark.createDataFrame(list(words), "token string, pattern string")
    return rows.select(F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), "pattern", F.array("token").alias("tokens"), F.lit(0).alias("rank"))


def index_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under the one of its tokens that the fewest addresses have; of equals, the first in order."""
    filed = rules.select("*", F.explode(F.when(F.size(F.array_remove("tokens", "")) > 0, F.array_remove("tokens", "")).otherwise(F.array(F.lit("")))).alias("token"))
    wanted = filed.select("token").distinct()
    counts = addresses.select(F.explode("tokens").alias("token")).join(hint(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    counted = filed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min_by("token", F.struct("n", "token")).alias("token")
    return counted.groupBy("rank", "rule", "verdict", "pattern").agg(rarest)


def filter_urls(pages: DataFrame, rules: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, the longest rule that fits (else null) and its verdict, else the method's.

    A null url, or one without ``://``, has an empty host and path. Null ids and repeated rows are judged like any
    other; of equally long rules the last in order of their text counts; without rules the method alone decides; an
    empty table gives an empty result; further columns are ignored. Equal addresses are judged once.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    addresses = judged.select("host", "path").distinct().withColumn("tokens", tokens_of(F.concat_ws("/", "host", "path")))
    every = host_rules(rules)
    every = every.unionByName(patterns(pages.sparkSession) if own is None else own)
    index = hint(written(index_rules(addresses, every), "rule-index"))
    fetched = addresses.select("host", "path", F.explode("tokens").alias("token")).join(index, "token")
    fits = fetched.filter(F.expr("concat(host, path) rlike pattern"))
    best = F.max(F.struct("rank", F.length("rule").alias("long"), "rule", "verdict")).alias("best")
    found = written(fits.groupBy("host", "path").agg(best), "url-verdicts")
    out = judged.join(found, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))


_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "|".join(word for word, _ in HOST_PATTERNS)
ORACLE_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in HOST_RULES)}),
parts AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
judged AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)') THEN 'block' ELSE '{DEFAULT}' END) AS verdict
FROM judged LEFT JOIN LATERAL (
  SELECT rule, verdict FROM parts
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY length(rule) DESC LIMIT 1) AS r ON true
"""
