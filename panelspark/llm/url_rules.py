"""Association-rule filtering of URLs; DataFrame functions and Spark's FP-growth only.

A URL is a set of tokens: its top-level domain, host labels, path segments by place (numbers by their length and first
digit), file ending and query keys. FP-growth mines the token combinations of labelled URLs; rules "tokens -> label" stay
that have the support and confidence, and no rule of fewer tokens that is as sure. A URL's tokens that occur in rules are
looked up in an inverted index from tokens to rules; a rule holds when all its tokens were found, and the surest rule
decides. Only distinct sets of such tokens are matched, and the URLs look up their set's verdict.

Explicit rules go before: a rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's.

Defined cases: a null URL, or one without "://", has an empty host and path and no token; URLs that no rule decides get the
default; without labelled URLs no rule is mined; repeated rows are judged each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
#: Sets of tokens, of a few hundred bytes each, whose verdicts are sent to all tasks at most.
BROADCAST_SETS = 20_000
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct of the name and verdict of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    stem = lambda s: F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    keys = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")

    def segment(s: Column, i: Column) -> Column:
        number = stem(s).rlike("^[0-9]+$")
        shape = F.concat(F.lit("#"), F.substring(s, 1, 1), F.lit("*"), F.length(stem(s)).cast("string"))
        return F.concat(F.lit("path"), (i + 1).cast("string"), F.lit(":"), F.when(number, shape).otherwise(stem(s)))

    number_starts = F.transform(segments, lambda s, i: F.when(stem(s).rlike("^[0-9]+$"), F.concat(F.lit("path"), (i + 1).cast("string"), F.lit(":#"), F.substring(s, 1, 1))))
    found = F.concat(
        F.transform(labels, lambda x, i: F.when(i == F.size(labels) - 1, F.concat(F.lit("top:"), x)).otherwise(F.concat(F.lit("host:"), x))),
        F.transform(segments, segment),
        F.filter(number_starts, lambda x: x.isNotNull()),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^([^=]*)", 1))),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from rows of tokens and verdict: rule (sorted tokens), verdict, confidence and support.

    Support is a share of the labelled rows, and so bounds the number of frequent tokens and rules however many rows there are.
    """
    mark = "verdict="
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(mark), F.col("verdict"))).alias("items"))
    mined = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
    rules = mined.filter(F.col("consequent")[0].startswith(mark)).select(
        F.array_sort("antecedent").alias("rule"), F.regexp_replace(F.col("consequent")[0], "^" + mark, "").alias("verdict"), "confidence", "support"
    )
    rules = cut(rules, "rules")
    # A rule goes if it is no surer than one that has all its tokens but one.
    parents = rules.filter(F.size("rule") > 1).select("rule", "verdict", "confidence", F.explode("rule").alias("left_out"))
    parents = parents.select("rule", "verdict", F.col("confidence").alias("own"), F.array_sort(F.array_except("rule", F.array("left_out"))).alias("parent"))
    known = rules.select(F.col("rule").alias("parent"), "verdict", F.col("confidence").alias("general"))
    weak = parents.join(known, ["parent", "verdict"]).filter("general >= own").select("rule", "verdict").distinct()
    return rules.join(weak, ["rule", "verdict"], "left_anti")


def judge(urls: DataFrame, rules: Sequence[Rule], default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of urls (page_id, url).

    The URLs that explicit rules decide are the labelled ones; the rules mined from them judge the rest.
    """
    url = F.col("url")
    rows = urls.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("page_id", "host", "path", explicit(F.col("host"), F.col("path"), rules).alias("said"), tokens(url, F.col("host"), F.col("path")).alias("tokens"))
    mined = cut(mine(rows.filter("said IS NOT NULL").select("tokens", F.col("said.verdict").alias("verdict")), min_support, min_confidence), "mined")
    index = mined.select(F.xxhash64("rule", "verdict").alias("id"), "verdict", "confidence", "support", F.size("rule").alias("needs"), F.explode("rule").alias("token"))
    # The tokens in rules are few: each is in at least min_support of the labelled rows.
    vocabulary = index.agg(F.sort_array(F.collect_set("token")).alias("known")).first()["known"]
    in_rules = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    rows = rows.withColumn("found", F.when(F.col("said").isNull(), F.array_sort(F.array_intersect("tokens", in_rules))))
    sets = rows.filter("found IS NOT NULL AND size(found) > 0").select("found").distinct()
    hits = sets.select("found", F.explode("found").alias("token")).join(index, "token")
    held = hits.groupBy("found", "id").agg(F.count("*").alias("n"), F.first("needs").alias("needs"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    best = held.filter("n = needs").groupBy("found").agg(F.max(F.struct("confidence", "support", "needs", "verdict")).alias("best")).select("found", F.col("best.verdict").alias("mined"))
    # Sets of tokens are few; should they be many, each verdict is copied to SALTS places, to which a set's URLs are dealt.
    best = cut(best, "verdicts")
    if best.count() <= BROADCAST_SETS:
        judged = rows.join(F.broadcast(best), "found", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
        judged = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS))).join(best.withColumn("salt", salts), ["found", "salt"], "left")
    return judged.select("page_id", "host", "path", F.col("said.rule").alias("rule"), F.coalesce(F.col("said.verdict"), F.col("mined"), F.lit(default)).alias("verdict"))
