"""URL filtering by a list of host and path rules, and by association rules mined from labelled URLs.

Mining finds which combinations of a URL's tokens imply a label. Rules below the confidence or support,
and rules that a shorter one covers at no less confidence, are pruned. Each rule is posted under its rarest token; a URL
looks up its tokens there and keeps the postings whose whole rule it holds.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._shared import SALTS, saved

Rule = tuple[str, str]  # verdict, host/path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null and without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. The list is part of the plan: keep it to some hundreds."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: scheme, labels of the host and their parts, segments of the path with numbers as #, query keys, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.filter(F.split(x, "-"), lambda y: y != "")).otherwise(F.array().cast("array<string>"))))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    tail = F.regexp_extract(url, "[?#].*$", 0)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))),
            F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
            F.transform(parts, lambda x: F.concat(F.lit("word:"), x)),
            F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), "[0-9]+", "#"))),
            F.transform(F.regexp_extract_all(tail, F.lit("[?&]([^=&#]*)"), 1), lambda x: F.concat(F.lit("query:"), x)),
            F.when(F.contains(tail, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.6) -> DataFrame:
    """Pruned rules (tokens, verdict, confidence, support, token to post under) from rows (tokens, label), by FP-growth over whole baskets.

    Tokens below the support are in no rule and are left out. Tokens that always occur together stand for each other in any rule, so they are one
    item; those of all baskets add nothing to other rules and are only rules of their own. So a URL's length alone does no harm. The number of
    itemsets is exponential in the frequent tokens that are independent of each other, as for any complete miner; the support bounds it. A rule that a smaller one covers at
    no less confidence is pruned.
    """
    spark = labelled.sparkSession
    rows = labelled.where("label is not null and size(tokens) > 0").select("label", F.array_distinct("tokens").alias("tokens"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "url-baskets")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double, token string")
    least = max(1, math.ceil(min_support * total))
    each = rows.select("row", F.explode("tokens").alias("token"))
    # The sums of two hashes of its rows tell which tokens are in the same ones. At most (tokens a URL) / min_support tokens are left.
    sums = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"same{k}") for k in (0, 1)]
    often = saved(each.groupBy("token").agg(F.count("*").alias("count"), *sums).where(F.col("count") >= least), "url-tokens")
    items = saved(often.groupBy("count", "same0", "same1").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members")).select("item", "members", "count"), "url-items")
    parts = items.where(F.col("count") < total).select(F.col("item").alias("token"))
    held = each.join(parts, "token").groupBy("row").agg(F.collect_list("token").alias("t"))
    verdict = F.array(F.concat(F.lit("="), "label"))
    baskets = rows.select("row", "label").join(held, "row", "left").select(F.coalesce(F.concat("t", verdict), verdict).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where("startswith(consequent[0], '=') AND NOT exists(antecedent, x -> startswith(x, '='))")
    rules = found.select(F.array_sort("antecedent").alias("of"), F.substring(F.element_at("consequent", 1), 2, 1 << 20).alias("verdict"), "confidence", "support")
    shares = rows.groupBy(F.col("label").alias("verdict")).agg((F.count("*") / total).alias("confidence")).where((F.col("confidence") >= min_confidence) & (F.col("confidence") * total >= least - 0.5))
    everywhere = items.where(F.col("count") == total).withColumn("all", F.lit(total)).join(shares.withColumn("all", F.lit(total)), "all")
    rules = saved(rules.unionByName(everywhere.select(F.array("item").alias("of"), "verdict", "confidence", F.col("confidence").alias("support"))), "url-rules")
    # A rule goes if dropping one of its items leaves a rule of the same verdict that is as sure: chains of such steps cover all subsets.
    shorter = rules.select(F.col("of").alias("fewer"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    steps = rules.where("size(of) > 1").select("*", F.explode(F.expr("transform(of, x -> filter(of, y -> y != x))")).alias("fewer"))
    covered = steps.join(shorter, (steps.fewer == shorter.fewer) & (F.col("verdict") == F.col("same")) & (F.col("sure") >= F.col("confidence"))).select("of", "verdict").distinct()
    kept = rules.join(covered, ["of", "verdict"], "left_anti")
    members = kept.select("*", F.explode("of").alias("item")).join(items, "item").groupBy("of", "verdict", "confidence", "support").agg(F.collect_list("members").alias("members"))
    every = F.expr("aggregate(members, array(cast(array() as array<string>)), (so_far, m) -> flatten(transform(so_far, a -> transform(m, x -> concat(a, array(x))))))")
    told = members.select(F.explode(every).alias("tokens"), "verdict", "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    posted = told.withColumn("token", F.explode("tokens")).join(often.select("token", "count"), "token")
    return saved(posted.groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("token")), "url-index")


def match(urls: DataFrame, index: DataFrame, broadcast_rows: int = 20_000, common: int = 1000) -> DataFrame:
    """(url, verdict, confidence) for each distinct url of rows (url, tokens) that a rule fits.

    The surest rule decides; equal ones by support, then more tokens, then the larger verdict. The index is broadcast only if it has at most
    broadcast_rows rows. Else both sides are shuffled by token and salt, and tokens of over 1 / common of the URLs that no rule is posted under (a list of
    at most `common` tokens for each of a URL's tokens) stay out of the shuffle.
    """
    small = index.limit(broadcast_rows + 1).count() <= broadcast_rows
    rules = index.select("token", F.col("tokens").alias("needs"), "verdict", "confidence", "support")
    held = urls.select("url", "tokens").dropDuplicates(["url"]).withColumn("token", F.explode("tokens"))
    if small:
        hits = held.join(F.broadcast(rules), "token")
    else:
        held = saved(held, "url-held")
        often = held.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") * common > held.select("url").distinct().count())
        idle = often.join(rules.select("token").distinct(), "token", "left_anti").select("token")
        held = held.join(F.broadcast(idle), "token", "left_anti").withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        hits = held.join(rules.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).hint("merge"), ["token", "salt"])
    best = hits.where(F.size(F.array_except("needs", "tokens")) == 0).groupBy("url").agg(F.max(F.struct("confidence", "support", F.size("needs").alias("n"), "verdict")).alias("best"))
    return best.select("url", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))


RULES: list[Rule] = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence for rows (page_id, url).

    The rule list decides first, and the URLs it decides are the labels that association rules are mined from. They decide
    the rest; a URL that no rule of either kind fits gets the default. A null url and one without :// have an empty host and path, no
    tokens and the default. confidence: of the mined rule that decided, else null. Other columns of pages are left out, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = list_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("listed"))
    tokens = F.when(F.instr("url", "://") > 0, url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    index = mine(rows.where("listed is not null").select(tokens.alias("tokens"), F.col("listed").alias("label")), **mining)
    mined = match(rows.where("listed is null and url is not null").select("url", tokens.alias("tokens")), index)
    out = rows.join(mined.withColumnRenamed("url", "_lf_url"), F.col("listed").isNull() & (F.col("url") == F.col("_lf_url")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"), "confidence")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all pages' URLs."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)
