"""Which names and texts of a document can be alike: a q-gram index with length and count filters, and a substring index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.written import saved

# What stands before and behind a string, so that its first and last letters make pairs too.
BEFORE, BEHIND = "\x02", "\x03"


def _pairs_of_letters(c: Column) -> Column:
    """The different pairs of neighbouring characters; none of strings under two characters."""
    n = F.length(c)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    return F.array_distinct(F.when(n >= 2, every).otherwise(F.slice(every, 1, 0)))


def grams(c: Column) -> Column:
    """The different pairs of neighbouring characters, with marks at both ends. An edit changes two of them at most."""
    return _pairs_of_letters(F.concat(F.lit(BEFORE), c, F.lit(BEHIND)))


def _prefix(least: float) -> Column:
    """How many of a string's rarest grams hold one that it shares with any string of that similarity; null if it need not share any.

    A partner is at most length / least long, so there are at most (1 - least) * length / least edits, and each takes two grams.
    """
    lost = F.floor(2 * (1 - least) / least * F.col("size") + 1e-9).cast("int")
    return F.when(F.size("grams") > lost, lost + 1)


def indexed(names: DataFrame, texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Names and texts with their grams by rarity among the document's texts, and the rarest pair of letters inside them.

    The order is one for both sides, (frequency, gram), which prefixes of ordered sets need.
    """
    said = [df.select("doc_id", "norm", F.length("norm").alias("size"), grams(F.col("norm")).alias("g"), _pairs_of_letters(F.col("norm")).alias("inner")) for df in (names, texts)]
    often = said[1].select("doc_id", F.explode("g").alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("n"))
    out = []
    for df in said:
        each = df.select("doc_id", "norm", "size", "inner", F.explode("g").alias("gram")).join(often, ["doc_id", "gram"], "left")
        each = each.groupBy("doc_id", "norm").agg(F.first("size").alias("size"), F.first("inner").alias("inner"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
        inside = F.filter("g", lambda x: F.array_contains("inner", x["gram"]))
        out.append(each.select("doc_id", "norm", "size", "inner", F.col("g.gram").alias("grams"), F.get(inside, F.lit(0))["gram"].alias("rarest")).withColumn("prefix", _prefix(least)))
    return out[0], out[1]


def alike(names: DataFrame, texts: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, norm, text): all pairs of a document that can have a similarity of at least `least`, or of which one holds the other.

    names, texts: doc_id and norm, each pair of these once. Similar pairs share a gram of both prefixes, are near enough in length, and share enough
    grams; a string is held only where its rarest pair of letters is. Strings that repeat few grams too often for a prefix meet all others, as do
    empty ones; single characters meet the strings with that character.
    """
    a, b = (saved(df, "grams") for df in indexed(names, texts, least))
    n, t = (df.where("prefix IS NOT NULL").select("doc_id", "norm", "size", "grams", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram")) for df in (a, b))
    near = n.alias("n").join(t.alias("t"), ["doc_id", "gram"]).select("doc_id", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "nt" for c in ("norm", "size", "grams")))
    longer, shorter = F.greatest("n_size", "t_size"), F.least("n_size", "t_size")
    edits = F.floor((1 - least) * longer + 1e-9)
    shared = F.size(F.array_intersect("n_grams", "t_grams"))
    enough = (longer - shorter <= edits) & (F.greatest(F.size("n_grams"), F.size("t_grams")) - shared <= 2 * edits)
    pairs = [near.where(enough).select("doc_id", F.col("n_norm").alias("norm"), F.col("t_norm").alias("text"))]

    def holding(inner: DataFrame, outer: DataFrame, names_inside: bool) -> DataFrame:
        letters = F.array_distinct(F.split("norm", ""))
        place = outer.select("doc_id", F.col("norm").alias("outer"), F.explode(F.array_union("inner", letters)).alias("key"))
        seek = inner.where("size > 0").select("doc_id", F.col("norm").alias("inside"), F.when(F.col("size") == 1, F.col("norm")).otherwise(F.col("rarest")).alias("key"))
        met = seek.join(place, ["doc_id", "key"]).where(F.contains("outer", "inside"))
        return met.select("doc_id", F.col("inside" if names_inside else "outer").alias("norm"), F.col("outer" if names_inside else "inside").alias("text"))

    pairs += [holding(a, b, True), holding(b, a, False)]
    # Few: strings such as aaaaaaa, and empty ones.
    odd = "size = 0 OR prefix IS NULL"
    pairs.append(a.where(odd).select("doc_id", "norm").join(b.select("doc_id", F.col("norm").alias("text")), "doc_id"))
    pairs.append(a.select("doc_id", "norm").join(b.where(odd).select("doc_id", F.col("norm").alias("text")), "doc_id"))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.distinct()
