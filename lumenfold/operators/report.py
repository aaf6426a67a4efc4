"""Grouped summaries, first rows, totals, pages, packing and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.written import saved


def summarize(df: DataFrame, keys: list[str], sums: list[str], order: str, first: list[str] | None = None, money: str = "decimal(18,2)") -> DataFrame:
    """Sums of each group, the group's first attributes by order, and its first order as `first_seen`."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.col(c).cast(money)).alias(c) for c in sums],
        *[F.min_by(c, order).alias(c) for c in first or []],
        F.min(order).alias("first_seen"),
    )


def totals(df: DataFrame, sums: list[str], money: str = "decimal(18,2)") -> DataFrame:
    return df.agg(*[F.sum(F.col(c).cast(money)).alias(c) for c in sums])


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "running", money: str = "decimal(18,2)") -> DataFrame:
    """df with the sum of value up to each row of its group."""
    rows = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.col(value).cast(money)).over(rows))


def first_per_key(df: DataFrame, key: str, order: str, trim: bool = False) -> DataFrame:
    """The first row of each key by order; blank keys drop out. trim: keep the trimmed key."""
    clean = F.trim(F.col(key).cast("string"))
    rows = df.where(clean.isNotNull() & (clean != "")).withColumn("_lf_key", clean)
    best = rows.groupBy("_lf_key").agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("_lf_key", "r.*")
    return best.withColumn(key, F.col("_lf_key")).drop("_lf_key") if trim else best.drop("_lf_key")


def numbered(df: DataFrame, order: list[Column | str], partition: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Rows numbered from 1 within each partition. Without a partition, by ranges that are written and counted first.

    The ranges make a global order without one task that holds all rows; they are written as another run of the same plan may
    draw other bounds. The counts that are broadcast are one row for each range.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = saved(ranged.withColumn("_lf_p", F.spark_partition_id()).withColumn("_lf_i", place), "ranges")
    counts = rows.groupBy("_lf_p").agg(F.count("*").alias("_lf_n"))
    # One row for each range: few enough for one task, which sums them up as it goes.
    before = counts.select("_lf_p", (F.sum("_lf_n").over(Window.orderBy("_lf_p")) - F.col("_lf_n")).alias("_lf_before"))
    out = rows.join(F.broadcast(before), "_lf_p")
    return out.withColumn(name, (F.col("_lf_before") + F.col("_lf_i") + 1).cast("long")).drop("_lf_p", "_lf_i", "_lf_before")


def page_of(rn: Column, size: int, first: int | None = None) -> Column:
    """The page from 0 of row rn (from 1); the first page may have another size."""
    if first is None:
        return F.floor((rn - 1) / size)
    return F.when(rn <= first, 0).otherwise(1 + F.floor((rn - 1 - first) / size))


def pages(
    df: DataFrame, order: str, items: list[str], size: int = 16, first: int | None = None, partition: list[str] | None = None, extra_pages: int = 0, parents: DataFrame | None = None,
) -> DataFrame:
    """A row for each page: its ordered items, whether it is the first, and the number of pages (plus extra_pages).

    Nothing to show gives one empty page: without a partition for an empty df, with one for each row of parents (the partition's columns, and any others,
    which are copied to the pages) that df has no rows of.
    """
    keys = partition or []
    rows = numbered(df, [order], partition).withColumn("page", page_of(F.col("rn"), size, first).cast("int"))
    made = rows.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(F.struct("rn", *items))).alias("items"))
    if parents is None and not keys:
        parents = df.sparkSession.range(1).select()
    if parents is not None:
        made = parents.join(made, keys, "left") if keys else parents.join(made, F.lit(True), "left")
    count = rows.groupBy(*keys).agg((F.max("page") + 1).alias("pages"))
    out = made.join(count, keys, "left") if keys else made.crossJoin(F.broadcast(count))
    kind = made.schema["items"].dataType
    filled = {"page": F.coalesce("page", F.lit(0)), "items": F.coalesce("items", F.array().cast(kind)), "pages": F.coalesce("pages", F.lit(1)) + extra_pages}
    return out.withColumns(filled).withColumn("first", F.col("page") == 0)


def full_chunks(df: DataFrame, order: str, size: int, partition: list[str], first: int | None = None, full_only: bool = True) -> DataFrame:
    """df with rn and chunk; with full_only, rows of a last chunk that isn't full drop out."""
    rows = numbered(df, [order], partition).withColumn("chunk", page_of(F.col("rn"), size, first).cast("int"))
    if not full_only:
        return rows
    have = F.count("*").over(Window.partitionBy(*partition, "chunk"))
    need = F.when(F.col("chunk") == 0, first or size).otherwise(size)
    return rows.withColumn("_lf_n", have).where(F.col("_lf_n") == need).drop("_lf_n")


def _paged(items: Column, start: Column, step) -> Column:
    """The page of each item: step(state, item) gives the state behind the item, with `page` and whether the item is `new` on it.

    Only the places where pages begin are gathered, so a text of many lines isn't copied for each line.
    """
    made = F.aggregate(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), start, step, lambda s: F.concat(s["begins"], F.array(F.size(items))))
    # The pages' lengths by their neighbours, of a value that is computed once.
    sizes = lambda b: F.zip_with(F.slice(b, 2, F.size(b)), F.slice(b, 1, F.size(b) - 1), lambda end, begin: end - begin)
    pages = F.transform(F.array(made), lambda b: F.flatten(F.transform(sizes(b), lambda n, k: F.array_repeat(k, n))))
    return F.element_at(pages, 1)


def packed_pages(sizes: Column, capacity: int = 14, per_line: int = 90, most: int = 10) -> Column:
    """The page of each item of an ordered array of text lengths: a page ends before its characters fill capacity lines, or at most items.

    An item that fits no page gets one of its own.
    """
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("begins"))

    def step(s: Column, item: Column) -> Column:
        size = item["x"]
        new = (item["i"] == 0) | ((s["chars"] + size) / per_line >= capacity) | (s["n"] >= most)
        begins = F.when(new, F.concat(s["begins"], F.array(item["i"]))).otherwise(s["begins"])
        return F.struct(F.when(new, size).otherwise(s["chars"] + size).cast("long").alias("chars"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), begins.alias("begins"))

    return _paged(sizes, start, step)


def height_pages(heights: Column, capacity: float, header: float = 0.0) -> Column:
    """packed_pages by heights: each page has a header of the given height."""
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("begins"))

    def step(s: Column, item: Column) -> Column:
        h = item["x"]
        new = (item["i"] == 0) | (s["used"] + h > capacity)
        begins = F.when(new, F.concat(s["begins"], F.array(item["i"]))).otherwise(s["begins"])
        return F.struct(F.when(new, header + h).otherwise(s["used"] + h).alias("used"), begins.alias("begins"))

    return _paged(F.transform(heights, lambda h: h.cast("double")), start, step)


def footer_page(heights: Column, pages: Column, capacity: float, header: float, footer: float) -> Column:
    """The page of a footer behind the items on these pages: the last one if it has room, else one more; 0 without items."""
    last = F.array_max(pages)
    used = F.aggregate(F.zip_with(heights, pages, lambda h, p: F.when(p == last, h.cast("double")).otherwise(0.0)), F.lit(header), lambda a, h: a + h)
    return F.when(F.size(pages) == 0, 0).when(used + footer > capacity, last + 1).otherwise(last)


def sum_br(c: Column) -> Column:
    """Sum of money text: 1.234,56 as 1234.56, what is no number as 0."""
    clean = F.replace(F.replace(F.regexp_replace(c, "[^0-9,.-]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.sum(F.coalesce(clean.try_cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)")))


def joined_list(name: Column, detail: Column, order: Column, separator: str = "; ", only_with_detail: bool = True) -> Column:
    """Aggregate: 'name: detail' in order, joined."""
    item = F.struct(order.alias("o"), F.concat(name, F.lit(": "), F.coalesce(detail, F.lit(""))).alias("t"))
    kept = F.when(F.coalesce(detail, F.lit("")) != "", item) if only_with_detail else item
    return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), separator)


def explode_children(df: DataFrame, parent: list[str], children: str, alias: str = "child") -> DataFrame:
    """A row for each child, with the parent's columns and the number of children."""
    return df.select(*parent, F.size(children).alias("children"), F.posexplode(children).alias("idx", alias))


def product_coverages(df: DataFrame, products: str = "products", coverages: str = "coverages") -> DataFrame:
    """Products and coverages exploded; the name is the product's if it has one coverage, else the coverage's description."""
    p = df.select("*", F.posexplode(products).alias("product_idx", "_lf_p")).drop(products)
    c = p.select("*", F.posexplode(F.col(f"_lf_p.{coverages}")).alias("coverage_idx", "coverage"))
    return c.withColumn("name", F.when(F.size(F.col(f"_lf_p.{coverages}")) == 1, F.col("_lf_p.name")).otherwise(F.col("coverage.description"))).drop("_lf_p")


def rule_union(branches: list[DataFrame]) -> DataFrame:
    """UNION ALL that keeps each row's branch number."""
    out = [b.withColumn("branch", F.lit(k)) for k, b in enumerate(branches)]
    first, *rest = out
    for b in rest:
        first = first.unionByName(b)
    return first


def multi_output(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """A row for each output whose condition holds, in one pass: a row may have several outputs."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in outputs.items()]))
    return df.withColumn("output", F.explode(names))


def chart_series(df: DataFrame, key: str, order: str, label: str, value: str) -> DataFrame:
    """Labels and values of each chart in order, its largest value, and which values are under 6 % of it."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, label, value))).alias("x"))
    out = rows.select(key, F.transform("x", lambda p: p[label]).alias("labels"), F.transform("x", lambda p: p[value]).alias("data"))
    most = F.array_max("data")
    return out.withColumn("largest", most).withColumn("small", F.transform("data", lambda v: v / most < 0.06))


def in_list(df: DataFrame, key: str, codes: DataFrame, code: str, flag: str, broadcast_rows: int = 100_000) -> DataFrame:
    """df with flag: whether key is one of the codes. The codes are broadcast if there are at most broadcast_rows."""
    known = codes.select(F.col(code).alias("_lf_code")).distinct()
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    known = known.withColumn("_lf_in", F.lit(True))
    out = df.join(F.broadcast(known) if small else known, df[key] == known["_lf_code"], "left")
    return out.withColumn(flag, F.coalesce("_lf_in", F.lit(False))).drop("_lf_code", "_lf_in")
