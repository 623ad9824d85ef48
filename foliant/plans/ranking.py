"""Ordered computations that stay distributed when one group is very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
                  rank: str = "rank") -> DataFrame:
    """First ``limit`` rows of each group.

    The filter on ``row_number`` lets Spark put a group limit *before* the
    shuffle, so at most ``limit`` rows per group and map task move, however
    large the group is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


#: Rows of a group that one task may put in order.
BUCKET_ROWS = 65536
#: Sampled rows for each splitter; a bucket then holds about BUCKET_ROWS, give or take a fifth.
_OVERSAMPLING = 32


def order_buckets(df: DataFrame, keys: Sequence[str], order: str, rows: int | None = None, name: str = "_bucket") -> DataFrame:
    """Adds the number of a bucket that grows with ``order`` inside each group and holds about ``rows`` rows.

    ``order`` may be of any type that sorts: text, numbers, structs.  Groups with more rows are sampled (rows are
    chosen by a hash of ``order``), every so many-th of the sorted sample is a splitter, and a row counts the
    splitters up to its own value, first among every root-th and then between two of those.  Equal values share a bucket.
    ``df`` is read several times: cut it off from long work before.
    """
    limit = rows or BUCKET_ROWS
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).withColumn("_parts", F.ceil(F.col("_n") / limit))
    sample = (df.select(*keys, F.col(order).alias("_o")).join(large, list(keys))
              .where(F.col("_o").isNotNull() & (F.pmod(F.xxhash64("_o", F.lit("splitter")), F.col("_n")) < _OVERSAMPLING * F.col("_parts"))))
    sorted_sample = sample.groupBy(*keys).agg(F.max("_parts").alias("_parts"), F.sort_array(F.collect_set("_o")).alias("_s"))
    cuts = F.expr("array_distinct(transform(sequence(1, greatest(1, cast(_parts as int) - 1)), i -> _s[least(size(_s) - 1, cast(i * size(_s) / _parts as int))]))")
    nested = F.expr("transform(sequence(0, cast(floor((size(_cuts) - 1) / _root) as int)), j -> slice(_cuts, j * _root + 1, _root))")
    splitters = sorted_sample.withColumn("_cuts", cuts).withColumn("_root", F.ceil(F.sqrt(F.size("_cuts").cast("double"))).cast("int")).select(
        *keys, "_root", nested.alias("_nested"))
    group = F.size(F.filter("_nested", lambda c: c[0] <= F.col(order)))
    inside = F.size(F.filter(F.get("_nested", F.col("_g") - 1), lambda c: c <= F.col(order)))
    placed = df.join(splitters, list(keys), "left").withColumn("_g", F.when(F.col("_nested").isNotNull(), group).otherwise(0))
    number = F.when(F.col("_g") > 0, (F.col("_g") - 1) * F.col("_root") + inside).otherwise(0)
    return placed.withColumn(name, F.coalesce(number, F.lit(0))).drop("_g", "_root", "_nested")


def bucketed_rank(df: DataFrame, keys: Sequence[str], bucket: dict[str, Column], order: Sequence[Column],
                  rank: str = "position", total: str | None = None) -> DataFrame:
    """Exact 1-based rank over a whole group without sorting the group in one task.

    ``bucket`` holds expressions that are monotone in ``order`` (for instance
    the leading sort column, or an id divided by a constant).  Rows are ranked
    inside a bucket; bucket sizes are counted with map-side combine and summed
    in a much smaller second step; the two are added.
    """
    names = list(bucket)
    marked = df
    for name, expr in bucket.items():
        marked = marked.withColumn(name, expr)
    sizes = marked.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum("_rows").over(Window.partitionBy(*keys)))
    sizes = sizes.drop("_rows")
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    ranked = marked.withColumn("_in", F.row_number().over(inside))
    out = ranked.join(sizes, [*keys, *names])
    return out.withColumn(rank, F.col("_before") + F.col("_in")).drop("_before", "_in", *names)


def exclusive_running(df: DataFrame, keys: Sequence[str], bucket: Column, order: str,
                      sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Prefix sums and last-seen values strictly before each row, in two levels.

    A group is cut into buckets along ``order`` (``bucket`` is monotone in it);
    only one summary row per bucket reaches the second level, so a group that
    holds much of the table is still spread over many tasks.
    """
    marked = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    aggs, here, before = [], [], []
    for name, value in sums.items():
        aggs.append(F.sum(value).alias(f"_t_{name}"))
        here.append(F.coalesce(F.sum(value).over(inner), F.lit(0)).alias(f"_i_{name}"))
        before.append(F.coalesce(F.sum(f"_t_{name}").over(outer), F.lit(0)).alias(f"_o_{name}"))
    for name, value in lasts.items():
        aggs.append(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"_t_{name}"))
        here.append(F.last(value, ignorenulls=True).over(inner).alias(f"_i_{name}"))
        before.append(F.last(f"_t_{name}", ignorenulls=True).over(outer).alias(f"_o_{name}"))
    summary = marked.groupBy(*keys, "_bucket").agg(*aggs).select(*keys, "_bucket", *before)
    joined = marked.select("*", *here).join(summary, [*keys, "_bucket"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_i_{name}") + F.col(f"_o_{name}"))
    for name in lasts:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_i_{name}"), F.col(f"_o_{name}")))
    return joined.drop("_bucket", *[f"_{p}_{n}" for n in [*sums, *lasts] for p in "io"])


def join_text(value: str, order: str, separator: str) -> Column:
    """Ordered string aggregation with the order written out."""
    sep = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg({value}, '{sep}') within group (order by {order})")


def text_parts(pieces: DataFrame, keys: Sequence[str], order: str, piece: str, chars: int) -> DataFrame:
    """A group's pieces in ``order`` as parts of about ``chars`` characters: keys, part_no (from 0), text.

    A piece goes where it begins, so a part is longer than ``chars`` by less than one piece, and no text
    grows with its group.  The parts in order are the group's text.
    """
    placed = exclusive_running(order_buckets(pieces, keys, order), keys, F.col("_bucket"), order, {"_used": F.length(piece)}, {})
    number = F.floor(F.col("_used") / chars)
    numbered = placed.withColumn("_no", number)
    parts = numbered.groupBy(*keys, "_no").agg(join_text(piece, order, "").alias("text"))
    # numbers without gaps: a long piece may skip some
    dense = bucketed_rank(order_buckets(parts.select(*keys, "_no"), keys, "_no", name="_place"), keys, {"_b": F.col("_place")}, [F.col("_no")], "_rank")
    return parts.join(dense.select(*keys, "_no", (F.col("_rank") - 1).alias("part_no")), [*keys, "_no"]).select(*keys, "part_no", "text")
