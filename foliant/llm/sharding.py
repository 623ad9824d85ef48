"""Shards from sampled splitters: quantiles of a size-weighted sample of keys, ranges, overfull ranges subdivided."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.llm.common import stage

#: Ranges per shard, and expected sample keys per range.  Both bound what the driver sees.
RANGES_PER_SHARD = 64
KEYS_PER_RANGE = 16


def _sample(rows: DataFrame, keys: int, total: int) -> list[tuple[int, object]]:
    """About ``keys`` sorted keys, each row drawn with a chance in proportion to its size.

    The draw is a hash of the key, so that a task that runs again draws the same rows.
    """
    chance = F.pmod(F.xxhash64("_h", "doc_id", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(chance * total < F.col("size") * F.lit(float(keys))).select("_h", "doc_id")
    return [tuple(r) for r in drawn.orderBy("_h", F.col("doc_id").asc_nulls_first()).limit(4 * keys).collect()]


def _quantiles(sample: list[tuple[int, object]], ranges: int) -> list[tuple[int, object]]:
    """Boundaries between ``ranges`` ranges.  A boundary lies before all equal texts, unless they fill ranges of their own."""
    picked = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    hashes = [h for h, _ in picked]
    kept = {(h, d if hashes.count(h) > 1 else None) for h, d in picked} | {(h, None) for h in hashes}
    return sorted(kept, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def _range_of(splitters: list[tuple[int, object]], id_type: str) -> tuple[Column, Column]:
    """Number of splitters at or before a row's key, found in a block of splitters; and that block."""
    width = max(1, math.isqrt(len(splitters)))
    blocks = [splitters[i:i + width] for i in range(0, len(splitters), width)]
    quoted = lambda v: "null" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    spell = lambda x: f"named_struct('h', {x[0]}L, 'd', cast({quoted(x[1])} as {id_type}))"
    spell_all = lambda xs: f"array({', '.join(map(spell, xs))})"
    key = f"named_struct('h', _h, 'd', cast(doc_id as {id_type}))"
    block = f"size(filter({spell_all([b[0] for b in blocks])}, s -> s <= {key}))"
    inner = f"size(filter(element_at(array({', '.join(map(spell_all, blocks))}), _block), s -> s <= {key}))"
    return F.expr(f"case when _block = 0 then 0 else (_block - 1) * {width} + {inner} end"), F.expr(block)


def _with_range(rows: DataFrame, splitters: list[tuple[int, object]]) -> DataFrame:
    if not splitters:
        return rows.withColumn("_range", F.lit(0))
    place, block = _range_of(splitters, rows.schema["doc_id"].dataType.simpleString())
    return rows.withColumn("_block", block).withColumn("_range", place).drop("_block")


def shard_documents(docs: DataFrame, shards: int = 16, ranges_per_shard: int = RANGES_PER_SHARD,
                    keys_per_range: int = KEYS_PER_RANGE) -> DataFrame:
    """Deal all rows to shards of near-equal bytes, equal texts together where they fit.

    The key is the hash of the text, then the id.  A size-weighted sample of keys gives splitters for
    ``shards * ranges_per_shard`` ranges; ranges that hold over twice their share are sampled again and
    subdivided.  Byte sums of the ranges, then of the rows inside each range, place every row at a
    position in bytes; the shard is that of its middle.  Equal texts of less than a range's share
    move together; a larger group is divided by id.

    Size is the text's UTF-8 bytes plus 1.  A null text is empty; null ids come first among equal texts;
    repeated rows are dealt one by one; an empty table gives no rows; columns other than doc_id and
    text are not read.  The driver sees at most ``4 * shards * ranges_per_shard * keys_per_range`` keys
    and one row per range.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                             F.xxhash64(text).alias("_h")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * ranges_per_shard
    splitters = _quantiles(_sample(rows, ranges * keys_per_range, total), ranges) if total else []
    marked = _with_range(rows, splitters)
    sizes = {r["_range"]: r["b"] for r in marked.groupBy("_range").agg(F.sum("size").alias("b")).collect()}
    overfull = {k: b for k, b in sizes.items() if b > 2 * total / ranges}
    if overfull:
        held = marked.where(F.col("_range").isin(list(overfull))).drop("_range")
        more = _sample(held, ranges * keys_per_range, sum(overfull.values()))
        wanted = min(ranges, sum(math.ceil(b * ranges / total) for b in overfull.values()))
        cut = {*splitters, *_quantiles(more, wanted)}
        splitters = sorted(cut, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        marked = _with_range(rows, splitters)
    sums = marked.groupBy("_range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.select("_range", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_rows"))
    inside = Window.partitionBy("_range").orderBy("_h", F.col("doc_id").asc_nulls_first(), "text_crc32")
    group = Window.partitionBy("_range", "_h", "text_crc32")
    placed = marked.withColumn("_upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.withColumn("_in", F.row_number().over(inside) - 1)
    placed = placed.withColumn("_first", F.min("_upto").over(group)).withColumn("_group", F.sum("size").over(group))
    small = F.col("_group") * ranges <= total
    middle = F.when(small, F.col("_first") + F.col("_group") / 2).otherwise(F.col("_upto") + F.col("size") / 2)
    at = F.col("_bytes") + middle
    placed = placed.join(F.broadcast(sums), "_range")
    shard = F.least(F.floor(at * F.lit(shards) / F.lit(max(total, 1))).cast("int"), F.lit(shards - 1))
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_rows") + F.col("_in")).alias("_rank"))
    placed = stage(placed)
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
