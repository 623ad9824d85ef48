"""Scopes that questions share: what a scope yields is worked out once and then given to its questions.

A question asks over one or more sets (document sets, collections).  Questions over the same sets have the same scope,
so pairs of questions and documents are never built where a result hangs on the documents alone.  Where every
question has sets of its own there are as many scopes as questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from foliant.functions import vectors

#: Questions and rows of one scope that meet in one block.
BLOCK_QUESTIONS, BLOCK_ROWS = 1024, 4096
#: Questions of a block where a scope has many rows, which travel once per block; questions pass by the rows one at a time.
BLOCK_MANY = 4096
#: Pairs of a question and a row that a task makes, and tasks at most.
TASK_PAIRS, MOST_TASKS = 1 << 20, 2000


def shared_scopes(links: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, scope_id), and the sets of each scope as (query_id, ``column``) with the scope in place of the question.

    ``links``: query_id, ``column``.  A scope is named by its distinct sets in order.
    """
    per = links.groupBy("query_id").agg(F.sort_array(F.collect_set(column)).alias("_sets"))
    named = per.where(F.size("_sets") > 0).withColumn("scope_id", F.to_json("_sets"))
    sets = named.select("scope_id", "_sets").distinct().select(F.col("scope_id").alias("query_id"), F.explode("_sets").alias(column))
    return named.select("query_id", "scope_id"), sets


def per_question(queries: DataFrame, found: DataFrame, asked: DataFrame | None, how: str = "inner", many: bool = False) -> DataFrame:
    """Rows of each question's scope: ``queries`` ⋈ ``found`` (by query_id, which holds scopes where ``asked`` is given).

    ``asked``: query_id, scope_id.  ``many``: a scope has many rows in ``found``, which is then read twice.  Questions and rows meet in blocks, so a scope that
    all questions share is spread over tasks; nothing but the result grows with questions times rows.
    """
    if asked is None:
        return queries.join(found, "query_id", how)
    mine = queries.join(asked, "query_id", "left" if how == "left" else "inner")
    return _met(mine, found, asked.where(F.col("query_id").isNotNull()), how, many)


def to_questions(found: DataFrame, asked: DataFrame | None, many: bool = True) -> DataFrame:
    """``found`` (query_id: scopes) for every question of ``asked``, those without an id as well."""
    return found if asked is None else _met(asked, found, asked, "inner", many).select(*found.columns)


def pair_up(mine: DataFrame, found: DataFrame) -> DataFrame:
    """Questions (query_id, scope_id, …; a row for each scope of a question) with all rows of their scope in ``found``, which is read twice."""
    return _met(mine, found, mine, "inner", True)


def pair_cosines(mine: DataFrame, found: DataFrame, vector: str, other: str) -> DataFrame:
    """``pair_up`` with the ``cosine_similarity`` of the two vectors as score in their place: a task has the vectors of a block, no pair of rows carries them."""
    keyed, dealt, keys, tasks = _blocks(mine, found, mine, "inner", True)
    left, right = ([c for c in df.columns if c not in (*keys, v)] for df, v in ((keyed, vector), (dealt, other)))
    fields = T.StructType([*[keyed.schema[c] for c in left], *[dealt.schema[c] for c in right], T.StructField("score", T.DoubleType())])

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(rows))
        q, p = table.filter(table["_asks"]).combine_chunks(), table.filter(pc.invert(table["_asks"])).combine_chunks()
        if not (q.num_rows and p.num_rows):
            return
        for b, a, cosine in vectors.all_cosines(*[x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (q[vector], p[other])]):
            columns = [*[q[c].take(pa.array(b)) for c in left], *[p[c].take(pa.array(a)) for c in right], pa.array(cosine)]
            yield from pa.table(columns, names=fields.names).combine_chunks().to_batches()

    both = keyed.withColumn("_asks", F.lit(True)).unionByName(dealt.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # blocks are small next to what they yield: their number of tasks is not left to their size
    return both.repartition(tasks, *keys).groupBy(*keys).applyInArrow(score, fields)


def _met(mine: DataFrame, found: DataFrame, asked: DataFrame, how: str, many: bool) -> DataFrame:
    keyed, dealt, keys, tasks = _blocks(mine, found, asked, how, many)
    return keyed.repartition(tasks, *keys).join(dealt.repartition(tasks, *keys), keys, how).drop(*keys)


def _blocks(mine: DataFrame, found: DataFrame, asked: DataFrame, how: str, many: bool) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Questions and rows with the keys of the blocks they meet in, and a number of tasks."""
    rows = found.withColumnRenamed("query_id", "scope_id")
    values = [c for c in rows.columns if c != "scope_id"]
    sizes = asked.groupBy("scope_id").agg(F.count(F.lit(1)).alias("_q"))
    sizes = sizes.join(rows.groupBy("scope_id").agg(F.count(F.lit(1)).alias("_r")), "scope_id") if many else sizes.withColumn("_r", F.lit(1))
    pairs = sizes.agg(F.sum(F.col("_q").cast("double") * F.col("_r"))).first()[0] or 0.0
    tasks = int(min(MOST_TASKS, pairs // (TASK_PAIRS if many else BLOCK_QUESTIONS) + 1))
    questions = BLOCK_MANY if many else BLOCK_QUESTIONS
    blocks = sizes.select("scope_id", *[F.ceil(F.col(n) / most).cast("int").alias(n) for n, most in (("_q", questions), ("_r", BLOCK_ROWS))])
    dealt = (rows.join(blocks, "scope_id").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
             .withColumn("_part", F.pmod(F.xxhash64(*values), F.col("_r")).cast("int") if many else F.lit(0)).select("scope_id", "_block", "_part", *values))
    keyed = (mine.join(blocks, "scope_id", how).withColumn("_block", F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("_q")).cast("int"), F.lit(0)))
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_r"), F.lit(1)) - 1))).drop("_q", "_r"))
    return keyed, dealt, ["scope_id", "_block", "_part"], tasks
