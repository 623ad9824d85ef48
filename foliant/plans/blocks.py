"""Cosines of many questions with many stored vectors, block against block.

A vector crosses the network once per block of questions and a question once per
block of vectors; no row ever holds a pair of vectors.  Blocks are large, as what
travels is the number of blocks times what they hold; products are taken tile by tile and pairs
leave in batches, so that a task's memory hangs on neither.  Which pairs count is
said by keys: a stored vector has one, and ``scope`` lists those of a scope, which
any number of questions may share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliant.plans.ranking import top_per_group

#: Stored vectors and questions that one task holds, and numbers of either (fewer vectors where they are long).
BLOCK_POINTS, BLOCK_QUESTIONS, BLOCK_NUMBERS = 32768, 8192, 1 << 21
#: Scopes named by the vectors of a task: where each question has a scope of its own, a vector names many.
BLOCK_LINKS = 1 << 22
#: Rows that a task keeps as the best of its questions; with a high limit it takes fewer questions.
BLOCK_BEST = 1 << 20
#: Pairs of a matrix product, and of a batch of rows that comes out.
TILE, BATCH = 1 << 21, 1 << 17
#: Candidates that a task gathers before it keeps only the best of each question.
PRUNE_PAIRS = 1 << 21
#: Pairs whose products are held at a time.
PAIRS = 1 << 15
_GROUP = ["space", "pack", "salt", "part"]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length from their Arrow buffers."""
    rows = column.combine_chunks()
    return np.asarray(rows.flatten(), np.float32).reshape(len(rows), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1, dtype=np.float64))


def _cosines(p: np.ndarray, q: np.ndarray, norm_p: np.ndarray, norm_q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a, b), row by row: products in float, summed in double; 0 without a length.  Equal rows give equal bits."""
    out, length = np.zeros(len(a)), norm_p[a] * norm_q[b]
    for s in range(0, len(a), PAIRS):
        out[s:s + PAIRS] = (p[a[s:s + PAIRS]] * q[b[s:s + PAIRS]]).sum(axis=1, dtype=np.float64)
    return np.divide(out, length, out=np.zeros(len(a)), where=length > 0)


def _first(q: np.ndarray, score: np.ndarray, tie: np.ndarray, limit: int) -> np.ndarray:
    """Places of the ``limit`` best of each question; what is not a number comes first, as it does in Spark."""
    order = np.lexsort((tie, -np.where(np.isnan(score), np.inf, score), q))
    rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return order[rank < limit]


def _met(points: pa.Table, asked: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of vectors, places of questions) for every scope that both sides know."""
    scopes = asked["scope_id"].combine_chunks().dictionary_encode()
    code = np.asarray(scopes.indices)
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(scopes.dictionary) + 1))
    lists = points["scopes"].combine_chunks()
    seen = pc.index_in(lists.flatten(), scopes.dictionary)
    at = np.asarray(pc.list_parent_indices(lists))[np.asarray(seen.is_valid())]
    seen = np.asarray(seen.drop_null())
    by_scope = np.argsort(seen, kind="stable")
    seen, at = seen[by_scope], at[by_scope]
    for scope in np.unique(seen):
        first, last = np.searchsorted(seen, [scope, scope + 1])
        yield at[first:last], order[ends[scope]:ends[scope + 1]]


def _marked(points: pa.Table, asked: pa.Table, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """How often the marks of a pair's question name its vector."""
    ids = points["point_id"].combine_chunks().dictionary_encode()
    lists = asked["marks"].combine_chunks()
    at = pc.index_in(lists.flatten(), ids.dictionary)
    who = np.asarray(pc.list_parent_indices(lists))[np.asarray(at.is_valid())]
    wide = max(len(ids.dictionary), 1)
    named, times = np.unique(who.astype(np.int64) * wide + np.asarray(at.drop_null()), return_counts=True)
    pair = b.astype(np.int64) * wide + np.asarray(ids.indices)[a]
    place = np.minimum(np.searchsorted(named, pair), max(len(named) - 1, 0))
    return np.where(named[place] == pair, times[place], 0) if len(named) else np.zeros(len(pair), np.int64)


def _odd(norm: np.ndarray) -> np.ndarray:
    """Lengths at which products of single numbers leave what a float can hold."""
    return ~((norm > 1e-9) & (norm < 1e18))


def _scored(points: pa.Table, asked: pa.Table, limit: int | None, least: float, reach: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of questions and vectors, and cosines, in batches: all pairs, those that ``reach`` a cosine or are not a number, or the
    ``limit`` best of each question from ``least`` up.

    With a limit or a reach, a matrix product finds the candidates; what lies within rounding of a place among the
    best is computed again row by row, so that ties stay ties.  With a limit, cosines that are not a number count only without a least one.
    """
    p, q = _matrix(points["vector"]), _matrix(asked["query_vector"])
    norm_p, norm_q = _norms(p), _norms(q)
    if limit is None and reach is None:
        for at, who in _met(points, asked):
            step = max(1, BATCH // len(at))
            for some in (who[s:s + step] for s in range(0, len(who), step)):
                b, a = np.repeat(some, len(at)), np.tile(at, len(some))
                yield b, a, _cosines(p, q, norm_p, norm_q, a, b)
        return
    unit_p, unit_q = (np.divide(x, n[:, None], out=np.zeros(x.shape), where=n[:, None] > 0) for x, n in ((p, norm_p), (q, norm_q)))
    slack = 1e-5  # products in float against products in double
    tiles = ((at[s:s + step], who) for at, who in _met(points, asked) for step in [max(1, TILE // len(who))] for s in range(0, len(at), step))
    if limit is None:
        odd_p, odd_q = _odd(norm_p), _odd(norm_q)
        for at, who in tiles:
            b, a = np.nonzero(~(unit_q[who] @ unit_p[at].T < reach - slack) | odd_q[who][:, None] | odd_p[at])
            b, a = who[b], at[a]
            for s in range(0, len(b), BATCH):
                score = _cosines(p, q, norm_p, norm_q, a[s:s + BATCH], b[s:s + BATCH])
                stays = ~(score < reach)
                yield b[s:s + BATCH][stays], a[s:s + BATCH][stays], score[stays]
        return
    best, held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), []
    floor, every = np.full(len(q), least - slack), least == -np.inf

    def near(score: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return (score >= bound) | np.isnan(score) if every else score >= bound

    def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, a, score = (np.concatenate(x) for x in zip(best, *held, strict=True))
        order = np.lexsort((-score, b))
        b, a, score = b[order], a[order], score[order]
        begin = np.searchsorted(b, np.arange(len(q)))
        last = begin + limit - 1
        full = (last < len(b)) & (np.append(b, -1)[np.minimum(last, len(b))] == np.arange(len(q)))
        floor[full] = np.fmax(floor[full], score[last[full]] - 2 * slack)
        stays = near(score, floor[b])
        return b[stays], a[stays], score[stays]

    for at, who in tiles:
        cosine = unit_q[who] @ unit_p[at].T
        b, a = np.nonzero(near(cosine, floor[who][:, None]))
        held.append((who[b], at[a], cosine[b, a]))
        if sum(len(x[0]) for x in held) > PRUNE_PAIRS:
            best, held = kept(), []
    b, a, _ = kept()
    score = _cosines(p, q, norm_p, norm_q, a, b)
    tie = np.argsort(np.asarray(pc.array_sort_indices(points["point_id"].combine_chunks())))
    close = near(score, least)
    b, a, score = b[close], a[close], score[close]
    chosen = _first(b, score, tie[a], limit)
    for s in range(0, len(chosen), BATCH):
        some = chosen[s:s + BATCH]
        yield b[some], a[some], score[some]


def blocked_cosines(points: DataFrame, questions: DataFrame, scope: DataFrame, limit: int | None = None, least: float = -1.0,
                    carry: Sequence[str] = (), asked: DataFrame | None = None, marks: DataFrame | None = None, reach: float | None = None) -> DataFrame:
    """Cosines of questions and stored vectors of one space whose key the question may see.

    ``points``: space, key, point_id, vector and the columns to ``carry``; ``questions``: query_id, space,
    query_vector (a row for each space it looks into); ``scope``: query_id, key, or scopes in query_id where ``asked``
    (query_id, scope_id) names each question's.  A space holds vectors of one length.
    Result: query_id, point_id, score and the carried columns; with a ``limit`` the best of each question (score
    from ``least`` up, ties by point_id) and their rank; with a ``reach`` only pairs whose score is as high or not a number.  With ``marks`` (query_id, point_id) a column ``marked`` says which pairs
    are among them; a pair comes out once for each of its marks.  Marks travel to the blocks of their questions, pairs do not travel to them.

    A scope with BLOCK_QUESTIONS questions or more is a pack of its own, smaller ones are dealt to packs of about that many
    questions; a pack's questions are dealt to parts and the vectors its scopes may see to salts of about BLOCK_POINTS (a quarter, where
    all pairs come out).  So a vector travels once for each block of the questions that may see it.  A task answers at most ``limit`` rows a question.
    """
    most_questions, most_points = min(BLOCK_QUESTIONS, max(1, BLOCK_BEST // (limit or 1))), BLOCK_POINTS if limit else max(1, BLOCK_POINTS // 4)
    if marks is not None:
        most_questions, most_points = max(1, BLOCK_QUESTIONS // 8), max(1, BLOCK_POINTS // 32)
    blocks = lambda n, numbers, most: F.greatest(F.sum(n) / most, F.sum(numbers) / BLOCK_NUMBERS)
    seen = scope.select(F.col("query_id").alias("scope_id"), "key").distinct()
    asked = seen.select(F.col("scope_id").alias("query_id"), "scope_id").distinct() if asked is None else asked
    mine = questions.join(asked, "query_id")
    counts = mine.groupBy("space", "scope_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("query_vector")).alias("numbers"))
    few = F.col("n") < most_questions
    small = counts.where(few).agg(F.sum("n").alias("n")).first()["n"] or 0
    # numbers that meet by chance only put scopes together, as the vectors know theirs
    number = F.when(few, F.pmod(F.xxhash64("scope_id"), F.lit(-(-small // most_questions) or 1))).otherwise(F.xxhash64("scope_id"))
    packs = counts.select("space", "scope_id", "n", "numbers", number.alias("pack"))
    parts = packs.groupBy("space", "pack").agg(F.ceil(blocks("n", "numbers", most_questions)).cast("int").alias("parts"))
    keys = packs.join(seen, "scope_id").groupBy("space", "pack", "key").agg(F.collect_list("scope_id").alias("scopes"))
    per_key = points.groupBy("space", "key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("vector")).alias("numbers"))
    salts = F.greatest(blocks("m", "numbers", most_points), F.sum(F.col("m") * F.size("scopes")) / BLOCK_LINKS)
    sizes = keys.join(per_key, ["space", "key"]).groupBy("space", "pack").agg(F.ceil(salts).cast("int").alias("salts")).join(parts, ["space", "pack"])
    left = (points.join(keys.join(sizes, ["space", "pack"]), ["space", "key"]).withColumn("salt", F.pmod(F.xxhash64("point_id"), F.col("salts")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    right = (mine.join(packs.select("space", "scope_id", "pack"), ["space", "scope_id"]).join(sizes, ["space", "pack"])
             .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    names, marking = [*_GROUP, "query_id", "query_vector", "scope_id"], marks is not None
    if marking:
        kinds = dict(points.dtypes)
        asks = mine.select("query_id", "space", "scope_id").distinct().join(packs.select("space", "scope_id", "pack"), ["space", "scope_id"])
        asks = asks.select("query_id", "space", "pack").distinct().join(sizes.drop("parts"), ["space", "pack"])
        named = marks.select("query_id", F.col("point_id").cast(kinds["point_id"])).where(F.col("point_id").isNotNull()).join(asks, "query_id")
        named = (named.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.col("salts")).cast("int"))
                 .groupBy("query_id", "space", "pack", "salt").agg(F.collect_list("point_id").alias("marks")))
        right = right.join(named, ["query_id", "space", "pack", "salt"], "left").withColumn("marks", F.coalesce("marks", F.array().cast(f"array<{kinds['point_id']}>")))
        names.append("marks")
    fields = [questions.schema["query_id"], points.schema["point_id"], T.StructField("score", T.DoubleType()), *[points.schema[c] for c in carry]]
    fields += [T.StructField("marked", T.BooleanType())] if marking else []

    def answer(p: pa.Table, q: pa.Table) -> Iterator[pa.Table]:
        for b, a, score in _scored(p, q, limit, least, reach) if p.num_rows and q.num_rows else ():
            last = []
            if marking:
                times = _marked(p, q, b, a)
                b, a, score, times = (np.repeat(x, np.maximum(times, 1)) for x in (b, a, score, times))
                last = [pa.array(times > 0)]
            columns = [q["query_id"].take(pa.array(b)), p["point_id"].take(pa.array(a)), pa.array(score), *[p[c].take(pa.array(a)) for c in carry], *last]
            yield pa.table(columns, names=[f.name for f in fields])

    schema, known = T.StructType(fields), [*_GROUP, "scopes", "point_id", "vector", *[c for c in carry if c != "point_id"]]
    if marking:  # both sides at once, and one table out: blocks are smaller
        empty = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields]).empty_table()
        left = left.withColumn("pack", F.col("pack") + 0)  # a column of its own, as both sides come from the packs
        return (left.select(*known).groupBy(*_GROUP).cogroup(right.select(*names).groupBy(*_GROUP))
                .applyInArrow(lambda p, q: pa.concat_tables([*answer(p, q)] or [empty]), schema))

    def stream(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(rows))
        for found in answer(table.filter(table["stored"]), table.filter(pc.invert(table["stored"]))):
            yield from found.combine_chunks().to_batches()

    stored = left.select(*known, F.lit(True).alias("stored")).unionByName(right.select(*names, F.lit(False).alias("stored")), allowMissingColumns=True)
    # blocks are small next to the work on them: adaptive execution would put many into one task
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored.repartition(tasks, *_GROUP).groupBy(*_GROUP).applyInArrow(stream, schema)
    return found if limit is None else top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("point_id")], limit)
