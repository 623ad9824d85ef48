"""Hybrid vector and keyword retrieval for many questions at once.

Column conventions
  query_files   query_id, file_id            chunks   chunk_id, doc_id, chunk_index, page_number, heading, content
  scope         query_id, doc_id             docs     doc_id, title, status, file_id, stored_file_id
  query_vectors query_id, provider, model,   vectors  chunk_id, provider, model, vector
                query_vector                 points   point_id, doc_id, provider, model, vector[, collection_ids]
  scored        query_id, chunk_id, doc_id, chunk_index, page_number, score

With ``asked`` (query_id, scope_id) a scope, its files or its collections hold scope ids in query_id: questions over the
same sets share one scope, and pairs of questions and documents are never built.

Text stays out of every ranking step: ids and scores are ranked first and the
content is joined to the few rows that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.functions import intents, text
from foliant.options import DEFAULTS, Options
from foliant.plans.blocks import blocked_cosines
from foliant.plans.ranking import bucketed_rank, top_per_group
from foliant.plans.scopes import pair_up, to_questions
from foliant.session import cut_lineage

RANKING = ["query_id", "chunk_id", "doc_id", "chunk_index", "page_number", "score"]


def by_score(tie: str = "chunk_id") -> list[Column]:
    return [F.col("score").desc(), F.col(tie)]


# ── scope ─────────────────────────────────────────────────────────────────────


def resolve_documents(query_files: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files of a question to documents, by shared stored copy or by direct link.

    The two links are two equi-joins; an OR condition would be a nested loop.
    """
    stored = (query_files.join(files.where(F.col("stored_file_id").isNotNull())
                               .select("file_id", "stored_file_id"), "file_id")
              .join(docs.select("doc_id", "stored_file_id"), "stored_file_id").select("query_id", "doc_id"))
    direct = query_files.join(docs.select("doc_id", "file_id"), "file_id").select("query_id", "doc_id")
    return stored.unionByName(direct).distinct()


def collection_documents(query_collections: DataFrame, memberships: DataFrame) -> DataFrame:
    return query_collections.join(memberships, "collection_id").select("query_id", "doc_id").distinct()


def ready_scope(scope: DataFrame, docs: DataFrame) -> DataFrame:
    return scope.join(docs.where(F.col("status") == "Ready").select("doc_id"), "doc_id", "left_semi")


def part_of(scope: DataFrame, queries: DataFrame, asked: DataFrame | None) -> DataFrame:
    """The rows of a scope that some of ``queries`` may see."""
    ids = queries.select("query_id")
    return scope.join(ids if asked is None else asked.join(ids, "query_id", "left_semi").select(F.col("scope_id").alias("query_id")), "query_id", "left_semi")


def _unanswered(scope: DataFrame, hits: DataFrame, asked: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Scope, and questions, without the questions that have hits."""
    settled = hits.select("query_id").distinct()
    if asked is None:
        return scope.join(settled, "query_id", "left_anti"), None
    rest = asked.join(settled, "query_id", "left_anti")
    return part_of(scope, rest, rest), rest


def space(provider: Column | str, model: Column | str, vector: str) -> Column:
    """Vectors are compared inside a space: one provider, one model, one length."""
    return F.to_json(F.struct(text.col(provider).alias("p"), text.col(model).alias("m"), F.size(vector).alias("d")))


def _asked(query_vectors: DataFrame, *providers: Column) -> DataFrame:
    """Question vectors with the spaces they look into."""
    filled = query_vectors.where((F.size("query_vector") > 0) & F.col("provider").isNotNull() & F.col("model").isNotNull())
    looked = filled.withColumn("_provider", F.explode(F.array_distinct(F.array(*providers))))
    return looked.select("query_id", space("_provider", "model", "query_vector").alias("space"), "query_vector")


# ── similarity ────────────────────────────────────────────────────────────────


def _stored(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return (vectors.join(chunks.select("chunk_id", "doc_id", "chunk_index", "page_number"), "chunk_id")
            .select(space("provider", "model", "vector").alias("space"), F.col("doc_id").alias("key"), F.col("chunk_id").alias("point_id"),
                    "doc_id", "chunk_index", "page_number", "vector"))


def embedding_candidates(scope: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame,
                         query_vectors: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Ids of the question and chunk vectors that may be compared: same model, provider equal or
    unnamed, Ready document in scope, same dimension.  No vector meets another here."""
    ready, looking = ready_scope(scope, docs), _asked(query_vectors, F.col("provider"), F.lit("")).drop("query_vector")
    if asked is None:
        asked = ready.select("query_id", F.col("query_id").alias("scope_id")).distinct()
    inside = F.to_json(F.struct("scope_id", "space"))
    stored = _stored(chunks, vectors).drop("vector", "key").withColumnRenamed("point_id", "chunk_id")
    found = stored.join(ready.withColumnRenamed("query_id", "scope_id"), "doc_id").select(inside.alias("query_id"), "chunk_id", "doc_id", "chunk_index", "page_number")
    return to_questions(found, looking.join(asked, "query_id").select("query_id", inside.alias("scope_id")))


def exact_scan(scope: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame,
               query_vectors: DataFrame, keyword_hits: DataFrame | None = None,
               options: Options = DEFAULTS, asked: DataFrame | None = None, limit: int | None = None, marks: DataFrame | None = None,
               reach: float | None = None) -> DataFrame:
    """Score of every candidate, raised to the keyword score where an identifier occurs.

    With a ``limit`` the best of each question only, with a ``reach`` those that score as high.  With ``marks`` (query_id, chunk_id) the column hit says which candidates are
    among them; they meet where the pairs are made, so that pairs are not shuffled for it.
    """
    if keyword_hits is not None:
        return keyword_boost(exact_scan(scope, docs, chunks, vectors, query_vectors, asked=asked, marks=keyword_hits), options=options)
    seen = ready_scope(scope, docs).select("query_id", F.col("doc_id").alias("key"))
    named = None if marks is None else marks.select("query_id", F.col("chunk_id").alias("point_id"))
    scored = blocked_cosines(_stored(chunks, vectors), _asked(query_vectors, F.col("provider"), F.lit("")), seen, limit, float("-inf"),
                             ["doc_id", "chunk_index", "page_number"], asked, named, reach).withColumnRenamed("point_id", "chunk_id")
    return scored.select(*RANKING, *([] if marks is None else [F.col("marked").alias("hit")]))


def wide_scan(scope: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, top: int,
              options: Options = DEFAULTS, asked: DataFrame | None = None) -> DataFrame:
    """The rows of ``exact_scan`` that ``document_wide_sample`` can choose, without a row for every pair.

    Positions in chunk order hang on the scope and on the spaces looked into, not on the question: questions that share both
    share a list, which is ranked once.  The column spread tells rows at places of a list from the best by score.
    """
    half = top // 2
    best = exact_scan(scope, docs, chunks, vectors, query_vectors, options=options, asked=asked, limit=max(half, options.fallback_rows))
    ready, looking = ready_scope(scope, docs).select(F.col("query_id").alias("scope_id"), "doc_id").distinct(), _asked(query_vectors, F.col("provider"), F.lit(""))
    if asked is None:
        asked = ready.select(F.col("scope_id").alias("query_id"), "scope_id").distinct()
    lists = (looking.join(asked, "query_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("scope_id", "space"))).alias("_sees"))
             .withColumn("list", F.to_json("_sees")))
    sees = lists.select("list", "_sees").distinct().select("list", F.inline("_sees"))
    stored = _stored(chunks, vectors).withColumn("key", F.to_json(F.struct("space", "point_id", "doc_id", "chunk_index", "page_number")))
    inside = stored.drop("vector").withColumnRenamed("point_id", "chunk_id").join(ready, "doc_id").join(sees, ["scope_id", "space"])
    # places only, read twice below
    spread = cut_lineage(_spread(inside.select("list", "key", "chunk_id", "chunk_index"), "list", half).select("list", "key").distinct())
    mine = lists.select("query_id", F.col("list").alias("scope_id"))
    found = blocked_cosines(stored.join(spread.select("key").distinct(), "key", "left_semi"), looking, spread.select(F.col("list").alias("query_id"), "key"),
                            carry=["doc_id", "chunk_index", "page_number"], asked=mine).withColumnRenamed("point_id", "chunk_id")
    return best.withColumn("spread", F.lit(False)).unionByName(found.withColumn("spread", F.lit(True)))


def threshold_scan(scope: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
                   options: Options = DEFAULTS, asked: DataFrame | None = None) -> DataFrame:
    """The rows of ``exact_scan`` that ``threshold_or_top`` can choose: those that reach the threshold leave the blocks, and the best few of each question.

    The column best tells the latter, which may be among the former as well.
    """
    passing, best = (exact_scan(scope, docs, chunks, vectors, query_vectors, asked=asked, **most)
                     for most in ({"reach": options.min_score}, {"limit": options.fallback_rows}))
    return passing.withColumn("best", F.lit(False)).unionByName(best.withColumn("best", F.lit(True)))


def page_scan(scope: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, top: int, per_page: int,
              asked: DataFrame | None = None) -> DataFrame:
    """The rows of ``exact_scan`` that ``page_diversity`` can choose, without a row for every pair.

    The best few times ``top`` rows of a question settle it where ``top`` of them are among the first of their pages, as ranks on a page are
    known among the best, or where the question has no more.  The others are asked again for more rows, until all are settled.
    """
    settled, limit = None, 4 * top
    while True:
        best = cut_lineage(exact_scan(scope, docs, chunks, vectors, query_vectors, asked=asked, limit=limit))
        on_page = F.row_number().over(Window.partitionBy("query_id", "doc_id", "page_number").orderBy(*by_score()))
        counts = best.select("query_id", (on_page <= per_page).alias("_free")).groupBy("query_id").agg(
            F.count(F.lit(1)).alias("_n"), F.count_if("_free").alias("_free"))
        rest = cut_lineage(counts.where((F.col("_n") >= limit) & (F.col("_free") < top)).select("query_id"))
        done = best.join(rest, "query_id", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if rest.isEmpty():
            return settled
        query_vectors, limit = query_vectors.join(rest, "query_id", "left_semi"), limit * 8


def _best(points: DataFrame, query_vectors: DataFrame, scope: DataFrame, limit: int, asked: DataFrame | None) -> DataFrame:
    stored = points.select(space("provider", "model", "vector").alias("space"), "key", "point_id", "doc_id", "vector")
    best = blocked_cosines(stored, _asked(query_vectors, F.col("provider")), scope, limit, 0.0, ["doc_id"], asked)
    return best.select("query_id", F.col("point_id").alias("chunk_id"), "doc_id", "score", "rank")


def vector_topk(points: DataFrame, scope: DataFrame, query_vectors: DataFrame, limit: int, asked: DataFrame | None = None) -> DataFrame:
    """Best ``limit`` index points per question inside its documents, negative scores left out.

    Output: query_id, chunk_id, doc_id, score, rank.
    """
    return _best(points.withColumn("key", F.col("doc_id")), query_vectors, scope.select("query_id", F.col("doc_id").alias("key")), limit, asked)


def vector_topk_collections(points: DataFrame, query_collections: DataFrame, query_vectors: DataFrame,
                            limit: int, asked: DataFrame | None = None) -> DataFrame:
    """Best points whose collections overlap the question's.

    Points are matched by their *set* of collections: the few distinct sets are
    exploded and joined, so a point in several allowed collections still meets
    a question once and nothing has to be de-duplicated afterwards.
    """
    marked = points.where(F.size("collection_ids") > 0).withColumn("key", F.array_join(F.array_sort(F.array_distinct("collection_ids")), "\x1f"))
    sets = marked.select("key", "collection_ids").distinct().select("key", F.explode("collection_ids").alias("collection_id"))
    allowed = query_collections.join(sets, "collection_id").select("query_id", "key")
    return _best(marked, query_vectors, allowed, limit, asked)


# ── keywords ──────────────────────────────────────────────────────────────────
# Any occurrence of an identifier lies inside one run of letters, hyphen and
# digits, or one dotted run of digits.  A code that occurs in a run is an end of
# its letters and a beginning of its digits; an address in a dotted run is an
# end of one group, two whole groups and a beginning of the fourth.  So the
# whole needle is the join key: a run spells out the needles of each length that
# is asked for, and no two needles share a key.

_CODE_RUN, _CODE = r"[a-z]{2,}-?[0-9]{3,}", r"([a-z]+)(-?)([0-9]+)"
_DOTTED_RUN, _DOTTED = r"[0-9]+(?:\.[0-9]+){3,}", r"(?=(?<![0-9])([0-9]+)\.([0-9]{1,3}\.[0-9]{1,3})\.([0-9]+))"


def query_identifiers(queries: DataFrame) -> DataFrame:
    """query_id, identifier, needle (lower case)."""
    return (queries.select("query_id", F.explode(text.identifiers("query_text")).alias("identifier"))
            .withColumn("needle", F.lower("identifier")))


def _needles_of_code(run: Column) -> Column:
    """Ends of two to six letters before beginnings of three or more digits of one run."""
    letters, hyphen, digits = (F.regexp_extract(run, _CODE, g) for g in (1, 2, 3))
    ends = F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length(letters))), lambda n: F.right(letters, n))
    begins = F.transform(F.sequence(F.lit(3), F.length(digits)), lambda n: F.left(digits, n))
    return F.flatten(F.transform(ends, lambda e: F.transform(begins, lambda b: F.concat(e, hyphen, b))))


def _needles_of_dotted(run: Column) -> Column:
    """Addresses in each window of four groups of a dotted run: up to three digits of its first and last group."""
    first, middle, last = (F.regexp_extract_all(run, F.lit(_DOTTED), F.lit(g)) for g in (1, 2, 3))

    def sides(group: Column, cut) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(group))), lambda n: cut(group, n))

    def addresses(z: Column) -> Column:
        ends, begins = sides(z["0"], F.right), sides(z["2"], F.left)
        return F.flatten(F.transform(ends, lambda e: F.transform(begins, lambda b: F.concat_ws(".", e, z["1"], b))))
    return F.flatten(F.transform(F.arrays_zip(first.alias("0"), middle.alias("1"), last.alias("2")), addresses))


def chunk_needles(chunks: DataFrame, longest: Column | None = None) -> DataFrame:
    """chunk_id, doc_id, needle: every identifier that a question could ask for and the chunk contains.

    ``longest`` is the length of the longest identifier asked for; runs are cut there, so that a
    long run of digits stays cheap.
    """
    low = F.lower("content")
    codes = F.transform(text.all_matches(low, _CODE_RUN), lambda r: r if longest is None else F.concat(
        F.right(F.regexp_extract(r, _CODE, 1), F.lit(6)), F.regexp_extract(r, _CODE, 2),
        F.left(F.regexp_extract(r, _CODE, 3), longest)))
    codes = F.flatten(F.transform(F.array_distinct(codes), _needles_of_code))
    dotted = F.flatten(F.transform(F.array_distinct(text.all_matches(low, _DOTTED_RUN)), _needles_of_dotted))
    return chunks.select("chunk_id", "doc_id", F.explode(F.array_distinct(F.concat(codes, dotted))).alias("needle"))


def keyword_search(queries: DataFrame, scope: DataFrame, docs: DataFrame, chunks: DataFrame,
                   options: Options = DEFAULTS, asked: DataFrame | None = None, few: DataFrame | None = None) -> DataFrame:
    """Ready chunks in scope that contain an identifier of the question, in any case.

    Only texts of documents in scope are read, and only identifiers that some question of the scope asks for
    leave the chunks; scope and identifier then meet in one equi-join.  Where a chunk has several of a question's
    identifiers, the first of them stands for the chunk.

    The questions in ``few`` (query_id) get only those hits that ``select_ranked`` can choose.  All hits have one score, so the first of a scope and identifier
    by page diversity are known before questions come in: a hit behind them has as many better rows on as many pages in whatever the
    question finds besides, and the ranks on pages of what is chosen do not hang on it.
    """
    ready = ready_scope(scope, docs).withColumnRenamed("query_id", "scope_id")
    if asked is None:
        asked = ready.select(F.col("scope_id").alias("query_id"), "scope_id").distinct()
    needles = query_identifiers(queries).groupBy("query_id").agg(F.collect_set("needle").alias("_asked"))
    mine = needles.join(asked, "query_id").select("query_id", "scope_id", "_asked", F.explode("_asked").alias("needle"))
    wanted = mine.select("scope_id", "needle").distinct()
    longest = wanted.agg(F.coalesce(F.max(F.length("needle")), F.lit(3)).alias("_longest"))
    inside = chunks.join(ready.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_longest", longest.scalar())
    found = (chunk_needles(inside, F.col("_longest")).join(ready, "doc_id").join(wanted, ["scope_id", "needle"])
             .groupBy("scope_id", "chunk_id", "doc_id").agg(F.collect_set("needle").alias("_found")))
    # read twice below: ids and identifiers only
    found = cut_lineage(found)
    at = F.to_json(F.struct("scope_id", "needle"))
    rows = found.withColumn("needle", F.explode("_found")).select(at.alias("query_id"), "chunk_id", "doc_id", "_found", F.col("needle").alias("_by"))
    mine = mine.select("query_id", at.alias("scope_id"), "_asked")

    def paired(mine: DataFrame, rows: DataFrame) -> DataFrame:
        first = F.array_min(F.array_intersect("_asked", "_found"))
        return pair_up(mine, rows).where(F.col("_by") == first).select("query_id", "chunk_id", "doc_id").withColumn("score", F.lit(options.keyword_score))

    if few is None or options.keyword_score < options.min_score:
        return paired(mine, rows)
    on_pages = rows.join(chunks.select("chunk_id", "doc_id", "page_number").distinct(), ["chunk_id", "doc_id"])
    on_page = F.row_number().over(Window.partitionBy("query_id", "doc_id", "page_number").orderBy("chunk_id"))
    best = top_per_group(on_pages.withColumn("_page_rank", on_page), ["query_id"], [F.col("_page_rank") > options.max_per_page, F.col("chunk_id")],
                         max(options.top_k, options.fallback_rows), "_r")
    best = best.select(*rows.columns).dropDuplicates(["query_id", "chunk_id", "doc_id"])
    return paired(mine.join(few, "query_id", "left_anti"), rows).unionByName(paired(mine.join(few, "query_id", "left_semi"), best))


def keyword_boost(scored: DataFrame, keyword_hits: DataFrame | None = None, options: Options = DEFAULTS) -> DataFrame:
    """Scores raised to the keyword score where a hit names the row; without ``keyword_hits`` the rows say so in the column hit."""
    if keyword_hits is not None:
        scored = scored.join(keyword_hits.select("query_id", "chunk_id", F.lit(True).alias("hit")), ["query_id", "chunk_id"], "left")
    return scored.withColumn("score", F.when(F.col("hit"), F.greatest("score", F.lit(options.keyword_score))).otherwise(F.col("score"))).drop("hit")


def hybrid_merge(vector_hits: DataFrame, keyword_hits: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Vector and keyword hits by chunk with the better score.

    Keyword hits count only for questions whose index search returned anything
    (``gate``, by default the questions in ``vector_hits``).
    """
    gate = (vector_hits if gate is None else gate).select("query_id").distinct()
    columns = ["query_id", "chunk_id", "doc_id"]
    return (vector_hits.select(*columns, "score")
            .unionByName(keyword_hits.join(gate, "query_id", "left_semi").select(*columns, "score"))
            .groupBy(*columns).agg(F.max("score").alias("score")))


def search_fallback(index_hits: DataFrame, keyword_hits: DataFrame, scope: DataFrame, docs: DataFrame,
                    chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
                    options: Options = DEFAULTS, asked: DataFrame | None = None) -> DataFrame:
    """Index result of a question when there is one, else an exact scan of its documents.

    Stale index hits (chunk gone) drop out here.
    """
    place = chunks.select("chunk_id", F.col("doc_id").alias("_doc"), "chunk_index", "page_number")
    merged = (hybrid_merge(index_hits.join(place.select("chunk_id"), "chunk_id", "left_semi"), keyword_hits,
                           gate=index_hits)
              .join(place, "chunk_id").withColumn("doc_id", F.col("_doc")).select(*RANKING))
    left, rest = _unanswered(scope, merged, asked)
    scan = exact_scan(left, docs, chunks, vectors, query_vectors, keyword_hits, options, rest)
    return merged.unionByName(scan)


# ── selection ─────────────────────────────────────────────────────────────────


def threshold_or_top(scored: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Rows at or above the relevance threshold; the best few of a question that has none.

    ``scored``: all candidates, or those of ``threshold_scan``.
    """
    passing = scored.where(F.col("score") >= options.min_score)
    if "best" in scored.columns:
        passing, scored = passing.where(~F.col("best")).drop("best"), scored.where("best").drop("best")
    best = top_per_group(scored, ["query_id"], by_score(), options.fallback_rows, "_r")
    top = F.max("score").over(Window.partitionBy("query_id"))
    rescued = best.withColumn("_top", top).where(F.col("_top") < options.min_score).drop("_r", "_top")
    return passing.unionByName(rescued)


def page_diversity(candidates: DataFrame, top: int, per_page: int) -> DataFrame:
    """At most ``per_page`` chunks of one page in score order, then the best of the rest.

    A row with ``top`` better rows on its own page can never be chosen, so both
    windows carry a group limit and prune before their shuffle.
    """
    on_page = top_per_group(candidates, ["query_id", "doc_id", "page_number"], by_score(), top, "_page_rank")
    order = [F.col("_page_rank") > per_page, *by_score()]
    return top_per_group(on_page, ["query_id"], order, top).drop("_page_rank")


def select_ranked(scored: DataFrame, top: int, options: Options = DEFAULTS) -> DataFrame:
    """Threshold, rescue of the best few and page diversity in two shuffles.

    Failing rows sort after all passing ones and survive only when no row of the
    question passes.
    """
    keep = max(top, options.fallback_rows)
    on_page = top_per_group(scored, ["query_id", "doc_id", "page_number"], by_score(), keep, "_page_rank")
    fails = F.col("score") < options.min_score
    crowded = F.col("_page_rank") > options.max_per_page
    order = [fails, ~fails & crowded, *by_score()]
    ranked = top_per_group(on_page, ["query_id"], order, keep)
    passed = F.max(F.col("score") >= options.min_score).over(Window.partitionBy("query_id"))
    return (ranked.withColumn("_passed", passed)
            .where((F.col("rank") <= top) & (~fails | (~F.col("_passed") & (F.col("rank") <= options.fallback_rows))))
            .drop("_page_rank", "_passed"))


def _spread(scored: DataFrame, key: str, half: int) -> DataFrame:
    """Rows evenly spread over the chunk order of each ``key``."""
    numeric = dict(scored.dtypes)["chunk_id"] in ("int", "bigint")
    slot = F.floor(F.col("chunk_id") / 65536) if numeric else F.substring("chunk_id", 1, 2)
    placed = bucketed_rank(scored, [key], {"_index": F.col("chunk_index"), "_slot": slot}, [F.col("chunk_id")], "_pos", "_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / (half + 1)))
    at = F.col("_pos") - 1
    return placed.where((at > 0) & (at % step == 0) & (at / step <= half)).drop("_pos", "_n")


def document_wide_sample(scored: DataFrame, top: int, options: Options = DEFAULTS) -> DataFrame:
    """Half best by score, half evenly spread over the chunk order, duplicates not refilled.

    ``scored``: all candidates, or those of ``wide_scan``, whose places are known.
    """
    half = top // 2
    known = "spread" in scored.columns
    spread = scored.where("spread").drop("spread") if known else _spread(scored, "query_id", half)
    scored = scored.where(~F.col("spread")).drop("spread") if known else scored
    best = top_per_group(scored, ["query_id"], by_score(), max(half, options.fallback_rows), "_r")
    peak = F.max("score").over(Window.partitionBy("query_id"))
    best = (best.withColumn("_peak", peak)
            .where((F.col("_r") <= half) & ((F.col("score") >= options.min_score)
                                            | ((F.col("_peak") < options.min_score)
                                               & (F.col("_r") <= options.fallback_rows))))
            .drop("_r", "_peak"))
    chosen = best.unionByName(spread.select(*best.columns)).dropDuplicates(["query_id", "chunk_id"])
    w = Window.partitionBy("query_id").orderBy(*by_score())
    return chosen.withColumn("rank", F.row_number().over(w))


# ── rows of the answer ────────────────────────────────────────────────────────


def named_documents(docs: DataFrame, files: DataFrame) -> DataFrame:
    return (docs.select("doc_id", "title", "file_id")
            .join(files.select("file_id", "original_file_name"), "file_id", "left")
            .select("doc_id", "title", F.coalesce("original_file_name", "title").alias("file_name")))


def hits_to_chunks(hits: DataFrame, chunks: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """Chosen hits with content, title and file name; the title stands in for a missing file."""
    names = chunks.select("chunk_id", "doc_id").distinct().join(named_documents(docs, files), "doc_id")
    detail = chunks.select("chunk_id", "doc_id", "chunk_index", "page_number", "heading", "content")
    found = hits.drop(*[c for c in ("doc_id", "chunk_index", "page_number") if c in hits.columns])
    # names come to the hits by the ids of a chunk: a text moves once, by its own id, however many questions found it
    return (found.join(names, "chunk_id").join(detail, ["chunk_id", "doc_id"])
            .select("chunk_id", *[c for c in found.columns if c != "chunk_id"], *detail.columns[1:], "title", "file_name"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """Chunks without their text: characters, characters once trimmed, and table rows.

    Measured once per chunk, before chunks are paired with questions.
    """
    return chunks.select("chunk_id", "doc_id", "chunk_index", F.length("content").alias("chars"),
                         F.length(text.strip("content")).alias("body_chars"), text.count_source_rows("content").alias("table_rows"))


def full_document_chunks(scope: DataFrame, docs: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """All Ready chunks of a question, to be read in (doc_id, chunk_index) order, at score 1."""
    wanted = ready_scope(scope, docs).join(chunks.select("doc_id", "chunk_id"), "doc_id")
    return hits_to_chunks(wanted, chunks, docs, files).withColumn("score", F.lit(1.0))


def full_document_sizes(scope: DataFrame, docs: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The same chunks with sizes in place of text, for decisions about what fits where."""
    return ready_scope(scope, docs).join(named_documents(docs, files), "doc_id").join(chunk_sizes(chunks), "doc_id")


def retrieve_scored(queries: DataFrame, scope: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame,
                    points: DataFrame, query_vectors: DataFrame, options: Options = DEFAULTS, asked: DataFrame | None = None,
                    chosen: bool = False) -> DataFrame:
    """Candidates of file retrieval with their final scores, before selection.

    With ``chosen`` keyword hits that the selection cannot take are left out, for questions that are not document-wide.
    """
    flagged = queries.select("query_id", "query_text", intents.document_wide_flag("query_text").alias("document_wide"))
    wide_top = max(options.top_k, options.document_wide_top_k)
    hits = vector_topk(points, scope, query_vectors, options.overfetch * wide_top, asked)
    limit = F.when(F.col("document_wide"), wide_top).otherwise(options.top_k) * options.overfetch
    hits = (hits.join(flagged.select("query_id", "document_wide"), "query_id").where(F.col("rank") <= limit)
            .drop("rank", "document_wide"))
    # both are small (ids and scores) and read several times below
    # a repeated id may stand for a document-wide question as well
    few = flagged.groupBy("query_id").agg(F.bool_or("document_wide").alias("_wide")).where(~F.col("_wide")).select("query_id") if chosen else None
    hits, keywords = cut_lineage(hits), cut_lineage(keyword_search(queries, scope, docs, chunks, options, asked, few))
    scored = search_fallback(hits, keywords, scope, docs, chunks, vectors, query_vectors, options, asked)
    return scored.join(flagged.select("query_id", "document_wide"), "query_id")


def retrieve_files(queries: DataFrame, query_files: DataFrame, files: DataFrame, docs: DataFrame,
                   chunks: DataFrame, vectors: DataFrame, points: DataFrame, query_vectors: DataFrame,
                   options: Options = DEFAULTS, content: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """Best chunks of every question over its files."""
    filled = queries.where(~text.is_blank("query_text"))
    scope = resolve_documents(query_files, files, docs)
    scored = cut_lineage(retrieve_scored(filled, scope, docs, chunks, vectors, points, query_vectors, options, asked, chosen=True))
    narrow = select_ranked(scored.where(~F.col("document_wide")).select(*RANKING), options.top_k, options)
    wide = document_wide_sample(scored.where(F.col("document_wide")).select(*RANKING),
                                max(options.top_k, options.document_wide_top_k), options)
    chosen = narrow.unionByName(wide.select(*narrow.columns))
    return hits_to_chunks(chosen, chunks, docs, files) if content else chosen


def retrieve_collections(queries: DataFrame, query_collections: DataFrame, memberships: DataFrame, files: DataFrame,
                         docs: DataFrame, chunks: DataFrame, vectors: DataFrame, points: DataFrame,
                         query_vectors: DataFrame, options: Options = DEFAULTS, asked: DataFrame | None = None) -> DataFrame:
    """Best chunks of every question over the knowledge collections it may read.

    No keyword step and no whole-document path here.
    """
    filled = queries.where(~text.is_blank("query_text")).select("query_id")
    vectors_of = query_vectors.join(filled, "query_id", "left_semi")
    # ids and scores, read several times below
    hits = cut_lineage(vector_topk_collections(points, query_collections, vectors_of, options.overfetch * options.top_k, asked))
    place = chunks.select("chunk_id", "doc_id", "chunk_index", "page_number")
    mapped = hits.drop("doc_id", "rank").join(place, "chunk_id").select(*RANKING)
    # an index hit of any kind settles the question, even one that turns out stale; only the others' collections are looked up
    left, rest = _unanswered(query_collections, hits, asked)
    scored = mapped.unionByName(exact_scan(collection_documents(left, memberships), docs, chunks, vectors, vectors_of, asked=rest))
    return hits_to_chunks(select_ranked(scored, options.top_k, options), chunks, docs, files)


# ── quality and report ────────────────────────────────────────────────────────


def retrieval_quality(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per question: chunks, average, best and worst score, and chunks per file, largest first."""
    per_file = retrieved.groupBy("query_id", "file_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    stats = per_file.groupBy("query_id").agg(
        F.sum("n").alias("chunks"), (F.sum("s") / F.sum("n")).alias("avg_score"), F.max("hi").alias("max_score"),
        F.min("lo").alias("min_score"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "file_name", "n"))).alias("f"))
    sources = F.array_join(F.transform("f", lambda x: F.concat(
        x["file_name"], F.lit(" ("), x["n"].cast("string"), F.lit(" chunks)"))), "\n")
    zero = F.lit(0.0)
    return (queries.select("query_id").join(stats, "query_id", "left")
            .select("query_id", F.coalesce("chunks", F.lit(0)).alias("chunks"),
                    *[F.coalesce(c, zero).alias(c) for c in ("avg_score", "max_score", "min_score")],
                    F.coalesce(sources, F.lit("")).alias("sources")))


def retrieval_report(retrieved: DataFrame) -> DataFrame:
    """One printable line per retrieved chunk, ranked by score."""
    w = Window.partitionBy("query_id").orderBy(*by_score())
    page = F.concat(F.lit("p."), F.coalesce(F.col("page_number").cast("string"), F.lit("?")))
    heading = F.when(text.is_blank("heading"), F.lit("")).otherwise(F.concat(F.lit(" ["), F.col("heading"), F.lit("]")))
    # the preview is cut before rows move to their question, texts do not
    cut = retrieved.withColumn("preview", text.preview("content", 200)).drop("content")
    ranked = cut.withColumn("position", F.row_number().over(w))
    number = F.when(F.col("position") < 10, F.concat(F.lit("0"), F.col("position").cast("string"))).otherwise(
        F.col("position").cast("string"))
    line = F.concat(F.lit("["), number, F.lit("] "), "file_name", F.lit(" "), page, F.lit(" chunk="),
                    F.col("chunk_index").cast("string"), F.lit(" score="), F.format_string("%.4f", "score"), heading)
    return ranked.select("query_id", "position", line.alias("line"), "preview")

