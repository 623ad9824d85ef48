"""Context texts under character budgets.

What fits is decided on lengths, summed in two levels (buckets of a question's
documents, then one row per bucket), so no task sorts a question whole; text is
joined by its document or chunk to the rows that have room.

Questions that share a scope share its context: with ``asked`` (query_id, scope_id) the documents or sizes hold
scopes in query_id, and each prompt takes the text of its question's scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant import vocab
from foliant.functions import intents, kinds, text
from foliant.operators.coverage import ranked_codes
from foliant.options import DEFAULTS, Options
from foliant.plans.ranking import exclusive_running, join_text, order_buckets, text_parts, top_per_group
from foliant.plans.scopes import per_question
from foliant.session import cut_lineage


def _before(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _named(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


# ── whole documents, chunk by chunk ───────────────────────────────────────────


def ordered_chunks(sizes: DataFrame, budget: int) -> DataFrame:
    """Chunks of each question that fit, in document order.

    ``sizes``: query_id, chunk_id, doc_id, chunk_index, title, file_name, body_chars, … (no text: what
    fits is decided on lengths).  Adds position, header and room, the characters left for the body.  A missing
    title or file name is empty.
    """
    keys, at = ["query_id"], F.struct("doc_id", "chunk_index")
    placed = order_buckets(cut_lineage(sizes.withColumn("_at", at)), keys, "_at", name="_place")
    titled = exclusive_running(placed, keys, F.col("_place"), "_at", {}, {"_title": _named("title")})
    header = F.concat(F.lit("--- Dokument: "), _named("title"), F.lit(" (Fil: "), _named("file_name"), F.lit(") ---\n"))
    changed = F.col("_title").isNull() | (F.col("_title") != _named("title"))
    sized = (titled.withColumn("header", F.when(changed, header).otherwise(F.lit("")))
             .withColumn("_cost", F.length("header") + F.coalesce("body_chars", F.lit(0)) + 2))
    running = exclusive_running(sized, keys, F.col("_place"), "_at", {"_used": F.col("_cost")}, {})
    left = F.lit(budget) - F.col("_used")
    near = running.where(left > 0).withColumn("room", (left - F.length("header")).cast("int"))  # a chunk costs two characters or more: bounded from here
    stop = near.groupBy(*keys).agg(F.min(F.when(F.col("room") < 0, F.col("_at"))).alias("_stop"))
    kept = near.join(stop, keys).where(F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")))
    return (kept.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_at")))
            .drop("_at", "_place", "_title", "_cost", "_used", "_stop"))


def ordered_context(sent: DataFrame, chunks: DataFrame) -> DataFrame:
    """One text per question and the number of chunks in it, from ``ordered_chunks`` and the chunk texts."""
    body = F.left(text.strip("content"), F.col("room"))
    pieces = (sent.select("query_id", "chunk_id", "position", "header", "room")
              .join(chunks.select("chunk_id", "content"), "chunk_id")
              .select("query_id", "position", F.concat("header", body, F.lit("\n\n")).alias("piece")))
    return (pieces.groupBy("query_id").agg(join_text("piece", "position", "").alias("context"), F.count(F.lit(1)).alias("chunks_sent"))
            .withColumn("context", text.strip("context")))


# ── ranked excerpts ───────────────────────────────────────────────────────────


def ranked_context(retrieved: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Titled excerpts by score; the threshold applies again, else only the best chunk stays.

    Contents are cut to the longest excerpt before rows move to their question.
    """
    retrieved = retrieved.select(*[c for c in ("query_id", "chunk_id", "chunk_index", "page_number", "heading", "title", "file_name", "score") if c in retrieved.columns],
                                 text.left("content", options.max_chunk_chars).alias("_content"))
    best = F.max("score").over(Window.partitionBy("query_id"))
    by_score = [F.col("score").desc(), F.col("chunk_id")]
    near = top_per_group(retrieved, ["query_id"], by_score, options.max_context_chars // 40 + 1, "position")
    chosen = near.withColumn("_best", best).where(
        (F.col("score") >= options.min_score) | ((F.col("_best") < options.min_score) & (F.col("position") == 1)))
    head = F.concat(
        F.lit("--- Dokument: "), _named("title"), F.lit(" ---\nFil: "), _named("file_name"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("Sida: "), F.col("page_number").cast("string"), F.lit("\n")), F.lit("")),
        F.when(text.is_blank("heading"), F.lit("")).otherwise(F.concat(F.lit("\nRubrik: "), F.col("heading"))),
        F.lit("Chunk: "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("")), F.lit("  Relevans: "),
        F.format_string("%.4f", "score"), F.lit("\n\n"))
    tail = "\n\n--- Slut utdrag ---\n\n"
    sized = (chosen.withColumn("_head", head)
             .withColumn("_len", F.length("_head") + F.length(text.strip("_content")) + len(tail)))
    running = sized.withColumn("_used", F.coalesce(F.sum("_len").over(_before(["query_id"], "position")), F.lit(0)))
    room = (F.lit(options.max_context_chars) - F.col("_used")).cast("int")
    kept = running.where(room > 0).withColumn("piece", F.concat("_head", text.strip(F.left("_content", room)), F.lit(tail)))
    return (kept.groupBy("query_id").agg(join_text("piece", "position", "").alias("context"))
            .withColumn("context", text.strip("context")))


def context_instruction(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Which instruction goes with the excerpts: table content × document-wide question."""
    table = retrieved.groupBy("query_id").agg(
        F.bool_or(F.contains("content", F.lit("| ")) & F.contains("content", F.lit(" |"))).alias("has_table"))
    flagged = queries.join(table, "query_id").withColumn("document_wide", intents.document_wide_flag("query_text"))
    chain = None
    for (has, wide), value in vocab.SEMANTIC_INSTRUCTION.items():
        test = (F.col("has_table") == has) & (F.col("document_wide") == wide)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return flagged.select("query_id", "has_table", "document_wide", chain.alias("instruction"))


def collection_context(queries: DataFrame, retrieved: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Prompt over knowledge collections, or the fixed notice when nothing was found."""
    context = ranked_context(retrieved, options)
    return queries.join(context, "query_id", "left").select("query_id", F.concat(
        "query_text", F.when(F.col("context").isNull(), F.lit(vocab.NO_COLLECTION_CONTEXT))
        .otherwise(F.concat(F.lit(vocab.COLLECTION_INSTRUCTION + "\n"), "context"))).alias("prompt"))


# ── whole texts ───────────────────────────────────────────────────────────────


def _apart(documents: DataFrame, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Documents of questions with their sizes, and texts by document."""
    if texts is not None:
        return documents, texts
    return documents.withColumn("chars", F.length("text")).drop("text"), documents.select("doc_id", "text").dropDuplicates(["doc_id"])


def _document_pieces(documents: DataFrame, budget: int, head: Column, tail: str, texts: DataFrame | None = None) -> DataFrame:
    """Documents of each question (query_id, doc_id, title, document_type, chars) cut at the budget.

    Room is decided on running lengths alone, in two levels; ``texts`` (doc_id, text) meet by document the few
    that have some left.  Blank texts cost nothing, so any number of them may come first.  Without ``texts``
    the documents carry their text.
    """
    documents, texts = _apart(documents, texts)
    sizes = order_buckets(cut_lineage(documents.select("query_id", "doc_id", "chars")), ["query_id"], "doc_id", name="_place")
    room = exclusive_running(sizes, ["query_id"], F.col("_place"), "doc_id", {"_used": F.col("chars")}, {}).select(
        "query_id", "doc_id", (F.lit(budget) - F.col("_used")).cast("int").alias("_room")).where("_room > 0")
    kept = documents.join(room, ["query_id", "doc_id"]).join(texts, "doc_id").withColumn("position", F.col("doc_id"))
    return kept.withColumn("piece", F.concat(head, text.strip(F.left("text", F.col("_room"))), F.lit(tail)))


def _direct_body(documents: DataFrame, budget: int, texts: DataFrame | None) -> DataFrame:
    note = F.when(kinds.is_table_type("document_type"), F.lit(vocab.TABLE_NOTE + "\n")).otherwise(F.lit(""))
    head = F.concat(F.lit("--- Dokument: "), _named("title"), F.lit(" ---\n"), note, F.lit("\n"))
    pieces = _document_pieces(documents, budget, head, "\n\n--- Slut ---\n\n", texts)
    return (pieces.groupBy("query_id").agg(join_text("piece", "position", "").alias("body"))
            .withColumn("body", text.strip("body")))


def direct_context(queries: DataFrame, documents: DataFrame, options: Options = DEFAULTS, texts: DataFrame | None = None,
                   asked: DataFrame | None = None) -> DataFrame:
    """Prompt with whole documents in sequence, cut at the context budget."""
    body = _direct_body(documents, options.max_context_chars, texts)
    table = documents.groupBy("query_id").agg(F.bool_or(kinds.is_table_type("document_type")).alias("_table"))
    instruction = F.when(F.col("_table"), F.lit(vocab.DIRECT_INSTRUCTION[True])).otherwise(
        F.lit(vocab.DIRECT_INSTRUCTION[False]))
    return (per_question(queries, body.join(table, "query_id"), asked)
            .select("query_id", F.concat("query_text", instruction, F.lit("\n"), "body").alias("prompt")))


def enumeration_instruction(intent: Column, hints: Column, count: Column) -> Column:
    listed = F.concat(
        F.lit(vocab.ENUMERATION_HINT_HEAD.split("{n}")[0]), count.cast("string"),
        F.lit(vocab.ENUMERATION_HINT_HEAD.split("{n}")[1]),
        F.array_join(F.transform(hints, lambda m: F.concat(F.lit("- "), m, F.lit("\n"))), ""),
        F.lit(vocab.ENUMERATION_HINT_TAIL))
    return F.concat(
        F.lit(vocab.ENUMERATION_RULES),
        F.when(intent == "TableEnumeration", F.lit(vocab.ENUMERATION_TABLE_NOTE)).otherwise(F.lit("")),
        F.when(count > 0, listed).otherwise(F.lit("")), F.lit(vocab.ENUMERATION_CONTENT))


def candidate_hints(documents: DataFrame, options: Options = DEFAULTS, texts: DataFrame | None = None) -> DataFrame:
    """Number of model codes in a question's documents and the first of them.

    A document's codes are found once, however many questions read it.
    """
    documents, texts = _apart(documents, texts)
    found = texts.select("doc_id", F.explode(F.array_distinct(text.model_codes("text"))).alias("code"))
    return first_hints(ranked_codes(documents.select("query_id", "doc_id").join(found, "doc_id").select("query_id", "code"), ["query_id"]), options)


def first_hints(codes: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """query_id, candidates, hints from ranked codes."""
    codes = cut_lineage(codes)
    count = codes.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    first = (codes.where(F.col("rank") <= options.candidate_hints).groupBy("query_id")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("hints")))
    return count.join(first, "query_id")


def enumeration_context(queries: DataFrame, documents: DataFrame, options: Options = DEFAULTS, texts: DataFrame | None = None,
                        asked: DataFrame | None = None) -> DataFrame:
    """Prompt that asks for an inventory, with candidate hints.  ``queries`` carry intent."""
    body = _direct_body(documents, options.full_document_chars, texts)
    found = per_question(queries, body.join(candidate_hints(documents, options, texts), "query_id", "left"), asked)
    instruction = enumeration_instruction(F.col("intent"), F.col("hints"), F.coalesce("candidates", F.lit(0)))
    return found.select("query_id", F.concat("query_text", instruction, "body").alias("prompt"))


def structured_context(queries: DataFrame, answers: DataFrame, documents: DataFrame, options: Options = DEFAULTS,
                       debug: bool = False, texts: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Prompt that explains an exact answer."""
    def line(label: str, value: Column | str) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.concat(F.lit(label), value.cast("string"), F.lit("\n"))

    def optional(label: str, name: str, test: Column) -> Column:
        return F.when(test, line(label, name)).otherwise(F.lit(""))

    has_column = ~text.is_blank("column_used")
    if debug:
        named = ~text.is_blank("extractor_name")
        block = F.concat(
            F.lit(vocab.ANSWER_DEBUG_HEAD), line("Result:            ", "value"), line("Method:            ", "method"),
            line("Confidence:        ", F.concat(F.format_string("%.0f", "confidence"), F.lit("%"))),
            F.when(named, F.concat(line("Extractor:         ", F.concat("extractor_name", F.lit(" v"), "extractor_version")),
                                   line("ExtractorPriority: ", "extractor_priority"),
                                   line("CandidateCount:    ", "candidate_count"))).otherwise(F.lit("")),
            line("RowsProcessed:     ", "rows_processed"), optional("Column:            ", "column_used", has_column),
            optional("FallbackExtractor: ", "fallback_extractor", ~text.is_blank("fallback_extractor")),
            optional("ValuesExtracted:   ", "values_extracted", F.col("values_extracted") > 0),
            optional("DistinctValues:    ", "distinct_values", F.col("distinct_values") > 0), F.lit(vocab.ANSWER_DEBUG_TAIL))
    else:
        block = F.concat(F.lit(vocab.ANSWER_HEAD), line("Result: ", "value"),
                         optional("Source column: ", "column_used", has_column), F.lit(vocab.ANSWER_TAIL))
    head = F.concat(F.lit("--- "), _named("title"), F.lit(" ---\n"))
    pieces = (_document_pieces(documents, options.max_context_chars, head, "\n--- End ---\n", texts).groupBy("query_id")
              .agg(join_text("piece", "position", "").alias("_excerpt")))
    return (per_question(queries.select("query_id", "query_text").join(answers, "query_id"), pieces, asked, "left")
            .select("query_id", F.concat("query_text", block, F.lit(vocab.ANSWER_CONTEXT_HEAD),
                                         F.coalesce("_excerpt", F.lit(""))).alias("prompt")))


# ── several passes over long documents ────────────────────────────────────────


def batch_split(sizes: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Consecutive batches of at most so many characters; what exceeds the last batch joins it.

    A batch starts at the first chunk that overflows the one before, so the
    starts follow from running lengths by one small aggregate per batch, and the
    running lengths are summed in two levels.  No task walks a whole document set.
    """
    sized = cut_lineage(sizes.select("query_id", "chunk_id", F.struct("doc_id", "chunk_index").alias("_at"), F.col("chars").alias("_len")))
    placed = exclusive_running(order_buckets(sized, ["query_id"], "_at", name="_place"), ["query_id"], F.col("_place"), "_at", {"_used": F.col("_len")}, {})
    # positions and running lengths only, read once per batch below
    ids = cut_lineage(placed.select("query_id", "chunk_id", "_at", "_used", "_len"))
    starts = ids.groupBy("query_id").agg(F.array(F.min(F.struct("_at", "_used"))).alias("starts"))
    for _ in range(options.max_passes - 1):
        last = F.element_at("starts", -1)
        over = (F.col("_used") + F.col("_len") - last["_used"] > options.chars_per_pass) & (F.col("_at") > last["_at"])
        found = (ids.join(starts, "query_id").groupBy("query_id").agg(
            F.first("starts").alias("starts"), F.min(F.when(over, F.struct("_at", "_used"))).alias("s")))
        starts = found.select("query_id", F.when(F.col("s").isNull(), F.col("starts")).otherwise(
            F.array_append("starts", F.col("s"))).alias("starts"))
    number = F.size(F.filter("starts", lambda s: s["_at"] <= F.col("_at")))
    return ids.join(starts, "query_id").select("query_id", "chunk_id", number.alias("batch_no"))


def _batch_pieces(batched: DataFrame, sizes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of each batch as text, with a title line where the document changes; positions without text come first."""
    keys = ["query_id", "batch_no"]
    where = cut_lineage(batched.join(sizes.select("query_id", "chunk_id", "title", F.struct("doc_id", "chunk_index").alias("_at")), ["query_id", "chunk_id"]))
    placed = exclusive_running(order_buckets(where, keys, "_at", name="_place"), keys, F.col("_place"), "_at", {}, {"_title": _named("title")})
    changed = F.col("_title").isNull() | (F.col("_title") != _named("title"))
    title = F.when(changed, F.concat(F.lit("--- "), _named("title"), F.lit(" ---\n"))).otherwise(F.lit(""))
    return (placed.join(chunks.select("chunk_id", "content"), "chunk_id")
            .select(*keys, "_at", F.concat(title, text.strip("content"), F.lit("\n\n")).alias("piece")))


def batch_context(batched: DataFrame, sizes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text of each batch with a title line where the document changes."""
    return (_batch_pieces(batched, sizes, chunks).groupBy("query_id", "batch_no")
            .agg(join_text("piece", "_at", "").alias("context"), F.count(F.lit(1)).alias("chunks"))
            .withColumn("context", text.strip("context")))


def batch_context_parts(batched: DataFrame, sizes: DataFrame, chunks: DataFrame, part_chars: int = DEFAULTS.full_document_chars) -> DataFrame:
    """The same texts, not stripped, as parts of about ``part_chars`` characters: the last batch, which takes all that is left, may be of any length."""
    return text_parts(cut_lineage(_batch_pieces(batched, sizes, chunks)), ["query_id", "batch_no"], "_at", "piece", part_chars)


def extraction_requests(queries: DataFrame, contexts: DataFrame, options: Options = DEFAULTS, asked: DataFrame | None = None) -> DataFrame:
    """One request per batch and a merge request where there are several.

    The merge request names the lists it will receive; their texts exist only
    once the requests have been answered.
    """
    totals = contexts.groupBy("query_id").agg(F.max("batch_no").alias("total"))
    mine = per_question(queries.select("query_id", "query_text", "intent"), totals, asked)
    passes = F.col("total") + F.when(F.col("total") > 1, 1).otherwise(0) + int(options.verification_pass)
    mine = mine.join(mine.select("query_id", passes.alias("pass_count")), "query_id")
    task = F.when(F.col("intent") == "TableEnumeration", F.lit(vocab.EXTRACT_TASK_TABLE)).otherwise(F.lit(vocab.EXTRACT_TASK_ITEMS))
    slots = {"query": F.col("query_text"), "no": F.col("batch_no").cast("string"), "total": F.col("total").cast("string"),
             "context": F.col("context"), "task": task}
    per_batch = (per_question(mine, contexts.select("query_id", "batch_no", "context"), asked)
                 .select("query_id", F.lit("extract").alias("kind"), "batch_no", fill(vocab.EXTRACT_PROMPT, slots).alias("prompt"), "pass_count"))
    lists = F.array_join(F.transform(F.sequence(F.lit(1), F.col("total")), lambda i: F.concat(
        F.lit("Avsnitt "), i.cast("string"), F.lit(":\n{"), i.cast("string"), F.lit("}"))), "\n\n--- Nästa avsnitt ---\n\n")
    merge = (mine.where(F.col("total") > 1)
             .select("query_id", F.lit("merge").alias("kind"), (F.col("total") + 1).alias("batch_no"),
                     fill(vocab.MERGE_PROMPT, {"query": F.col("query_text"), "lists": lists}).alias("prompt"), "pass_count"))
    return per_batch.unionByName(merge)


def fill(template: str, slots: dict[str, Column]) -> Column:
    """A text template with columns in its {slots}."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), slots[name]]
    return F.concat(*parts, F.lit(rest))
