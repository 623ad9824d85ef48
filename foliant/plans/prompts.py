"""The prompt of every question over its files, whichever way it is answered, in one job.

A question waits, is answered exactly, gets its small documents whole, its documents in order, or the best
excerpts.  Each way works on its own questions only; the branches are unioned at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foliant import vocab
from foliant.functions import intents, text
from foliant.operators import context as cx, coverage as cv, retrieval as r, strategy as st
from foliant.options import DEFAULTS, Options
from foliant.plans.scopes import per_question
from foliant.session import cut_lineage


def full_document_prompts(queries: DataFrame, scope: DataFrame, docs: DataFrame, chunks: DataFrame, files: DataFrame,
                          options: Options = DEFAULTS, asked: DataFrame | None = None) -> DataFrame:
    """Prompts with all chunks in document order, as far as they fit.  ``queries``: query_id, prompt, intent."""
    mine = cut_lineage(r.part_of(scope, queries, asked))
    sizes = cut_lineage(r.full_document_sizes(mine, docs, chunks, files))
    sent = cut_lineage(cx.ordered_chunks(sizes, options.full_document_chars))
    context = cx.ordered_context(sent, chunks).select("query_id", "context")
    any_chunk = sizes.select("query_id").distinct().withColumn("_any", F.lit(True))
    read = r.part_of(sizes, queries.where(intents.is_enumeration("intent")), asked).select("query_id", "chunk_id")
    found = (chunks.join(read.select("chunk_id").distinct(), "chunk_id", "left_semi")
             .select("chunk_id", F.explode(F.array_distinct(text.model_codes("content"))).alias("code")))
    hints = cx.first_hints(cv.ranked_codes(read.join(found, "chunk_id").select("query_id", "code"), ["query_id"]), options)
    joined = per_question(queries, any_chunk.join(context, "query_id", "left").join(hints, "query_id", "left"), asked, "left")
    instruction = F.when(intents.is_enumeration("intent"), cx.enumeration_instruction(
        F.col("intent"), F.col("hints"), F.coalesce("candidates", F.lit(0)))).otherwise(F.lit(vocab.FULL_DOCUMENT_INSTRUCTION))
    whole = F.concat("prompt", instruction, F.lit("\n"), F.coalesce("context", F.lit("")))
    return joined.select("query_id", F.when(F.col("_any"), whole).otherwise(F.concat("prompt", F.lit(vocab.NO_FILE_CHUNKS))).alias("prompt"))


def semantic_prompts(queries: DataFrame, retrieved: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Prompts with the best excerpts, or the notice that there are none.  ``queries``: query_id, query_text, prompt."""
    context = cx.ranked_context(retrieved, options)
    instruction = cx.context_instruction(queries, retrieved).select("query_id", "instruction")
    joined = queries.join(context.join(instruction, "query_id"), "query_id", "left")
    return joined.select("query_id", F.concat("prompt", F.when(F.col("context").isNull(), F.lit(vocab.NO_FILE_CONTEXT)).otherwise(
        F.concat("instruction", F.lit("\n"), "context"))).alias("prompt"))


def answer_prompts(queries: DataFrame, query_files: DataFrame, files: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame,
                   points: DataFrame, query_vectors: DataFrame, answers: DataFrame, options: Options = DEFAULTS,
                   asked: DataFrame | None = None) -> DataFrame:
    """Strategy and prompt of every question: query_id, strategy, prompt.

    ``queries``: query_id, query_text, intent; ``answers``: the exact answers over the questions' tables.  The notice about
    documents that are still pending goes into the prompt; columns, excerpts and intents are looked up with the question alone.
    With ``asked`` (query_id, scope_id) ``query_files`` holds scopes in query_id.
    """
    scope = cut_lineage(r.resolve_documents(query_files, files, docs))
    prompted = st.processing_guard(queries, scope, docs, asked).select("query_id", "prompt")
    chosen = st.choose_strategy(queries, scope, docs, answers, options, asked).select("query_id", "strategy")
    with_files = query_files.select("query_id").distinct()
    if asked is not None:
        with_files = asked.join(with_files.withColumnRenamed("query_id", "scope_id"), "scope_id", "left_semi").select("query_id")
    questions = cut_lineage(queries.select("query_id", "query_text", "intent").join(prompted, "query_id").join(chosen, "query_id")
                            .join(with_files.withColumn("_files", F.lit(True)), "query_id", "left"))
    way = F.when(F.col("_files"), F.col("strategy")).otherwise(F.lit("NoFiles"))
    questions = questions.withColumn("strategy", way).drop("_files")
    only = lambda *names: questions.where(F.col("strategy").isin(*names))
    with_prompt = lambda df: df.drop("query_text").withColumnRenamed("prompt", "query_text")

    plain = only("StillProcessing", "NoFiles").select("query_id", "prompt")
    texts = st.document_texts(docs)
    tables = docs.where(F.col("document_type").isin(vocab.TABLE_DOCUMENT_TYPES))
    exact = with_prompt(only("StructuredDataEngine"))
    structured = cx.structured_context(exact, answers, st.ready_sizes(r.part_of(scope, exact, asked), tables), options, texts=texts, asked=asked)
    small = with_prompt(only("SmallDocumentDirectContext"))
    sizes = cut_lineage(st.ready_sizes(r.part_of(scope, small, asked), docs))
    listing = intents.is_enumeration("intent")
    shown, listed = small.where(~listing), small.where(listing)
    direct = cx.direct_context(shown, r.part_of(sizes, shown, asked), options, texts, asked)
    enumerated = cx.enumeration_context(listed, r.part_of(sizes, listed, asked), options, texts, asked)
    full = full_document_prompts(only("FullDocumentRetrieval"), scope, docs, chunks, files, options, asked)
    loose = only("SemanticRetrieval")
    loose_files = r.part_of(query_files, loose, asked)
    # ids and scores are kept; texts come in where they are read
    found = cut_lineage(r.retrieve_files(loose.select("query_id", "query_text"), loose_files, files, docs, chunks, vectors, points,
                                         query_vectors.join(loose.select("query_id"), "query_id", "left_semi"), options, content=False, asked=asked))
    semantic = semantic_prompts(loose, r.hits_to_chunks(found, chunks, docs, files), options)
    prompts = reduce(DataFrame.unionByName, [plain, structured, direct, enumerated, full, semantic])
    return questions.select("query_id", "strategy").join(prompts, "query_id")
