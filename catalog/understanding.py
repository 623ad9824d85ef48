"""Question understanding, context assembly and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import retrieval as rq, tables as tq
from catalog.inputs import Tables, register
from catalog.sqltext import BLANK, TRIM, in_list, quote
from foliant import vocab
from foliant.functions import intents, text
from foliant.operators import answers as an, context as cx, coverage as cv, retrieval as r, strategy as st
from foliant.options import DEFAULTS
from foliant.plans import prompts as pr, session as sm
from foliant.plans.scopes import to_questions
from foliant.session import cut_lineage

INTENT = tq.intent_sql("lower(query_text)")

register("classify_intent", lambda t: t.questions.select("query_id", intents.classify_intent("query_text").alias("intent")),
         f"SELECT query_id, {INTENT} AS intent FROM questions", ["questions"])
register("intent_flags",
         lambda t: an.classify(t.questions).select("query_id", intents.needs_full_document("intent").alias("full_document"),
                                                   intents.is_enumeration("intent").alias("enumeration"),
                                                   intents.is_structured("intent").alias("structured")),
         f"""SELECT query_id, i IN ({in_list(vocab.FULL_DOCUMENT_INTENTS)}) AS full_document, i IN ({in_list(vocab.ENUMERATION_INTENTS)})
               AS enumeration, i IN ({in_list(vocab.STRUCTURED_INTENTS)}) AS structured FROM (SELECT query_id, {INTENT} AS i FROM questions) z""",
         ["questions"])
register("document_wide_flag", lambda t: t.questions.select("query_id", intents.document_wide_flag("query_text").alias("document_wide")),
         f"SELECT query_id, {rq.WIDE} AS document_wide FROM questions", ["questions"])

# ── guard and strategy ────────────────────────────────────────────────────────
GUARD = f"""per AS (SELECT s.query_id, count(*) FILTER (status NOT IN ('Ready', 'Blocked', 'Failed')) AS pending, count(*) FILTER (status = 'Ready') AS ready,
    string_agg('- ' || title || ': ' || coalesce(processing_stage, status) || coalesce(' ' || progress_current || '/' || progress_total, ''), chr(10)
      ORDER BY d.doc_id) FILTER (status NOT IN ('Ready', 'Blocked', 'Failed')) AS lines FROM scope s JOIN docs d ON d.doc_id = s.doc_id GROUP BY s.query_id),
  guard AS (SELECT q.query_id, coalesce(pending, 0) AS pending, coalesce(ready, 0) AS ready, coalesce(pending, 0) > 0 AND coalesce(ready, 0) = 0 AS short_circuit,
    CASE WHEN coalesce(pending, 0) = 0 THEN query_text ELSE query_text || {quote(chr(10) * 2 + vocab.PENDING_HEAD)} || lines || {quote(vocab.PENDING_TAIL)} END AS prompt
    FROM questions q LEFT JOIN per p ON p.query_id = q.query_id)"""
SCOPED = ["questions", "query_files", "files", "docs"]
register("processing_guard", lambda t: st.processing_guard(t.questions, rq.scope_of(t), t.docs, rq.asked_of(t)), "SELECT * FROM guard", SCOPED,
         rq.SCOPE + ",\n" + GUARD)


def doc_texts(t: Tables) -> DataFrame:
    """Spreadsheet texts of each document set, for exact answers over the questions' own files."""
    sets = t.questions.select("query_id", "doc_set_id").join(rq.asked_of(t), "query_id").select(F.col("scope_id").alias("query_id"), "doc_set_id").distinct()
    sets = sets.join(rq.scope_of(t), "query_id").select("doc_set_id", "doc_id").distinct()
    usable = t.docs.where((F.col("status") == "Ready") & F.col("document_type").isin(vocab.TABLE_DOCUMENT_TYPES))
    return sets.join(usable.select("doc_id", "document_type", F.col("extracted_text").alias("text")), "doc_id")


def doc_answers(t: Tables) -> DataFrame:
    return cut_lineage(an.exact_answers(t.questions, doc_texts(t)))


ANSWERED = ",\n".join([rq.SCOPE, """sheet_texts AS (SELECT DISTINCT q.doc_set_id, d.doc_id, d.document_type, d.extracted_text AS text FROM questions q
    JOIN scope s ON s.query_id = q.query_id JOIN docs d ON d.doc_id = s.doc_id WHERE d.status = 'Ready' AND d.document_type IN ('Excel', 'Csv')),
  sheet_questions AS (SELECT query_id, doc_set_id, query_text FROM questions)""", tq.FULL, f"answered AS ({tq.ARBITRATED})", GUARD])
STRATEGY = f"""SELECT q.query_id, q.intent, CASE WHEN g.short_circuit THEN 'StillProcessing' WHEN a.query_id IS NOT NULL THEN 'StructuredDataEngine'
    WHEN coalesce(z.small, false) THEN 'SmallDocumentDirectContext' WHEN q.intent IN ({in_list(vocab.FULL_DOCUMENT_INTENTS)})
    THEN 'FullDocumentRetrieval' ELSE 'SemanticRetrieval' END AS strategy, coalesce(z.documents, 0) AS documents, CAST(coalesce(z.total, 0) AS BIGINT) AS total_chars
  FROM asked q JOIN guard g ON g.query_id = q.query_id LEFT JOIN answered a ON a.query_id = q.query_id
  LEFT JOIN (SELECT s.query_id, count(*) AS documents, sum(length(extracted_text)) AS total, bool_and(length(extracted_text) BETWEEN 1 AND 50000) AS small
    FROM scope s JOIN docs d ON d.doc_id = s.doc_id WHERE status = 'Ready' AND extracted_text IS NOT NULL GROUP BY s.query_id) z ON z.query_id = q.query_id"""
register("choose_strategy",
         lambda t: st.choose_strategy(an.classify(t.questions), rq.scope_of(t), t.docs, doc_answers(t), asked=rq.asked_of(t)), STRATEGY, SCOPED, ANSWERED)

# ── contexts ──────────────────────────────────────────────────────────────────


def known_of(t: Tables) -> DataFrame:
    """The scopes of questions that have an id."""
    return rq.asked_of(t).where(F.col("query_id").isNotNull())


def sizes_of(t: Tables) -> DataFrame:
    """Sizes of the chunks of each scope, with the scope in query_id; so are the steps below up to ``to_questions``."""
    return r.full_document_sizes(rq.scope_of(t), t.docs, t.chunks, t.files)


def sent_of(t: Tables) -> DataFrame:
    return cx.ordered_chunks(sizes_of(t), DEFAULTS.full_document_chars)


def batches_of(t: Tables) -> DataFrame:
    sizes = cut_lineage(sizes_of(t))
    return cx.batch_context(cx.batch_split(sizes), sizes, t.chunks)


ALLC = f"""allc AS (SELECT s.query_id, c.chunk_id, c.doc_id, c.chunk_index, c.content, n.title, n.file_name FROM scope s JOIN docs d ON d.doc_id = s.doc_id
    AND d.status = 'Ready' JOIN chunks c ON c.doc_id = s.doc_id JOIN {rq.NAMED} n ON n.doc_id = c.doc_id)"""
ORDERED = f"""oc1 AS (SELECT *, {TRIM('content')} AS body, CASE WHEN title IS DISTINCT FROM lag(title) OVER w THEN '--- Dokument: ' || title || ' (Fil: ' ||
      file_name || ') ---' || chr(10) ELSE '' END AS header FROM allc WINDOW w AS (PARTITION BY query_id ORDER BY doc_id, chunk_index)),
  oc2 AS (SELECT *, 48000 - coalesce(sum(length(header) + length(body) + 2) OVER (PARTITION BY query_id ORDER BY doc_id, chunk_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM oc1),
  oc3 AS (SELECT *, bool_and(room > 0 AND length(header) <= room) OVER (PARTITION BY query_id ORDER BY doc_id, chunk_index) AS ok FROM oc2),
  sent AS (SELECT * FROM oc3 WHERE ok),
  octx AS (SELECT query_id, {TRIM("string_agg(header || left(body, CAST(room - length(header) AS BIGINT)) || chr(10) || chr(10), '' ORDER BY doc_id, chunk_index)")} AS context,
    count(*) AS chunks_sent FROM sent GROUP BY query_id)"""
CHUNKED = SCOPED + ["chunks"]
FULLCTX = ",\n".join([rq.SCOPE, ALLC, ORDERED])
register("ordered_context", lambda t: to_questions(cx.ordered_context(sent_of(t), t.chunks), known_of(t), many=False), "SELECT * FROM octx", CHUNKED, FULLCTX)

RETR = f"""ret AS (SELECT h.query_id, h.score, c.chunk_id, c.chunk_index, c.page_number, c.heading, c.content, n.title, n.file_name FROM chosen h
    JOIN chunks c ON c.chunk_id = h.chunk_id JOIN {rq.NAMED} n ON n.doc_id = c.doc_id)"""


def ranked_sql(t: float, source: str = "ret") -> str:
    return f"""rc1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn, max(score) OVER (PARTITION BY query_id) AS best,
      '--- Dokument: ' || title || ' ---' || chr(10) || 'Fil: ' || file_name || chr(10) || coalesce('Sida: ' || page_number || chr(10), '') ||
      CASE WHEN {BLANK('heading')} THEN '' ELSE chr(10) || 'Rubrik: ' || heading END || 'Chunk: ' || chunk_index || '  Relevans: ' ||
      printf('%.4f', score) || chr(10) || chr(10) AS head, left(content, 2400) AS cut FROM {source}),
    rc2 AS (SELECT *, 16000 - coalesce(sum(length(head) + length({TRIM('cut')}) + 23) OVER (PARTITION BY query_id ORDER BY rn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM rc1 WHERE score >= {t} OR (best < {t} AND rn = 1)),
    rctx AS (SELECT query_id, {TRIM(f"string_agg(head || {TRIM('left(cut, CAST(room AS BIGINT))')} || chr(10) || chr(10) || '--- Slut utdrag ---' || chr(10) || chr(10), '' ORDER BY rn)")}
      AS context FROM rc2 WHERE room > 0 GROUP BY query_id)"""


register("ranked_context", lambda t: cx.ranked_context(rq.retrieved(t), rq.LOW), "SELECT * FROM rctx", rq.ALL,
         ",\n".join([rq.final(0.1), RETR, ranked_sql(0.1)]))
INSTR = f"""instr AS (SELECT query_id, has_table, document_wide, CASE """ + " ".join(
    f"WHEN has_table = {str(a).lower()} AND document_wide = {str(b).lower()} THEN {quote(v)}" for (a, b), v in vocab.SEMANTIC_INSTRUCTION.items()) + \
    f""" END AS instruction FROM (SELECT q.query_id, {rq.WIDE} AS document_wide, z.has_table FROM questions q JOIN (SELECT query_id,
    bool_or(contains(content, '| ') AND contains(content, ' |')) AS has_table FROM ret GROUP BY query_id) z ON z.query_id = q.query_id) y)"""
register("context_instruction", lambda t: cx.context_instruction(t.questions, rq.retrieved(t)), "SELECT * FROM instr", rq.ALL,
         ",\n".join([rq.final(0.1), RETR, INSTR]))


register("collection_context", lambda t: cx.collection_context(t.questions, rq.collected(t), rq.LOW),
         f"""SELECT q.query_id, query_text || CASE WHEN context IS NULL THEN {quote(vocab.NO_COLLECTION_CONTEXT)} ELSE
               {quote(vocab.COLLECTION_INSTRUCTION + chr(10))} || context END AS prompt FROM questions q LEFT JOIN rctx c ON c.query_id = q.query_id""",
         rq.CALL, ",\n".join([rq.CFINAL, RETR.replace("FROM chosen", "FROM cout"), ranked_sql(0.1)]))

DTEXT = """dtext AS (SELECT s.query_id, d.doc_id, d.title, d.document_type, d.extracted_text AS text FROM scope s JOIN docs d ON d.doc_id = s.doc_id
    WHERE d.status = 'Ready' AND d.extracted_text IS NOT NULL)"""


def pieces_sql(budget: int, head: str, tail: str, name: str = "body") -> str:
    return f"""dp AS (SELECT *, {budget} - coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS room FROM dtext), {name} AS (SELECT query_id, string_agg({head} || {TRIM('left(text, CAST(room AS BIGINT))')} || {quote(tail)}, '' ORDER BY doc_id) AS body
      FROM dp WHERE room > 0 GROUP BY query_id)"""


NOTE = (f"'--- Dokument: ' || title || ' ---' || chr(10) || CASE WHEN document_type IN ('Excel', 'Csv') THEN {quote(vocab.TABLE_NOTE + chr(10))} "
        "ELSE '' END || chr(10)")
register("direct_context", lambda t: cx.direct_context(t.questions, st.ready_sizes(rq.scope_of(t), t.docs), texts=st.document_texts(t.docs), asked=rq.asked_of(t)),
         f"""SELECT q.query_id, query_text || CASE WHEN tab THEN {quote(vocab.DIRECT_INSTRUCTION[True])} ELSE {quote(vocab.DIRECT_INSTRUCTION[False])} END
               || chr(10) || {TRIM('body')} AS prompt FROM questions q JOIN body b ON b.query_id = q.query_id JOIN (SELECT query_id,
               bool_or(document_type IN ('Excel', 'Csv')) AS tab FROM dtext GROUP BY query_id) z ON z.query_id = q.query_id""",
         SCOPED, ",\n".join([rq.SCOPE, DTEXT, pieces_sql(16000, NOTE, "\n\n--- Slut ---\n\n")]))
CODES = r"\b[A-Z]{2,8}(?:/[A-Z]{2,8})?-[A-Z0-9][A-Z0-9-]*\b"
HINTS = f"""codes AS (SELECT query_id, min(code) AS code, upper(code) AS up FROM (SELECT query_id, unnest(regexp_extract_all(text, {quote(CODES)})) AS code
    FROM dtext) z GROUP BY query_id, upper(code)), hints AS (SELECT query_id, count(*) AS n, array_to_string(list('- ' || code || chr(10) ORDER BY up)[1:50], '')
    AS listed FROM codes GROUP BY query_id)"""
_HEAD = vocab.ENUMERATION_HINT_HEAD.split("{n}")
register("enumeration_context",
         lambda t: cx.enumeration_context(an.classify(t.questions), st.ready_sizes(rq.scope_of(t), t.docs), texts=st.document_texts(t.docs),
                                          asked=rq.asked_of(t)),
         f"""SELECT q.query_id, query_text || {quote(vocab.ENUMERATION_RULES)} || CASE WHEN {INTENT} = 'TableEnumeration' THEN
               {quote(vocab.ENUMERATION_TABLE_NOTE)} ELSE '' END || CASE WHEN n > 0 THEN {quote(_HEAD[0])} || n || {quote(_HEAD[1])} || listed ||
               {quote(vocab.ENUMERATION_HINT_TAIL)} ELSE '' END || {quote(vocab.ENUMERATION_CONTENT)} || {TRIM('body')} AS prompt
             FROM questions q JOIN body b ON b.query_id = q.query_id LEFT JOIN hints h ON h.query_id = q.query_id""",
         SCOPED, ",\n".join([rq.SCOPE, DTEXT, pieces_sql(48000, NOTE, "\n\n--- Slut ---\n\n"), HINTS]))
register("structured_context",
         lambda t: cx.structured_context(t.questions, doc_answers(t).drop("doc_set_id"), st.ready_sizes(rq.scope_of(t), t.docs.where(
             F.col("document_type").isin(vocab.TABLE_DOCUMENT_TYPES))), texts=st.document_texts(t.docs), asked=rq.asked_of(t)),
         f"""SELECT q.query_id, query_text || {quote(vocab.ANSWER_HEAD)} || 'Result: ' || value || chr(10) || CASE WHEN {BLANK('column_used')} THEN '' ELSE
               'Source column: ' || column_used || chr(10) END || {quote(vocab.ANSWER_TAIL)} || {quote(vocab.ANSWER_CONTEXT_HEAD)} || coalesce(body, '') AS prompt
             FROM questions q JOIN answered a ON a.query_id = q.query_id LEFT JOIN body b ON b.query_id = q.query_id""",
         SCOPED, ",\n".join([ANSWERED, DTEXT + " ", pieces_sql(16000, "'--- ' || title || ' ---' || chr(10)", "\n--- End ---\n")]).replace(
             "d.extracted_text IS NOT NULL) ,", "d.extracted_text IS NOT NULL AND d.document_type IN ('Excel', 'Csv')),"))

# ── several passes ────────────────────────────────────────────────────────────
WALK = """seq AS (SELECT query_id, chunk_id, length(content) AS n, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, chunk_index) AS rn FROM allc),
  walk AS (SELECT query_id, chunk_id, rn, 1 AS batch_no, n AS used FROM seq WHERE rn = 1 UNION ALL
    SELECT s.query_id, s.chunk_id, s.rn, CASE WHEN w.batch_no < 5 AND w.used + s.n > 48000 THEN w.batch_no + 1 ELSE w.batch_no END,
      CASE WHEN w.batch_no < 5 AND w.used + s.n > 48000 THEN s.n ELSE w.used + s.n END
    FROM walk w JOIN seq s ON s.query_id = w.query_id AND s.rn = w.rn + 1),
  bctx AS (SELECT query_id, batch_no, %s AS context, count(*) AS chunks FROM (SELECT w.query_id, w.batch_no, w.rn, CASE WHEN a.title IS DISTINCT FROM
      lag(a.title) OVER (PARTITION BY w.query_id, w.batch_no ORDER BY w.rn) THEN '--- ' || a.title || ' ---' || chr(10) ELSE '' END || %s || chr(10) || chr(10) AS piece
      FROM walk w JOIN allc a ON a.query_id = w.query_id AND a.chunk_id = w.chunk_id) z GROUP BY query_id, batch_no)""" % (
    TRIM("string_agg(piece, '' ORDER BY rn)"), TRIM("a.content"))
PASSES = ",\n".join([rq.SCOPE, ALLC, WALK])
register("batch_split", lambda t: to_questions(cut_lineage(cx.batch_split(sizes_of(t))), known_of(t)),
         "SELECT query_id, chunk_id, CAST(batch_no AS INTEGER) AS batch_no FROM walk", CHUNKED, PASSES)
_BPIECES = WALK.replace("bctx AS (SELECT query_id, batch_no, " + TRIM("string_agg(piece, '' ORDER BY rn)") + " AS context, count(*) AS chunks FROM (", "bpieces AS (SELECT * FROM (").replace(
    " z GROUP BY query_id, batch_no)", " z)")


def parts_sql(source: str, keys: str, order: str, chars: int) -> str:
    """Parts of ordered pieces: a piece belongs where it begins."""
    return f"""SELECT {keys}, part_no, string_agg(piece, '' ORDER BY {order}) AS text FROM (SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY used // {chars}) - 1 AS part_no
      FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {source}) y) z
      GROUP BY {keys}, part_no"""


def batch_parts_of(t: Tables) -> DataFrame:
    sizes = cut_lineage(sizes_of(t))
    return cx.batch_context_parts(cx.batch_split(sizes), sizes, t.chunks, 8000)


register("batch_context_parts", lambda t: to_questions(cut_lineage(batch_parts_of(t)), known_of(t)),
         f"SELECT query_id, CAST(batch_no AS INTEGER) AS batch_no, part_no, text FROM ({parts_sql('bpieces', 'query_id, batch_no', 'rn', 8000)}) p",
         CHUNKED, ",\n".join([rq.SCOPE, ALLC, _BPIECES]))
register("pending_parts", lambda t: to_questions(cut_lineage(st.pending_parts(rq.scope_of(t), t.docs, 60)), known_of(t)),
         parts_sql("""(SELECT s.query_id, d.doc_id, '- ' || title || ': ' || coalesce(processing_stage, status) || coalesce(' ' || progress_current || '/' || progress_total, '')
           || chr(10) AS piece FROM scope s JOIN docs d ON d.doc_id = s.doc_id WHERE status NOT IN ('Ready', 'Blocked', 'Failed')) l""", "query_id", "doc_id", 60),
         SCOPED, rq.SCOPE)
register("batch_context", lambda t: to_questions(batches_of(t), known_of(t), many=False),
         "SELECT query_id, CAST(batch_no AS INTEGER) AS batch_no, context, chunks FROM bctx", CHUNKED, PASSES)


def _fill(template: str, **slots: str) -> str:
    out = quote(template)
    for k, v in slots.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


register("extraction_requests",
         lambda t: cx.extraction_requests(an.classify(t.questions), cut_lineage(batches_of(t)), asked=rq.asked_of(t)),
         f"""SELECT q.query_id, 'extract' AS kind, CAST(b.batch_no AS INTEGER) AS batch_no, {_fill(vocab.EXTRACT_PROMPT, query='query_text', no='b.batch_no', total='total',
               context='b.context', task=f"CASE WHEN intent = 'TableEnumeration' THEN {quote(vocab.EXTRACT_TASK_TABLE)} ELSE {quote(vocab.EXTRACT_TASK_ITEMS)} END")} AS prompt,
               CAST(total + CASE WHEN total > 1 THEN 1 ELSE 0 END AS INTEGER) AS pass_count FROM q JOIN bctx b ON b.query_id = q.query_id
             UNION ALL SELECT query_id, 'merge', CAST(total + 1 AS INTEGER), {_fill(vocab.MERGE_PROMPT, query='query_text', lists="array_to_string(list_transform(range(1, total + 1), lambda i: 'Avsnitt ' || i || ':' || chr(10) || '{' || i || '}'), chr(10) || chr(10) || '--- Nästa avsnitt ---' || chr(10) || chr(10))")},
               CAST(total + 1 AS INTEGER) FROM q WHERE total > 1""", CHUNKED, PASSES + f""",
  q AS (SELECT x.*, {INTENT} AS intent, total FROM questions x JOIN (SELECT query_id, max(batch_no) AS total FROM bctx GROUP BY query_id) z
    ON z.query_id = x.query_id)""")

# ── coverage ──────────────────────────────────────────────────────────────────


def SOURCE_ROWS(e: str) -> str:
    return (f"CAST(len(list_filter(string_split({e}, chr(10)), lambda x: starts_with({TRIM('x')}, '|') AND ends_with({TRIM('x')}, '|') "
            f"AND replace(replace(replace(replace({TRIM('x')}, '|', ''), '-', ''), ':', ''), ' ', '') <> '')) AS INTEGER)")


def ITEMS(e: str) -> str:
    return (f"CAST(CASE WHEN {BLANK(e)} THEN 0 ELSE len(list_filter(string_split({e}, chr(10)), lambda x: regexp_matches({TRIM('x')} || '¤', '^[-*•] ') OR "
            f"(starts_with({TRIM('x')}, '|') AND ends_with({TRIM('x')}, '|')) OR regexp_matches({TRIM('x')}, '^\\s*[0-9]+[.)]\\s+\\S'))) END AS INTEGER)")


register("count_source_rows",
         lambda t: t.workbooks.select("doc_id", text.count_source_rows("text").alias("rows"))
         .unionByName(t.chunks.select(F.col("chunk_id").alias("doc_id"), text.count_source_rows("content").alias("rows"))),
         f"SELECT doc_id, {SOURCE_ROWS('text')} AS rows FROM workbooks UNION ALL SELECT chunk_id, {SOURCE_ROWS('content')} FROM chunks",
         ["workbooks", "chunks"])
ANSWERS = "SELECT conv_id * 100 + turn AS answer_id, conv_id, turn, '- ' || replace(text, '. ', chr(10) || '1) ') AS answer FROM conversations WHERE role = 'assistant'"


def answer_turns(t: Tables) -> DataFrame:
    """Assistant turns written as lists."""
    return t.conversations.where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "conv_id", "turn",
        F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(". "), F.lit("\n1) "))).alias("answer"))


register("count_response_items", lambda t: answer_turns(t).select("answer_id", text.count_response_items("answer").alias("items")),
         f"SELECT answer_id, {ITEMS('answer')} AS items FROM ({ANSWERS}) z")
PCT = "CASE WHEN {w} > 0 THEN round_even(least(100.0, CAST({p} AS DOUBLE) / {w} * 100.0), 1) ELSE 100.0 END"
register("item_coverage",
         lambda t: cv.item_coverage(t.lineitem.groupBy("l_orderkey").agg((F.sum("l_linenumber") - F.lit(1)).alias("source_items"), F.count_if(
             F.col("l_quantity") > 5).alias("returned_items"))),
         f"""SELECT l_orderkey, CAST(s AS BIGINT) AS source_items, r AS returned_items, CASE WHEN s > 0 THEN {PCT.format(p='r', w='s')} ELSE 0.0 END AS coverage_percent,
               CASE WHEN s <= 0 THEN 'N/A' WHEN {PCT.format(p='r', w='s')} >= 100 THEN 'PASS' WHEN {PCT.format(p='r', w='s')} >= 95 THEN 'WARNING' ELSE 'FAILED' END AS status,
               s <= 0 OR {PCT.format(p='r', w='s')} >= 95 AS passed
             FROM (SELECT l_orderkey, sum(l_linenumber) - 1 AS s, count(*) FILTER (l_quantity > 5) AS r FROM lineitem GROUP BY l_orderkey) z""")
COVER = f"""tot AS (SELECT query_id, count(*) AS total_chunks, CAST(sum(length(content)) AS BIGINT) AS total_chars, count(DISTINCT doc_id) AS documents FROM allc GROUP BY query_id),
  srows AS (SELECT query_id, CAST(sum({SOURCE_ROWS('content')}) AS BIGINT) AS source_rows FROM sent GROUP BY query_id),
  cover AS (SELECT t.query_id, documents, total_chunks, coalesce(chunks_sent, 0) AS chunks_sent, total_chars, least(coalesce(length(context), 0), total_chars) AS chars_sent,
    coalesce(length(context), 0) AS context_chars, coalesce(source_rows, 0) AS source_rows FROM tot t LEFT JOIN octx o ON o.query_id = t.query_id
    LEFT JOIN srows s ON s.query_id = t.query_id)"""


def coverage_of(t: Tables) -> DataFrame:
    sizes = cut_lineage(sizes_of(t))
    sent = cut_lineage(cx.ordered_chunks(sizes, DEFAULTS.full_document_chars))
    return cv.context_coverage(sizes, sent, cx.ordered_context(sent, t.chunks), rq.asked_of(t))


register("context_coverage", coverage_of,
         f"""SELECT *, {PCT.format(p='chunks_sent', w='total_chunks')} AS chunk_percent, {PCT.format(p='chars_sent', w='total_chars')} AS char_percent,
               chunks_sent < total_chunks AS is_truncated FROM cover""", CHUNKED, FULLCTX + ",\n" + COVER)
register("document_coverage",
         lambda t: cv.document_coverage(coverage_of(t).select("query_id", "total_chunks", "chunks_sent", "total_chars", "chars_sent")),
         f"""SELECT query_id, total_chunks, chunks_sent, total_chars, chars_sent, {PCT.format(p='chunks_sent', w='total_chunks')} AS coverage_percent,
               {PCT.format(p='chunks_sent', w='total_chunks')} AS chunk_coverage_percent, chunks_sent < total_chunks AS is_truncated FROM cover""",
         CHUNKED, FULLCTX + ",\n" + COVER)
register("model_code_candidates", lambda t: cv.model_code_candidates(t.documents, ["doc_id"]),
         f"""SELECT doc_id, code, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY up) AS INTEGER) AS rank FROM (SELECT doc_id, min(code) AS code, upper(code) AS up
             FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quote(CODES)})) AS code FROM documents) z GROUP BY doc_id, upper(code)) y""")
register("verification_gap",
         lambda t: cv.verification_gap(coverage_of(t).select("query_id", "source_rows"), answer_turns(t).select(
             (F.col("answer_id") - 1).alias("query_id"), text.count_response_items("answer").alias("answer_items"))),
         f"""SELECT c.query_id, source_rows, answer_items FROM cover c JOIN (SELECT answer_id - 1 AS query_id, {ITEMS('answer')} AS answer_items FROM ({ANSWERS}) z) a
             ON a.query_id = c.query_id WHERE source_rows > 0 AND answer_items < source_rows""", CHUNKED, FULLCTX + ",\n" + COVER)


# ── session metrics ───────────────────────────────────────────────────────────


def metrics_of(t: Tables) -> DataFrame:
    scope, asked = cut_lineage(rq.scope_of(t)), cut_lineage(rq.asked_of(t))
    queries, answers = cut_lineage(an.classify(t.questions)), doc_answers(t).drop("doc_set_id")
    ready = st.ready_scope_texts(scope, t.docs)
    tables = scope.join(ready.where(F.col("document_type").isin(vocab.TABLE_DOCUMENT_TYPES)).select("doc_id"), "doc_id", "left_semi")
    # ids and scores are kept; texts come in for the contexts alone
    found = r.hits_to_chunks(cut_lineage(rq.retrieved(t, content=False)), t.chunks, t.docs, t.files)
    in_ready = r.ready_scope(scope, t.docs)
    return sm.session_metrics(
        t.questions, st.choose_strategy(queries, scope, t.docs, answers, asked=asked), answers, tables, coverage_of(t), found,
        cx.ranked_context(found, rq.LOW), to_questions(sm.code_counts(scope, ready.select("doc_id", "text")), asked, many=False),
        to_questions(sm.code_counts(in_ready, t.chunks.select("doc_id", F.col("content").alias("text"))), asked, many=False), asked)


def _counts(name: str, source: str) -> str:
    return (f"{name} AS (SELECT query_id, count(DISTINCT upper(code)) AS codes FROM (SELECT query_id, unnest(regexp_extract_all(text, {quote(CODES)})) AS code "
            f"FROM {source}) z GROUP BY query_id)")


METRICS = ",\n".join([ANSWERED, rq.final(0.1)[len(rq.SCOPE) + 2:], RETR, ranked_sql(0.1), ALLC, ORDERED, COVER, DTEXT, _counts("tcodes", "dtext"),
                      _counts("ccodes", "(SELECT query_id, content AS text FROM allc)"), f"strategies AS ({STRATEGY})",
                      "used AS (SELECT query_id, count(*) AS n FROM dtext WHERE document_type IN ('Excel', 'Csv') GROUP BY query_id)",
                      "rstat AS (SELECT h.query_id, count(*) AS n, count(DISTINCT c.doc_id) AS docs, max(score) AS hi, avg(score) AS av, min(score) AS lo FROM chosen h "
                      "JOIN chunks c ON c.chunk_id = h.chunk_id GROUP BY h.query_id)"])
IS = {k: f"s.strategy = '{v}'" for k, v in (("a", "StructuredDataEngine"), ("b", "SmallDocumentDirectContext"), ("c", "FullDocumentRetrieval"), ("d", "SemanticRetrieval"))}
LISTING = f"s.intent IN ({in_list(vocab.ENUMERATION_INTENTS)})"
CODED = f"CASE WHEN {IS['b']} AND {LISTING} THEN coalesce(tc.codes, 0) WHEN {IS['c']} AND {LISTING} THEN coalesce(cc.codes, 0) ELSE 0 END"
register("session_metrics", lambda t: metrics_of(t).withColumns({c: F.round(c, 6) for c in ("top_score", "average_score", "lowest_score")}),
         f"""SELECT s.query_id, s.intent, s.strategy,
   CAST(CASE WHEN {IS['a']} THEN coalesce(u.n, 0) WHEN {IS['b']} THEN s.documents WHEN {IS['c']} THEN coalesce(v.documents, 0) WHEN {IS['d']} THEN coalesce(h.docs, 0) ELSE 0 END AS BIGINT) AS documents,
   CAST(CASE WHEN {IS['c']} THEN coalesce(v.chunks_sent, 0) WHEN {IS['d']} THEN coalesce(h.n, 0) ELSE 0 END AS BIGINT) AS retrieved_chunks,
   CAST(CASE WHEN {IS['c']} THEN coalesce(v.total_chunks, 0) ELSE 0 END AS BIGINT) AS total_chunks, CAST(CASE WHEN {IS['c']} THEN coalesce(v.source_rows, 0) ELSE 0 END AS BIGINT) AS source_items,
   CASE WHEN {IS['b']} THEN 100.0 WHEN {IS['c']} THEN CASE WHEN v.query_id IS NULL THEN 0.0 ELSE {PCT.format(p='v.chunks_sent', w='v.total_chunks')} END ELSE 0.0 END AS coverage_percent,
   CAST(CASE WHEN {IS['c']} THEN coalesce(v.total_chars, 0) ELSE 0 END AS BIGINT) AS total_chars, CAST(CASE WHEN {IS['c']} THEN coalesce(v.chars_sent, 0) ELSE 0 END AS BIGINT) AS chars_sent,
   CASE WHEN {IS['c']} THEN CASE WHEN v.query_id IS NULL THEN 0.0 ELSE {PCT.format(p='v.chars_sent', w='v.total_chars')} END ELSE 0.0 END AS char_percent,
   {IS['c']} AND coalesce(v.chunks_sent < v.total_chunks, false) AS is_truncated,
   CAST(CASE WHEN {IS['b']} THEN s.total_chars WHEN {IS['c']} THEN coalesce(v.context_chars, 0) WHEN {IS['d']} THEN coalesce(length(x.context), 0) ELSE 0 END AS BIGINT) AS context_chars,
   CAST(length(q.query_text) AS INTEGER) AS query_chars, CAST({CODED} AS BIGINT) AS candidate_models, {CODED} > 0 AS prompt_augmented, {IS['a']} AS structured,
   CASE WHEN {IS['a']} THEN a.method END AS answer_method, CASE WHEN {IS['a']} THEN a.value END AS answer_value, CASE WHEN {IS['a']} THEN a.rows_processed END AS answer_rows,
   CASE WHEN {IS['a']} THEN a.confidence END AS answer_confidence, CASE WHEN {IS['a']} THEN a.column_used END AS answer_column,
   CASE WHEN {IS['a']} THEN a.extractor_name END AS answer_extractor, CASE WHEN {IS['a']} THEN a.candidate_count END AS answer_candidates,
   CASE WHEN {IS['d']} THEN round(h.hi, 6) END AS top_score, CASE WHEN {IS['d']} THEN round(h.av, 6) END AS average_score, CASE WHEN {IS['d']} THEN round(h.lo, 6) END AS lowest_score,
   {IS['d']} AND h.n IS NULL AS empty_retrieval
 FROM strategies s JOIN questions q ON q.query_id = s.query_id LEFT JOIN answered a ON a.query_id = s.query_id LEFT JOIN used u ON u.query_id = s.query_id
   LEFT JOIN cover v ON v.query_id = s.query_id LEFT JOIN rstat h ON h.query_id = s.query_id LEFT JOIN rctx x ON x.query_id = s.query_id
   LEFT JOIN tcodes tc ON tc.query_id = s.query_id LEFT JOIN ccodes cc ON cc.query_id = s.query_id""", rq.ALL, METRICS)


# ── the whole answer path ─────────────────────────────────────────────────────


def prompts_of(t: Tables) -> DataFrame:
    return pr.answer_prompts(an.classify(t.questions), rq.scope_files_of(t), t.files, t.docs, t.chunks, t.vectors, rq.points_of(t), t.query_vectors,
                             doc_answers(t).drop("doc_set_id"), rq.LOW, cut_lineage(rq.asked_of(t)))


def _apart(sql: str, n: str) -> str:
    """Another set of names for the cut documents of a path."""
    return sql.replace("dp AS", f"dp{n} AS").replace("FROM dp ", f"FROM dp{n} ").replace("FROM dtext", f"FROM dtext{n}")


_DOCS = [DTEXT, DTEXT.replace("dtext AS", "dtext3 AS").replace("d.extracted_text IS NOT NULL)", "d.extracted_text IS NOT NULL AND d.document_type IN ('Excel', 'Csv'))")]
_CCODES = HINTS.replace("codes AS", "ccodes AS").replace("FROM codes", "FROM ccodes").replace("hints AS", "chints AS").replace("FROM dtext", "FROM (SELECT query_id, content AS text FROM allc) d")
_LIST = f"""{quote(vocab.ENUMERATION_RULES)} || CASE WHEN a.intent = 'TableEnumeration' THEN {quote(vocab.ENUMERATION_TABLE_NOTE)} ELSE '' END || CASE WHEN %s.n > 0 THEN
      {quote(_HEAD[0])} || %s.n || {quote(_HEAD[1])} || %s.listed || {quote(vocab.ENUMERATION_HINT_TAIL)} ELSE '' END || {quote(vocab.ENUMERATION_CONTENT)}"""
_ENUM = f"a.intent IN ({in_list(vocab.ENUMERATION_INTENTS)})"
_PATH = ",\n".join([ANSWERED, f"strat AS ({STRATEGY})", rq.final(0.1).replace(rq.SCOPE + ",\n", ""), RETR, ranked_sql(0.1), INSTR, ALLC, ORDERED, *_DOCS,
                    pieces_sql(16000, NOTE, "\n\n--- Slut ---\n\n", "dbody"), _apart(pieces_sql(48000, NOTE, "\n\n--- Slut ---\n\n", "ebody"), "2").replace("FROM dtext2", "FROM dtext"),
                    _apart(pieces_sql(16000, "'--- ' || title || ' ---' || chr(10)", "\n--- End ---\n", "sbody"), "3"), HINTS, _CCODES])
register("answer_prompts", prompts_of,
         f"""SELECT a.query_id, CASE WHEN f.query_id IS NULL THEN 'NoFiles' ELSE a.strategy END AS strategy, CASE WHEN f.query_id IS NULL OR a.strategy = 'StillProcessing' THEN g.prompt
               WHEN a.strategy = 'StructuredDataEngine' THEN g.prompt || {quote(vocab.ANSWER_HEAD)} || 'Result: ' || x.value || chr(10) || CASE WHEN {BLANK('x.column_used')} THEN '' ELSE
                 'Source column: ' || x.column_used || chr(10) END || {quote(vocab.ANSWER_TAIL)} || {quote(vocab.ANSWER_CONTEXT_HEAD)} || coalesce(s.body, '')
               WHEN a.strategy = 'SmallDocumentDirectContext' AND {_ENUM} THEN g.prompt || {_LIST % ('h', 'h', 'h')} || {TRIM('e.body')}
               WHEN a.strategy = 'SmallDocumentDirectContext' THEN g.prompt || CASE WHEN tab THEN {quote(vocab.DIRECT_INSTRUCTION[True])} ELSE {quote(vocab.DIRECT_INSTRUCTION[False])} END
                 || chr(10) || {TRIM('d.body')}
               WHEN a.strategy = 'FullDocumentRetrieval' THEN CASE WHEN c.query_id IS NULL THEN g.prompt || {quote(vocab.NO_FILE_CHUNKS)} ELSE g.prompt || CASE WHEN {_ENUM} THEN
                 {_LIST % ('k', 'k', 'k')} ELSE {quote(vocab.FULL_DOCUMENT_INSTRUCTION)} END || chr(10) || coalesce(o.context, '') END
               ELSE g.prompt || CASE WHEN r.context IS NULL THEN {quote(vocab.NO_FILE_CONTEXT)} ELSE i.instruction || chr(10) || r.context END END AS prompt
             FROM strat a JOIN guard g ON g.query_id = a.query_id LEFT JOIN answered x ON x.query_id = a.query_id LEFT JOIN sbody s ON s.query_id = a.query_id
             LEFT JOIN dbody d ON d.query_id = a.query_id LEFT JOIN ebody e ON e.query_id = a.query_id LEFT JOIN hints h ON h.query_id = a.query_id
             LEFT JOIN chints k ON k.query_id = a.query_id LEFT JOIN octx o ON o.query_id = a.query_id LEFT JOIN rctx r ON r.query_id = a.query_id
             LEFT JOIN instr i ON i.query_id = a.query_id LEFT JOIN (SELECT DISTINCT query_id FROM allc) c ON c.query_id = a.query_id
             LEFT JOIN (SELECT DISTINCT query_id FROM query_files) f ON f.query_id = a.query_id
             LEFT JOIN (SELECT query_id, bool_or(document_type IN ('Excel', 'Csv')) AS tab FROM dtext GROUP BY query_id) t ON t.query_id = a.query_id""",
         sorted(set(rq.ALL + CHUNKED)), _PATH)
