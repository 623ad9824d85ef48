"""Input tables derived from the generated Parquet tables.

The reference system works on documents, files, chunks, vectors, questions and
workbooks.  Each table below is written once, in SQL that Spark and DuckDB both
accept, and covers the whole of the tables it reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

# one phrase per intent and column concept, spread over the user turns
PHRASES = [
    "Hur många rader finns i tabellen?", "How many unique vlan ids are used?",
    "Högsta hastighet på länken?", "Genomsnittlig bandbredd per länk?", "Vad är total bandwidth?",
    "Sammanfatta dokumentet", "Lista alla modeller", "Jämför A vs B", "How many circuits are listed?",
    "Antal unika ip adress i listan", "How many distinct interface names?", "lowest vlan",
    "Visa rader där status", "Count per site", "Export table", "Give an overview of key points",
    "Max bandwidth of any link", "hur många vlan", "smallest balance", "count all port entries",
    "sum of balance", "average speed", "unique circuits", "Hur många portar har FG-60F?",
    "number of rows with ip address", "highest vlan id",
]
_PHRASE_CASE = "CASE (conv_id * 3 + turn) % {n} {whens} END".format(
    n=len(PHRASES), whens=" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)))

_EXT = [".pdf", ".docx", ".txt", ".md", ".xlsx", ".csv", ".py", ".JSON", ".png", ".mp3", ".bin", ".XLS", "",
        ".yaml", ".Webp"]
_MIME = ["application/pdf", "text/plain", "image/png", "audio/mpeg", "application/csv", "Application/JSON",
         "application/octet-stream", "application/vnd.ms-excel", "TEXT/HTML"]


def _case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {whens} END"


# name -> (tables it reads, SQL with {table} slots); «text‖separator‖key» is ordered string aggregation,
# which the two engines spell differently; a second SQL text, where given, is for DuckDB
DERIVED: dict[str, tuple] = {
    # one file per generated document; some point at a shared stored copy
    "files": (["documents"], f"""
        SELECT doc_id AS file_id,
               CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 7000000 + doc_id END AS stored_file_id,
               'report_' || CAST(doc_id AS STRING) || {_case("doc_id", _EXT)} AS original_file_name,
               {_case("doc_id", _EXT)} AS extension,
               CASE WHEN doc_id % 11 = 5 THEN NULL ELSE {_case("doc_id", _MIME)} END AS content_type
        FROM {{documents}}"""),
    # ten generated documents form one parent document
    "docs": (["documents"], """
        SELECT p AS doc_id,
               CASE WHEN p % 3 = 1 THEN NULL ELSE p * 10 END AS file_id,
               CASE WHEN p % 3 = 1 THEN 7000000 + p * 10 END AS stored_file_id,
               'Dokument ' || CAST(p AS STRING) AS title,
               CASE p % 6 WHEN 0 THEN 'Pdf' WHEN 1 THEN 'Excel' WHEN 2 THEN 'Txt' WHEN 3 THEN 'Csv'
                          WHEN 4 THEN 'Docx' ELSE 'Markdown' END AS document_type,
               CASE WHEN p % 13 = 7 THEN 'Embedding' WHEN p % 13 = 8 THEN 'Failed'
                    WHEN p % 13 = 9 THEN 'Blocked' WHEN p % 13 = 10 THEN 'Queued' ELSE 'Ready' END AS status,
               CASE WHEN p % 13 = 7 THEN 'Embedding' END AS processing_stage,
               CASE WHEN p % 13 = 7 THEN CAST(p % 10 AS INT) END AS progress_current,
               CASE WHEN p % 13 = 7 THEN 10 END AS progress_total,
               extracted_text
        FROM (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS p,
                     «text‖chr(10) || chr(10)‖doc_id» AS extracted_text
              FROM {documents} GROUP BY CAST(floor(doc_id / 10) AS BIGINT)) g"""),
    # every generated document is one chunk of its parent
    "chunks": (["documents"], """
        SELECT doc_id AS chunk_id, CAST(floor(doc_id / 10) AS BIGINT) AS doc_id,
               CAST(doc_id % 10 AS INT) AS chunk_index,
               CASE WHEN doc_id % 10 < 8 THEN CAST(floor((doc_id % 10) / 4) AS INT) + 1 END AS page_number,
               CASE WHEN doc_id % 5 = 0 THEN 'Avsnitt ' || CAST(doc_id % 10 AS STRING)
                    WHEN doc_id % 5 = 1 THEN ' ' END AS heading,
               text || chr(10) || '| FNT' || lpad(CAST(doc_id % 40 AS STRING), 6, '0') || ' | 10.0.'
                    || CAST(doc_id % 7 AS STRING) || '.' || CAST(doc_id % 250 AS STRING) || ' |' AS content
        FROM {documents}"""),
    "vectors": (["embeddings"], """
        SELECT vec_id AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'acme' END AS provider,
               CASE WHEN vec_id % 11 = 0 THEN 'embed-large' ELSE 'embed-small' END AS model,
               embedding AS vector
        FROM {embeddings}"""),
    "memberships": (["documents"], """
        SELECT source AS collection_id, CAST(floor(doc_id / 10) AS BIGINT) AS doc_id
        FROM {documents} WHERE source IS NOT NULL
        GROUP BY source, CAST(floor(doc_id / 10) AS BIGINT)"""),
    # every user turn is a question over one of twenty document sets
    "questions": (["conversations"], f"""
        SELECT conv_id * 100 + turn AS query_id, conv_id % 20 AS doc_set_id,
               {_PHRASE_CASE} ||
               CASE WHEN turn % 3 = 0 THEN ' FNT' || lpad(CAST((conv_id * 7) % 40 AS STRING), 6, '0') || ' '
                    WHEN turn % 3 = 1 THEN ' 10.0.' || CAST(conv_id % 7 AS STRING) || '.' ||
                         CAST((conv_id * 7 + turn) % 250 AS STRING) || ' fnt000001 ' ELSE ' ' END || text AS query_text,
               conv_id * 31 + turn * 7 AS vec_id
        FROM {{conversations}} WHERE role = 'user'"""),
    "query_vectors": (["questions", "embeddings"], """
        SELECT q.query_id, 'acme' AS provider, 'embed-small' AS model, e.embedding AS query_vector
        FROM (SELECT query_id, vec_id % (SELECT count(*) FROM {embeddings}) AS place FROM {questions}) q
        JOIN {embeddings} e ON e.vec_id = q.place"""),
    "doc_set_files": (["documents"], """
        SELECT p % 20 AS doc_set_id, file_id
        FROM (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS p, min(doc_id) AS file_id
              FROM {documents} GROUP BY CAST(floor(doc_id / 10) AS BIGINT)) g"""),
    "query_files": (["questions", "doc_set_files"], """
        SELECT q.query_id, f.file_id FROM {questions} q JOIN {doc_set_files} f ON f.doc_set_id = q.doc_set_id"""),
    "query_collections": (["questions"], """
        SELECT query_id, 'src' || CAST(doc_set_id AS STRING) AS collection_id FROM {questions}
        UNION SELECT query_id, 'src' || CAST(query_id % 20 AS STRING) AS collection_id FROM {questions}"""),
    # index points: the payload of a vector, one partition per index
    "points": (["vectors", "chunks", "documents"], """
        SELECT v.chunk_id AS point_id, c.doc_id AS doc_id, v.provider AS provider, v.model AS model,
               v.vector AS vector, c.chunk_index AS chunk_index, d.source AS source
        FROM {vectors} v JOIN {chunks} c ON c.chunk_id = v.chunk_id JOIN {documents} d ON d.doc_id = v.chunk_id"""),
    # ── workbooks: rendered from customers and suppliers, one per nation and block of keys ──
    "link_rows": (["customer"], """
        SELECT c_nationkey AS set_no, CAST(floor(c_custkey / 600) AS BIGINT) AS block, c_custkey AS row_key,
               replace(c_name, '#', ' no|') AS name,
               CASE WHEN c_custkey % 17 = 0 THEN '' ELSE CAST(c_custkey % 4094 + 1 AS STRING) END AS vlan,
               CASE c_custkey % 6 WHEN 0 THEN '100M' WHEN 1 THEN '1G' WHEN 2 THEN '10G' WHEN 3 THEN '500'
                    WHEN 4 THEN '10Gbps' ELSE '64k' END AS bandwidth,
               'FNT' || lpad(CAST(c_custkey % 900 AS STRING), 6, '0') AS circuit,
               CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) || ',' ||
               lpad(CAST(c_custkey % 100 AS STRING), 2, '0') AS balance,
               c_mktsegment AS status
        FROM {customer}"""),
    "core_rows": (["supplier"], """
        SELECT s_nationkey AS set_no, CAST(floor(s_suppkey / 400) AS BIGINT) AS block, s_suppkey AS row_key,
               s_name AS device, 'Gi0/' || CAST(s_suppkey % 48 AS STRING) AS port,
               '10.' || CAST(s_suppkey % 5 AS STRING) || '.1.' || CAST(s_suppkey % 250 AS STRING) AS address,
               CAST(s_suppkey % 90 + 5 AS STRING) AS vlan
        FROM {supplier}"""),
    "link_text": (["link_rows"], """
        SELECT set_no, block, '--- Sheet: Links ' || CAST(block AS STRING) || ' ---' || chr(10) ||
               '| Namn | Nätbrygga_Vlan | Bandwidth | Circuit-ID | Balance | Status |' || chr(10) ||
               '| --- | --- | :---: | --- | --- | --- |' || chr(10) ||
               «'| ' || replace(name, '|', chr(92) || '|') || ' | ' || vlan || ' | ' || bandwidth || ' | ' ||
                       circuit || ' | ' || balance || ' | ' || status || ' |'‖chr(10)‖row_key» || chr(10) AS text
        FROM {link_rows} GROUP BY set_no, block"""),
    "core_text": (["core_rows"], """
        SELECT set_no, block, '--- Sheet: Core ' || CAST(block AS STRING) || ' ---' || chr(10) ||
               '| Device | Port | IP Address | VLAN |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
               «'| ' || device || ' | ' || port || ' | ' || address || ' | ' || vlan || ' |'‖chr(10)‖row_key» || chr(10) AS text
        FROM {core_rows} GROUP BY set_no, block"""),
    # parts become command-line style listings without usable headers; every second text has no marker
    "part_text": (["part"], """
        SELECT 25 + CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS set_no,
               CAST(floor(p_partkey / 700) AS BIGINT) AS block,
               CASE WHEN CAST(floor(p_partkey / 700) AS BIGINT) % 2 = 0
                    THEN '--- Sheet: Blad ' || CAST(CAST(floor(p_partkey / 700) AS BIGINT) AS STRING) || ' ---' || chr(10)
                    ELSE '' END ||
               «'| ' || CAST(p_partkey % 5000 AS STRING) || ' ' || p_name || ' | ' || p_type || ' xe-' ||
                       CAST(p_size AS STRING) || ' 10.9.' || CAST(p_size AS STRING) || '.7/24 | Te1/' ||
                       CAST(p_size AS STRING) || ' |'‖chr(10)‖p_partkey» || chr(10) AS text
        FROM {part} GROUP BY p_brand, CAST(floor(p_partkey / 700) AS BIGINT)"""),
    # delimited exports: orders by priority and block
    "csv_docs": (["orders"], """
        SELECT 100 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS doc_set_id,
               (100 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) * 1000000 +
                   CAST(floor(o_orderkey / 5000) AS BIGINT) AS doc_id,
               'Csv' AS document_type,
               'Order;Status;Amount' || chr(10) ||
               «CAST(o_orderkey AS STRING) || ';"' || o_orderstatus || ' ""x"";' || o_orderpriority || '"; ' ||
                       CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)‖chr(10)‖o_orderkey» || chr(10) AS text
        FROM {orders} GROUP BY o_orderpriority, CAST(floor(o_orderkey / 5000) AS BIGINT)"""),
    "workbooks": (["link_text", "core_text", "part_text"], """
        SELECT set_no AS doc_set_id, set_no * 1000000 + block * 10 AS doc_id, 'Excel' AS document_type, text FROM {link_text}
        UNION ALL SELECT set_no, set_no * 1000000 + block * 10 + 1, 'Excel', text FROM {core_text}
        UNION ALL SELECT set_no, set_no * 1000000 + block * 10 + 2, 'Excel', text FROM {part_text}"""),
    "sheet_texts": (["workbooks", "csv_docs"], """
        SELECT doc_set_id, doc_id, document_type, text FROM {workbooks}
        UNION ALL SELECT doc_set_id, doc_id, document_type, text FROM {csv_docs}"""),
    "sheet_questions": (["questions"], """
        SELECT query_id, CASE WHEN (query_id * 13) % 56 > 50 THEN (query_id * 13) % 56 + 50 ELSE (query_id * 13) % 56 END AS doc_set_id,
               query_text FROM {questions}"""),
    # questions with a condition and for figures per group, over the same document sets
    "filter_questions": (["sheet_questions"], """
        SELECT query_id, doc_set_id, CASE query_id % 7
               WHEN 0 THEN 'Show rows where vlan above ' || CAST(query_id * 37 % 4000 AS STRING)
               WHEN 1 THEN 'Which rows have a balance below ' || CAST(query_id % 9 AS STRING) || ',500?'
               WHEN 2 THEN 'rows with vlan above ' || CAST(query_id % 900 AS STRING) || ' and below ' || CAST(query_id % 900 + 800 AS STRING)
               WHEN 3 THEN 'Show rows where status is ' || CASE query_id % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'machinery?' WHEN 2 THEN 'o' ELSE 'automobile' END
               WHEN 4 THEN 'Visa rader där amount över ' || CAST(query_id % 300 * 1000 AS STRING)
               WHEN 5 THEN 'links with bandwidth above 1G' ELSE 'vlan under ' || CAST(query_id % 500 AS STRING) END AS query_text
        FROM {sheet_questions}"""),
    "group_questions": (["sheet_questions"], """
        SELECT query_id, doc_set_id, CASE query_id % 8 WHEN 0 THEN 'Count per status' WHEN 1 THEN 'sum of balance per status'
               WHEN 2 THEN 'average balance by bandwidth' WHEN 3 THEN 'Högsta vlan per status' WHEN 4 THEN 'breakdown by vlan'
               WHEN 5 THEN 'sum of amount per status' WHEN 6 THEN 'lowest amount per status' ELSE 'antal per bandwidth' END AS query_text
        FROM {sheet_questions}"""),
    # ── operations ──
    "models": (["part"], """
        SELECT p_partkey AS model_id, CASE WHEN p_partkey % 23 = 7 THEN NULL ELSE p_partkey % 110 END AS provider_id,
               p_name || ' ' || CAST(p_partkey AS STRING) AS model_name, p_size % 7 <> 0 AS enabled, p_size AS sort_order,
               CAST(p_retailprice / 1000 AS DECIMAL(18, 6)) AS input_price,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_retailprice / 500 AS DECIMAL(18, 6)) END AS output_price,
               CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_retailprice / 10000 AS DECIMAL(18, 6)) END AS embedding_price,
               CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DECIMAL(18, 6)) END AS image_price
        FROM {part}"""),
    "providers": (["supplier"], """
        SELECT s_suppkey AS provider_id, CASE s_nationkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Gemini' WHEN 2 THEN 'Remote'
               ELSE 'Local' END AS provider_type, s_suppkey % 9 <> 4 AS enabled, s_nationkey AS sort_order FROM {supplier}"""),
    "metrics": (["part"], """
        SELECT p_partkey * 2 AS metric_id, p_partkey AS model_id, CASE p_size % 3 WHEN 0 THEN 'Chat' WHEN 1 THEN 'Vision'
               ELSE 'Embeddings' END AS capability, p_size % 11 <> 3 AS enabled, p_size % 10 AS cost_score,
               p_size % 7 AS speed_score, p_size % 5 AS quality_score FROM {part}
        UNION ALL SELECT p_partkey * 2 + 1, p_partkey + 40, CASE p_size % 2 WHEN 0 THEN 'ImageGeneration' ELSE 'Audio' END,
               p_size % 13 <> 5, p_size % 9, p_size % 4, p_size % 8 FROM {part}"""),
    "profiles": (["customer"], """
        SELECT c_custkey AS profile_id, c_custkey % 5 <> 0 AS enabled, c_custkey % 7 = 3 AS is_default,
               c_nationkey % 5 AS cost_weight, c_nationkey % 3 AS speed_weight, c_nationkey % 4 AS quality_weight FROM {customer}"""),
    "profile_providers": (["customer"], """
        SELECT c_custkey AS profile_id, c_custkey % 37 AS provider_id FROM {customer} WHERE c_mktsegment <> 'BUILDING'
        UNION ALL SELECT c_custkey, c_custkey % 41 FROM {customer} WHERE c_mktsegment <> 'BUILDING'"""),
    "settings": (["nation"], "SELECT n_nationkey AS setting_id, n_nationkey * 5 AS active_profile_id FROM {nation}"),
    "users": (["events"], """
        SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS profile_id FROM {events} GROUP BY user_id"""),
    "profile_requests": (["events"], """
        SELECT event_id AS request_id, user_id, CASE WHEN event_id % 4 = 0 THEN event_id % 200 END AS profile_id FROM {events}"""),
    "model_requests": (["nation"], """
        SELECT n_nationkey AS request_id, CAST(n_nationkey * 2 + 1 AS BIGINT) AS profile_id, CASE n_nationkey % 5 WHEN 0 THEN 'Chat'
               WHEN 1 THEN 'Vision' WHEN 2 THEN 'Embeddings' WHEN 3 THEN 'Audio' ELSE 'ImageGeneration' END AS capability,
               CASE n_nationkey % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Gemini' ELSE 'Local' END AS excluded_provider_type
        FROM {nation}"""),
    "request_log_in": (["events"], """
        SELECT event_id AS request_id, user_id, event_id % 2100 AS model_id, CASE event_type WHEN 'purchase' THEN 'ImageGeneration'
               WHEN 'signup' THEN 'Embeddings' WHEN 'click' THEN 'Vision' ELSE 'Chat' END AS capability,
               CAST(floor(value * 100) AS INT) AS prompt_tokens, CAST(event_id % 4000 AS INT) AS completion_tokens,
               CAST(event_id % 5 AS INT) AS retry_count, ts AS created_at,
               CASE event_id % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Gemini' WHEN 2 THEN 'gemini' ELSE NULL END AS provider_type,
               CAST(CASE event_id % 13 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 408 WHEN 4 THEN 400 WHEN 5 THEN 500
                    WHEN 6 THEN 502 WHEN 7 THEN 503 WHEN 8 THEN 504 WHEN 9 THEN 429 WHEN 10 THEN 418 ELSE 400 END AS INT) AS status_code,
               CASE event_id % 11 WHEN 0 THEN '{{"detail":{{"error":{{"code":"insufficient_quota","message":"x"}}}}}}'
                    WHEN 1 THEN '{{"detail":"Quota is gone"}}' WHEN 2 THEN '{{"error":{{"code":"moderation_blocked","message":"no"}}}}'
                    WHEN 3 THEN '{{"error":{{"message":"Blocked by safety system"}}}}' WHEN 4 THEN 'not json'
                    WHEN 5 THEN '{{"error":{{"code":"invalid_prompt"}}}}' WHEN 6 THEN '{{"detail":{{"reason":"SAFETY"}}}}'
                    WHEN 7 THEN '{{"error":"plain text"}}' WHEN 8 THEN '' WHEN 9 THEN '{{"detail":{{"error":{{"message":"an Invalid Prompt"}}}}}}'
                    ELSE NULL END AS body
        FROM {events}"""),
    "guard_steps": (["region"], "SELECT r_name AS step, r_regionkey AS step_order, r_regionkey <> 3 AS enabled FROM {region}"),
    "guard_verdicts": (["labels", "region"], """
        SELECT a.doc_id, r.r_name AS step, CASE WHEN a.toxic = 1 AND a.k = 2 THEN 'Block' WHEN a.quality = 0 AND a.k = 1 THEN 'Error'
               WHEN a.k = 3 THEN 'Block' ELSE 'Allow' END AS action,
               CASE WHEN a.doc_id % 2 = 0 THEN 'rule ' || CAST(a.k AS STRING) END AS reason
        FROM (SELECT doc_id, quality, toxic, 0 AS k FROM {labels} UNION ALL SELECT doc_id, quality, toxic, 1 FROM {labels}
              UNION ALL SELECT doc_id, quality, toxic, 2 FROM {labels} UNION ALL SELECT doc_id, quality, toxic, 3 FROM {labels}
              UNION ALL SELECT doc_id, quality, toxic, 4 FROM {labels}) a
        JOIN {region} r ON r.r_regionkey = a.k AND (a.doc_id + a.k) % 9 <> 8"""),
    "findings": (["events"], """
        SELECT user_id AS request_id, event_id AS position, event_type || 'Finding' AS type_name,
               CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN '  ' END AS filter_name,
               CASE WHEN event_id % 3 = 0 THEN 'proc' || CAST(event_id % 5 AS STRING) END AS processor,
               CASE WHEN event_id % 7 = 0 THEN 'C' || CAST(event_id % 3 AS STRING) END AS code
        FROM {events}"""),
    # ── ingestion ──
    "job_lines": (["events"], """
        SELECT event_id AS job_no, CASE WHEN event_id % 17 = 3 THEN '{{"DocumentId": ' WHEN event_id % 19 = 4 THEN 'null' ELSE
               '{{"DocumentId": ' || CAST(event_id % 130 AS STRING) || ', "FileId": ' || CAST(event_id % 130 * 10 AS STRING) || ', "UserId": ' ||
               CAST(user_id AS STRING) || ', "FileName": "f' || CAST(event_id % 7 AS STRING) || '.txt", "DocumentType": "Txt", "Attempt": 1, "QueuedAtUtc": "2024-01-' ||
               lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0') || 'T10:00:00Z"}}' END AS value
        FROM {events}"""),
    "doc_state": (["docs"], """
        SELECT doc_id, title, document_type, CASE WHEN doc_id % 13 < 7 THEN 'Queued' ELSE status END AS status, processing_stage,
               CAST(doc_id % 5 AS INT) AS attempts, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'lock' || CAST(doc_id AS STRING) END AS lock_id,
               CAST('2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS lock_expires,
               doc_id % 9 <> 2 AS has_file, CASE WHEN doc_id % 11 = 3 THEN '  ' ELSE extracted_text END AS extracted_text
        FROM {docs}"""),
    # ── page words and sheet cells ──
    "words": (["documents"], """
        SELECT doc_id, CAST(floor(i / 400) AS INT) + 1 AS page, w AS word, CAST(i % 8 * 70 + i % 3 AS DOUBLE) AS left_x,
               CAST(i % 8 * 70 + i % 3 + length(w) * 6 AS DOUBLE) AS right_x,
               CAST(800 - floor((i % 400) / 8) * 12 + (i % 3) * 0.5 AS DOUBLE) AS bottom
        FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (i, w) FROM {documents}) z""", """
        SELECT doc_id, CAST(floor(i / 400) AS INT) + 1 AS page, w AS word, CAST(i % 8 * 70 + i % 3 AS DOUBLE) AS left_x,
               CAST(i % 8 * 70 + i % 3 + length(w) * 6 AS DOUBLE) AS right_x,
               CAST(800 - floor((i % 400) / 8) * 12 + (i % 3) * 0.5 AS DOUBLE) AS bottom
        FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS w FROM (SELECT doc_id, string_split(text, ' ') AS a
              FROM {documents}) y) z"""),
    "sheet_cells": (["supplier"], """
        SELECT d AS doc_id, 1 AS sheet_no, 'Blad ' || CAST(d AS STRING) AS sheet_name, r AS row_no, c AS col_no, v AS value FROM (
          SELECT s_nationkey AS d, 2 AS r, 2 AS c, 'Primary' AS v FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, 2, 3, '' FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, 2, 4, 'Secondary' FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, 2, 5, '' FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, 3, 2, 'VLAN' FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, 3, 3, 'vlan' FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, 3, 4, CASE WHEN s_nationkey % 2 = 0 THEN 'secondary' ELSE ' Na|me ' END FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, 3, 5, '' FROM {supplier} GROUP BY s_nationkey
          UNION ALL SELECT s_nationkey, CAST(4 + s_suppkey AS INT), 2, 'FNT' || CAST(s_suppkey AS STRING) FROM {supplier}
          UNION ALL SELECT s_nationkey, CAST(4 + s_suppkey AS INT), 3, s_name || '|' || chr(10) || 'x' FROM {supplier}
          UNION ALL SELECT s_nationkey, CAST(4 + s_suppkey AS INT), 4, CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE CAST(s_suppkey AS STRING) END FROM {supplier}
          UNION ALL SELECT s_nationkey, CAST(4 + s_suppkey AS INT), 5, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'fnt7 fnt' END FROM {supplier}) z"""),
    "merged_ranges": (["supplier"], """
        SELECT s_nationkey AS doc_id, 1 AS sheet_no, 2 AS r1, 2 AS c1, 2 AS r2, 3 AS c2 FROM {supplier} WHERE s_nationkey % 3 <> 0 GROUP BY s_nationkey
        UNION ALL SELECT s_nationkey, 1, 2, 4, 2, 5 FROM {supplier} WHERE s_nationkey % 3 <> 0 GROUP BY s_nationkey
        UNION ALL SELECT s_nationkey, 1, 3, 4, 3, 5 FROM {supplier} WHERE s_nationkey % 5 = 1 GROUP BY s_nationkey
        UNION ALL SELECT s_nationkey, 1, CAST(4 + s_suppkey AS INT), 3, CAST(4 + s_suppkey AS INT), 4 FROM {supplier} WHERE s_suppkey % 4 = 1"""),
    # page-marked text: generated documents joined under page markers, with layout artifacts
    "paged_docs": (["documents"], """
        SELECT CAST(floor(doc_id / 10) AS BIGINT) AS doc_id,
               CASE WHEN CAST(floor(doc_id / 10) AS BIGINT) % 4 = 0 THEN 'Förord 10Gbps' || chr(10) ELSE '' END ||
               «CASE WHEN CAST(floor(doc_id / 10) AS BIGINT) % 5 = 1 THEN '' ELSE
                            '--- Page ' || CAST(doc_id % 10 + 1 AS STRING) || ' ---' || chr(13) || chr(10) END ||
                       CASE WHEN doc_id % 7 = 3 THEN '   ' ELSE
                            CASE WHEN doc_id % 3 = 0 THEN '1.' || CAST(doc_id % 10 AS STRING) || ' Avsnitt' || chr(10)
                                 WHEN doc_id % 3 = 1 THEN 'KAPITEL' || chr(9) || 'FG-120 G' || chr(10) ELSE '' END ||
                            text || chr(10) || '      10Gbps  link1a2b' || chr(10) || chr(10) || chr(10) || chr(10) END‖chr(10)‖doc_id» AS text
        FROM {documents} GROUP BY CAST(floor(doc_id / 10) AS BIGINT)"""),
}


_AGG = re.compile("«([^‖]+)‖([^‖]+)‖([^»]+)»")


def _for_spark(sql: str) -> str:
    return _AGG.sub(r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)", sql)


def _for_duckdb(sql: str) -> str:
    return _AGG.sub(r"string_agg(\1, \2 ORDER BY \3)", sql).replace("AS STRING", "AS VARCHAR")


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in BASE or n in seen:
            return
        for d in DERIVED[n][0]:
            visit(d)
        seen.append(n)
    for n in names:
        visit(n)
    return seen


def sql_with(names: list[str], body: str, extra: str = "") -> str:
    """DuckDB text: the derived tables a query needs as common table expressions, then the query."""
    ctes = []
    for n in _order(names):
        reads, sql = DERIVED[n][0], DERIVED[n][-1]
        ctes.append(f"{n} AS ({_for_duckdb(sql).format(**{r: r for r in reads})})")
    if extra:
        ctes.append(extra)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Tables:
    """Generated and derived tables of one scale directory, as DataFrames."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory, self._cache = spark, directory, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
            else:
                reads, sql = DERIVED[name][:2]
                self._cache[name] = self.spark.sql(_for_spark(sql), **{r: getattr(self, r) for r in reads})
        return self._cache[name]


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None,
             needs: list[str] | None = None, extra: str = "") -> None:
    if name in SPARK:
        raise ValueError(f"query {name} registered twice")
    SPARK[name] = partial(_run, fn)
    if sql is not None:
        SQL[name] = sql_with(needs or [], sql, extra)


def _run(fn: Callable[[Tables], DataFrame], spark: SparkSession, directory: str) -> DataFrame:
    return fn(Tables(spark, directory))
