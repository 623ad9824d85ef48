"""String scalars, file kinds and text segmentation over document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import Tables, register
from catalog.sqltext import (BLANK, CLEANUP, HEADING, NORMALIZE, TRIM, in_list, map_case)
from foliant import vocab
from foliant.functions import kinds, text

# ── file kinds ────────────────────────────────────────────────────────────────
_PLAIN = in_list(vocab.PLAIN_TEXT_EXTENSIONS)

register("route_document_type",
         lambda t: t.files.select("file_id", kinds.route_document_type("extension", "content_type")
                                  .alias("document_type")),
         f"""SELECT file_id, coalesce(CASE WHEN lower(extension) IN ({_PLAIN}) THEN 'Code' END,
               {map_case('lower(extension)', vocab.DOCUMENT_TYPE_BY_EXTENSION)},
               {map_case('lower(content_type)', vocab.DOCUMENT_TYPE_BY_MIME)}, 'Unknown') AS document_type
             FROM files""", ["files"])

register("route_file_type",
         lambda t: t.files.select("file_id", kinds.route_file_type("extension", "content_type").alias("file_type")),
         f"""SELECT file_id, coalesce(CASE WHEN lower(extension) IN ({_PLAIN}) THEN 'Document' END,
               {map_case('lower(extension)', vocab.FILE_TYPE_BY_EXTENSION)},
               CASE WHEN starts_with(lower(content_type), 'image/') THEN 'Image'
                    WHEN starts_with(lower(content_type), 'audio/') THEN 'Audio'
                    WHEN starts_with(lower(content_type), 'text/') THEN 'Document'
                    WHEN lower(content_type) IN ({in_list(vocab.DOCUMENT_MIME_TYPES)}) THEN 'Document' END,
               'Other') AS file_type FROM files""", ["files"])

register("filter_extractable",
         lambda t: t.files.withColumn("document_type", kinds.route_document_type("extension", "content_type"))
         .where(kinds.is_extractable("document_type", "extension")).select("file_id", "extension", "document_type"),
         f"""SELECT * FROM (SELECT file_id, extension,
               coalesce(CASE WHEN lower(extension) IN ({_PLAIN}) THEN 'Code' END,
                 {map_case('lower(extension)', vocab.DOCUMENT_TYPE_BY_EXTENSION)},
                 {map_case('lower(content_type)', vocab.DOCUMENT_TYPE_BY_MIME)}, 'Unknown') AS document_type
             FROM files) x
             WHERE lower(document_type) IN ({in_list(vocab.EXTRACTABLE_TYPES)})
                OR lower(extension) IN ({in_list(vocab.EXTRACTABLE_EXTENSIONS)}) OR lower(extension) IN ({_PLAIN})""",
         ["files"])

# ── cleaning and shortening ───────────────────────────────────────────────────
register("normalize_text",
         lambda t: t.paged_docs.select("doc_id", text.normalize_text("text", text.has_page_marker("text"))
                                       .alias("clean")),
         f"""SELECT doc_id, {TRIM(f"CASE WHEN regexp_matches(text, '(?m)^--- Page [0-9]+ ---') THEN {CLEANUP('n')} ELSE n END")} AS clean
             FROM (SELECT doc_id, text, {NORMALIZE('text')} AS n FROM paged_docs) x""", ["paged_docs"])

register("cleanup_page_artifacts",
         lambda t: t.paged_docs.select("doc_id", text.cleanup_page_artifacts("text").alias("clean")),
         f"SELECT doc_id, {CLEANUP('text')} AS clean FROM paged_docs", ["paged_docs"])

register("join_model_suffix",
         lambda t: t.paged_docs.select("doc_id", text.join_model_suffix("text").alias("clean")),
         r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\b(FG|FWF)-([0-9]+)\s+([A-Z])\b', '\1-\2\3', 'g'),
               '\b(FG/FWF)-([0-9]+)\s+([A-Z])\b', '\1-\2\3', 'g') AS clean FROM paged_docs""", ["paged_docs"])

register("escape_cell",
         lambda t: t.documents.select("doc_id", text.escape_cell("text").alias("cell")),
         f"""SELECT doc_id, {TRIM("replace(replace(replace(coalesce(text, ''), '|', chr(92) || '|'), chr(10), ' '), chr(13), '')")}
             AS cell FROM documents""")

register("preview",
         lambda t: t.paged_docs.select("doc_id", text.preview("text", 200).alias("preview")),
         f"""SELECT doc_id, CASE WHEN length(p) > 200 THEN left(p, 200) || '…' ELSE p END AS preview
             FROM (SELECT doc_id, {TRIM("replace(replace(text, chr(10), ' '), chr(13), '')")} AS p FROM paged_docs) x""",
         ["paged_docs"])

register("truncate_text",
         lambda t: t.documents.select("doc_id", text.truncate_text("text", 100).alias("cut"),
                                      text.truncate_or_null("text", 1000).alias("cut_or_null")),
         f"""SELECT doc_id, CASE WHEN {BLANK('text')} THEN '' ELSE left(text, 100) END AS cut,
                    CASE WHEN length(text) > 0 THEN left(text, 1000) END AS cut_or_null FROM documents""")

register("conversation_title",
         lambda t: t.conversations.where(F.lower("role") == "user").groupBy("conv_id")
         .agg(F.min_by("text", "turn").alias("text"))
         .select("conv_id", text.conversation_title("text").alias("title")),
         f"""SELECT conv_id, CASE WHEN {BLANK('text')} THEN 'Ny chatt' WHEN length(s) > 42
                    THEN {TRIM('left(s, 42)')} || '...' ELSE s END AS title
             FROM (SELECT conv_id, text, {TRIM("replace(replace(text, chr(13), ' '), chr(10), ' ')")} AS s FROM (
                   SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE lower(role) = 'user'
                   GROUP BY conv_id) a) b""")

register("token_estimate",
         lambda t: t.documents.select("doc_id", text.token_estimate("text").alias("tokens")),
         f"""SELECT doc_id, CASE WHEN {BLANK('text')} THEN 0
                    ELSE CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) END AS tokens FROM documents""")

register("detect_heading",
         lambda t: t.paged_docs.select("doc_id", text.detect_heading("text").alias("heading"))
         .unionByName(t.documents.select("doc_id", text.detect_heading("text").alias("heading")))
         .unionByName(t.documents.select("doc_id", text.detect_heading(
             F.concat(F.upper("source"), F.lit(" ÅÄÖ\n"), F.col("text"))).alias("heading")))
         .unionByName(t.documents.select("doc_id", text.detect_heading(
             F.concat(F.lit("\n2.3. "), F.col("text"))).alias("heading"))),
         f"""SELECT doc_id, {HEADING('text')} AS heading FROM (
               SELECT doc_id, text FROM paged_docs UNION ALL SELECT doc_id, text FROM documents
               UNION ALL SELECT doc_id, upper(source) || ' ÅÄÖ' || chr(10) || text FROM documents
               UNION ALL SELECT doc_id, chr(10) || '2.3. ' || text FROM documents) x""", ["paged_docs"])

register("count_pages",
         lambda t: t.paged_docs.select("doc_id", text.count_pages("text").alias("pages")),
         r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^--- Page [0-9]+ ---')) AS INTEGER) AS pages
             FROM paged_docs""", ["paged_docs"])

register("last_user_text",
         lambda t: t.conversations.where(F.lower("role") == "user").groupBy("conv_id")
         .agg(F.max_by("text", "turn").alias("text"))
         .select("conv_id", text.truncate_or_null("text", 1000).alias("last_user_text")),
         """SELECT conv_id, CASE WHEN length(text) > 0 THEN left(text, 1000) END AS last_user_text FROM (
            SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE lower(role) = 'user' GROUP BY conv_id) x""")

register("separator_from_header",
         lambda t: t.core_text.select("set_no", "block", text.separator_from_header(
             F.element_at(text.lines("text"), 2)).alias("rule"))
         .unionByName(t.documents.select(F.col("doc_id").alias("set_no"), F.lit(-1).cast("bigint").alias("block"),
                                         text.separator_from_header(F.concat(F.lit("|"), text.lines("text")[0],
                                                                             F.lit("|"))).alias("rule"))),
         f"""SELECT set_no, block, '| ' || array_to_string(list_transform(list_filter(string_split(h, '|'), lambda p: p <> ''),
                    lambda p: repeat('-', greatest(3, length({TRIM('p')})))), ' | ') || ' |' AS rule
             FROM (SELECT set_no, block, string_split(text, chr(10))[2] AS h FROM core_text
                   UNION ALL SELECT doc_id, -1, '|' || string_split(text, chr(10))[1] || '|' FROM documents) x""",
         ["core_text"])

register("best_split",
         lambda t: t.documents.where(F.length("text") >= 3000).select(
             "doc_id", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.length("text") / 3000) - 1)).alias("window_no")).select(
             "doc_id", "window_no", text.best_split(F.substr("text", (F.col("window_no") * 3000 + 1).cast("int"), F.lit(3000)), 3000).alias("split_at")),
         """SELECT doc_id, window_no, CASE WHEN p > 1500 THEN p WHEN s > 1500 THEN s + 1 WHEN l > 1500 THEN l WHEN w > 1500 THEN w
                   ELSE -1 END AS split_at
            FROM (SELECT doc_id, window_no, """ + ", ".join(
             f"CAST(CASE WHEN contains(c, {n}) THEN length(c) - strpos(reverse(c), reverse({n})) - length({n}) + 1 ELSE -1 END AS INTEGER) AS {a}0"
             for n, a in (("chr(10) || chr(10)", "p"), ("'. '", "d"), ("'! '", "e"), ("'? '", "q"), ("chr(10)", "l"), ("' '", "w")))
         + """, p0 AS p, greatest(d0, e0, q0) AS s, l0 AS l, w0 AS w
                  FROM (SELECT doc_id, window_no, substr(text, window_no * 3000 + 1, 3000) AS c FROM (
                    SELECT doc_id, text, unnest(generate_series(0, length(text) // 3000 - 1)) AS window_no
                    FROM documents WHERE length(text) >= 3000) w) x) y""")

register("sniff_delimiter",
         lambda t: t.csv_docs.select("doc_id", text.sniff_delimiter(F.substring_index("text", "\n", 1)).alias("delimiter"))
         .unionByName(t.documents.select("doc_id", text.sniff_delimiter(F.substring_index("text", "\n", 1))
                                         .alias("delimiter"))),
         """SELECT doc_id, CASE WHEN a >= b AND a >= c THEN chr(9) WHEN b > c THEN ';' ELSE ',' END AS delimiter
            FROM (SELECT doc_id, length(l) - length(replace(l, chr(9), '')) AS a,
                  length(l) - length(replace(l, ';', '')) AS b, length(l) - length(replace(l, ',', '')) AS c
                  FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM csv_docs
                        UNION ALL SELECT doc_id, string_split(text, chr(10))[1] FROM documents) x) y""", ["csv_docs"])

register("structure_type",
         lambda t: t.docs.select("doc_id", text.structure_type("document_type", "extracted_text").alias("structure"))
         .unionByName(t.workbooks.select("doc_id", text.structure_type(F.lit("Pdf"), "text").alias("structure")))
         .unionByName(t.chunks.select(F.col("chunk_id").alias("doc_id"),
                                      text.structure_type(F.lit("Txt"), "content").alias("structure"))),
         f"""SELECT doc_id, CASE WHEN document_type IN ('Excel', 'Csv') THEN 'Spreadsheet' WHEN {BLANK('text')} THEN 'Unstructured'
                    WHEN share >= 0.6 THEN 'Table' WHEN share >= 0.2 THEN 'Mixed' ELSE 'Unstructured' END AS structure
             FROM (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: starts_with({TRIM('x')}, '|')
                     AND ends_with({TRIM('x')}, '|'))) / CAST(len(string_split(text, chr(10))) AS DOUBLE) AS share
             FROM (SELECT doc_id, document_type, extracted_text AS text FROM docs UNION ALL
                   SELECT doc_id, 'Pdf', text FROM workbooks UNION ALL SELECT chunk_id, 'Txt', content FROM chunks) x) y""",
         ["docs", "workbooks", "chunks"])
