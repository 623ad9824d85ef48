"""Segments, chunks and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.inputs import Tables, register
from catalog.sqltext import BLANK, CLEANUP, HEADING, NORMALIZE, TRIM, quote
from foliant import vocab
from foliant.operators import chunking as ch, layout as ly, segments as sg

register("page_segments", lambda t: sg.page_segments(t.paged_docs),
         f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS segment_no, page_number, content FROM (
               SELECT doc_id, i, CASE WHEN n = 0 THEN NULL ELSE TRY_CAST(nums[i - 1] AS INTEGER) END AS page_number,
                      CASE WHEN n = 0 THEN parts[i] ELSE {TRIM('parts[i]')} END AS content, n FROM (
                 SELECT *, len(nums) AS n, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id,
                   regexp_split_to_array(text, '(?m)^--- Page [0-9]+ ---') AS parts,
                   regexp_extract_all(text, '(?m)^--- Page ([0-9]+) ---', 1) AS nums FROM paged_docs) a) b) c
             WHERE n = 0 OR content <> ''""", ["paged_docs"])
SHEETS = r"""parts AS (SELECT doc_id, i - 2 AS segment_no, trim(names[i - 1]) AS sheet_name, parts[i] AS content FROM (
    SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '(?m)^---\s*Sheet:\s*.+?\s*---') AS parts,
      regexp_extract_all(text, '(?m)^---\s*Sheet:\s*(.+?)\s*---', 1) AS names FROM workbooks) a) b)"""
register("sheet_segments", lambda t: sg.sheet_segments(t.workbooks),
         "SELECT doc_id, CAST(segment_no AS INTEGER) AS segment_no, sheet_name, content FROM parts", ["workbooks"], SHEETS)
register("table_header_block", lambda t: sg.table_header_block(t.workbooks),
         f"""SELECT doc_id, arg_min(l || chr(10) || nxt, i) AS header FROM (SELECT *, lead(l) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (
               SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, [x for x in [{TRIM('y')} for y in string_split(text, chr(10))]
               if x <> ''] AS ls FROM workbooks) a) b) c WHERE i <= 8 AND starts_with(l, '|') AND regexp_matches(nxt, '^\\|[|\\- ]*$') GROUP BY doc_id""",
         ["workbooks"])


def texts(t: Tables) -> DataFrame:
    """Page-marked texts, plain documents and workbooks under distinct ids."""
    return (t.paged_docs.select(F.concat(F.lit("p"), "doc_id").alias("doc_id"), "text")
            .unionByName(t.documents.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
            .unionByName(t.workbooks.select(F.concat(F.lit("w"), "doc_id").alias("doc_id"), "text")))


def _last(n: str) -> str:
    return f"CASE WHEN contains(c, {n}) THEN length(c) - strpos(reverse(c), reverse({n})) - length({n}) + 1 ELSE -1 END"


_END = f"""SELECT *, CASE WHEN cut > 150 THEN s + cut ELSE full_end END AS e FROM (SELECT *, CASE WHEN full_end >= size THEN -1 WHEN p > 1500 THEN p WHEN greatest(d, x, q) > 1500
      THEN greatest(d, x, q) + 1 WHEN l > 1500 THEN l WHEN w > 1500 THEN w ELSE -1 END AS cut FROM (SELECT *, {", ".join(f"{_last(n)} AS {a}" for n, a in (
          ("chr(10) || chr(10)", "p"), ("'. '", "d"), ("'! '", "x"), ("'? '", "q"), ("chr(10)", "l"), ("' '", "w")))}
    FROM (SELECT *, substr(work, s + 1, full_end - s) AS c FROM (SELECT *, length(work) AS size, least(s + 3000, length(work)) AS full_end FROM (%s) t0) t1) t2) t3) t4"""
ALLTEXT = """alltext AS (SELECT 'p' || doc_id AS doc_id, text FROM paged_docs UNION ALL SELECT 'd' || doc_id, text FROM documents
    UNION ALL SELECT 'w' || doc_id, text FROM workbooks)"""
#: Windows slide over each segment and the tail of the one before: one step of the recursion per piece.
WINDOWS = f"""segs0 AS (SELECT doc_id, i, paged, CASE WHEN paged THEN TRY_CAST(nums[i - 1] AS INTEGER) END AS page_number, CASE WHEN paged THEN {TRIM('parts[i]')} ELSE parts[i] END AS content
    FROM (SELECT *, len(nums) > 0 AS paged, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '(?m)^--- Page [0-9]+ ---') AS parts,
      regexp_extract_all(text, '(?m)^--- Page ([0-9]+) ---', 1) AS nums FROM alltext WHERE NOT contains(text, '--- Sheet:') AND NOT {BLANK('text')}) a) b),
  segs AS (SELECT doc_id, page_number, content, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM (SELECT doc_id, i, page_number,
      {TRIM(f"CASE WHEN paged THEN {CLEANUP('n')} ELSE n END")} AS content FROM (SELECT *, {NORMALIZE('content')} AS n FROM segs0 WHERE NOT paged OR content <> '') x) y WHERE content <> ''),
  win AS (SELECT doc_id, seg, 1 AS k, work, s, e, size FROM ({_END % "SELECT doc_id, seg, content AS work, 0 AS s FROM segs WHERE seg = 1"}) w1
    UNION ALL SELECT doc_id, seg, k, work, s, e, size FROM ({_END % ("SELECT w.doc_id, CASE WHEN w.e >= w.size THEN w.seg + 1 ELSE w.seg END AS seg, w.k + 1 AS k, CASE WHEN w.e >= w.size THEN "
        + TRIM("right(w.work, 300)") + " || chr(10) || chr(10) || g.content ELSE w.work END AS work, CASE WHEN w.e >= w.size THEN 0 WHEN w.e - w.s > 300 THEN w.e - 300 ELSE w.e END AS s "
        "FROM win w LEFT JOIN segs g ON g.doc_id = w.doc_id AND g.seg = w.seg + 1 WHERE w.e < w.size OR g.seg IS NOT NULL")}) w2),
  heads9 AS (SELECT doc_id, seg, arg_min(l || chr(10) || nxt, i) AS header FROM (SELECT *, lead(l) OVER (PARTITION BY doc_id, seg ORDER BY i) AS nxt FROM (
      SELECT doc_id, seg, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, seg, [x for x in [{TRIM('y')} for y in string_split(content, chr(10))] if x <> ''] AS ls FROM segs) a) b) c
      WHERE i <= 8 AND starts_with(l, '|') AND regexp_matches(nxt, '^\\|[|\\- ]*$') GROUP BY doc_id, seg),
  cutp AS (SELECT doc_id, seg, k, {TRIM('substr(work, s + 1, e - s)')} AS piece FROM win),
  held AS (SELECT p.*, h.header, min(k) FILTER (length(piece) >= 80) OVER (PARTITION BY p.doc_id, p.seg) AS first_k FROM cutp p LEFT JOIN heads9 h ON h.doc_id = p.doc_id AND h.seg = p.seg),
  textc AS (SELECT doc_id, seg, k, CASE WHEN k > first_k AND header IS NOT NULL AND starts_with(piece, '|') AND NOT starts_with(piece, header) THEN header || chr(10) || piece ELSE piece END AS content
      FROM held),
  tchunks AS (SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.seg, k) - 1 AS INTEGER) AS chunk_index, g.page_number, {HEADING('c.content')} AS heading, c.content,
      CAST(length(c.content) AS INTEGER) AS character_count, CAST(greatest(1, ceil(length(c.content) / 4.0)) AS INTEGER) AS token_count
    FROM textc c JOIN segs g ON g.doc_id = c.doc_id AND g.seg = c.seg WHERE length(c.content) >= 80)"""
#: Rows are packed greedily under a repeated header: one step of the recursion per chunk.
PACKED = f"""layout0 AS (SELECT doc_id, segment_no, sheet_name, [x for x in [rtrim(y, {quote(''.join(vocab.WHITESPACE))}) for y in string_split(content, chr(10))] if starts_with(x, '|')] AS rs FROM parts),
  layout1 AS (SELECT *, rs[1] AS header, rs[2:] AS rest, coalesce(list_min([i for i in range(1, len(rs)) if regexp_matches(rs[i + 1], '^[|\\- :]+$')]), 0) AS rule_at FROM layout0 WHERE len(rs) > 0),
  layout2 AS (SELECT doc_id, segment_no, sheet_name, '--- Sheet: ' || sheet_name || ' ---' || chr(10) || header || chr(10) || CASE WHEN rule_at > 0 THEN rest[rule_at] ELSE
      '| ' || array_to_string([repeat('-', greatest(3, length({TRIM('x')}))) for x in string_split(header, '|') if x <> ''], ' | ') || ' |' END AS block,
      [rest[i] for i in range(1, len(rest) + 1) if i <> rule_at] AS data FROM layout1),
  layout3 AS (SELECT *, list_transform(range(1, len(data) + 1), lambda i: list_sum(list_transform(data[1:i], lambda y: length(y) + 1))) AS ends FROM layout2),
  packs AS (SELECT doc_id, segment_no, 0 AS a, greatest(len(list_filter(ends, lambda x: x <= 3000 - length(block))), 1) AS b FROM layout3 WHERE len(data) > 0
    UNION ALL SELECT p.doc_id, p.segment_no, p.b, greatest(len(list_filter(l.ends, lambda x: x <= l.ends[p.b] + 3000 - length(l.block))), p.b + 1)
      FROM packs p JOIN layout3 l ON l.doc_id = p.doc_id AND l.segment_no = p.segment_no WHERE p.b < len(l.data)),
  rowc AS (SELECT l.doc_id, l.segment_no, p.a, sheet_name, {TRIM("block || chr(10) || array_to_string(data[p.a + 1:p.b], chr(10))")} AS content FROM layout3 l JOIN packs p
      ON p.doc_id = l.doc_id AND p.segment_no = l.segment_no UNION ALL SELECT doc_id, segment_no, 0, sheet_name, block FROM layout3 WHERE len(data) = 0),
  rchunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment_no, a) - 1 AS INTEGER) AS chunk_index, CAST(NULL AS INTEGER) AS page_number, sheet_name AS heading,
      {TRIM('content')} AS content, CAST(length(content) AS INTEGER) AS character_count, CAST(greatest(1, ceil(length(content) / 4.0)) AS INTEGER) AS token_count
    FROM rowc WHERE length(content) >= 80)"""
register("chunk_text", lambda t: ch.chunk_text(texts(t).where(~F.contains("text", F.lit("--- Sheet:")))),
         "SELECT * FROM tchunks", ["paged_docs", "workbooks"], ",\n".join([ALLTEXT, WINDOWS]))
register("chunk_table_rows", lambda t: ch.chunk_table_rows(t.workbooks.select("doc_id", "text")),
         "SELECT * FROM rchunks", ["workbooks"], ",\n".join([SHEETS, PACKED]))
register("chunk_router", lambda t: ch.chunk_router(texts(t)),
         "SELECT * FROM tchunks UNION ALL SELECT * REPLACE ('w' || doc_id AS doc_id) FROM rchunks", ["paged_docs", "workbooks"], ",\n".join([ALLTEXT, WINDOWS, SHEETS, PACKED]))

# ── layout ────────────────────────────────────────────────────────────────────
LINES = """placed AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY slot) AS line_no FROM (
    SELECT *, ceil((800 - bottom) / 12) AS slot FROM words) z)"""
register("words_to_lines", lambda t: ly.words_to_lines(t.words),
         "SELECT DISTINCT doc_id, page, bottom, CAST(line_no AS INTEGER) AS line_no FROM placed", ["words"], LINES)
FIX = r"regexp_replace(regexp_replace({e}, '\b(FG|FWF)-([0-9]+)\s+([A-Z])\b', '\1-\2\3', 'g'), '\b(FG/FWF)-([0-9]+)\s+([A-Z])\b', '\1-\2\3', 'g')"
RENDER = f"""pieces AS (SELECT doc_id, page, line_no, left_x, bottom, CASE WHEN lag(right_x) OVER w IS NULL THEN '' WHEN left_x - lag(right_x) OVER w > 20 THEN ' | '
      ELSE ' ' END || word AS piece FROM placed WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY left_x, bottom DESC)),
  rendered AS (SELECT doc_id, page, line_no, {FIX.format(e="string_agg(piece, '' ORDER BY left_x, bottom DESC)")} AS line FROM pieces GROUP BY ALL)"""
register("line_render", lambda t: ly.line_render(t.words), "SELECT doc_id, page, CAST(line_no AS INTEGER) AS line_no, line FROM rendered",
         ["words"], LINES + ",\n" + RENDER)
register("page_text", lambda t: ly.page_text(ly.line_render(t.words)),
         f"""SELECT doc_id, {CLEANUP('x')} AS text FROM (SELECT doc_id, {FIX.format(e="string_agg('--- Page ' || page || ' ---' || chr(10) || body || chr(10) || chr(10), '' ORDER BY page)")} AS x
             FROM (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS body FROM rendered GROUP BY ALL) z GROUP BY doc_id) y""",
         ["words"], LINES + ",\n" + RENDER)



def esc(e: str) -> str:
    return TRIM(f"replace(replace(replace({e}, '|', chr(92) || '|'), chr(10), ' '), chr(13), '')")


FILLED = """filled AS (SELECT c.doc_id, c.sheet_no, c.sheet_name, c.row_no, c.col_no, CASE WHEN c.value <> '' THEN c.value ELSE coalesce(m.value, '') END AS value
    FROM sheet_cells c LEFT JOIN merged_ranges r ON r.doc_id = c.doc_id AND r.sheet_no = c.sheet_no AND c.row_no BETWEEN r1 AND r2 AND c.col_no BETWEEN c1 AND c2
    LEFT JOIN sheet_cells m ON m.doc_id = r.doc_id AND m.sheet_no = r.sheet_no AND m.row_no = r1 AND m.col_no = c1)"""
DEPTH = """bounds AS (SELECT doc_id, sheet_no, max(sheet_name) AS sheet_name, min(row_no) AS first_row, max(row_no) AS last_row, min(col_no) AS first_col,
    max(col_no) AS last_col FROM sheet_cells GROUP BY ALL),
  flags AS (SELECT b.*, k, EXISTS (SELECT 1 FROM merged_ranges r WHERE r.doc_id = b.doc_id AND r.sheet_no = b.sheet_no AND r.r1 = b.first_row + k
      AND c2 > c1 AND c1 >= first_col AND c2 <= last_col) AND first_row + k <= last_row - 1 AS hit FROM bounds b, (SELECT unnest(range(0, 5)) AS k) x),
  depths AS (SELECT doc_id, sheet_no, sheet_name, first_row, last_row, first_col, last_col, CAST(1 + least(4, coalesce(min(k) FILTER (NOT hit), 4)) AS INTEGER) AS depth
    FROM flags GROUP BY ALL)"""
HEADS = f"""hparts AS (SELECT f.*, first_col, depth, {TRIM('f.value')} AS v FROM filled f JOIN depths d ON d.doc_id = f.doc_id AND d.sheet_no = f.sheet_no
      WHERE f.row_no < first_row + depth),
  hname AS (SELECT doc_id, sheet_no, col_no, first_col, depth, coalesce(trim(string_agg(v, '_' ORDER BY row_no) FILTER (v <> '' AND keep), '_'), '') AS name, arg_min(value, row_no) AS lone
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet_no, col_no, lower(v) ORDER BY row_no) = 1 AS keep FROM hparts) z
    GROUP BY doc_id, sheet_no, col_no, first_col, depth),
  heads AS (SELECT doc_id, sheet_no, col_no, {esc("CASE WHEN depth = 1 THEN lone WHEN name = '' THEN 'Col' || (col_no - first_col + 1) WHEN n > 1 THEN name || '_' || i ELSE name END")} AS header
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, sheet_no, lower(name)) AS n, row_number() OVER (PARTITION BY doc_id, sheet_no, lower(name) ORDER BY col_no) AS i
          FROM hname) z)"""
ROWS = f"""rlines AS (SELECT f.doc_id, f.sheet_no, row_no, '| ' || string_agg({esc('value')}, ' | ' ORDER BY col_no) || ' |' AS line FROM filled f JOIN depths d
    ON d.doc_id = f.doc_id AND d.sheet_no = f.sheet_no WHERE row_no >= first_row + depth GROUP BY ALL)"""
SHEET_IN = ["sheet_cells", "merged_ranges"]
register("merged_cell_fill", lambda t: ly.merged_cell_fill(t.sheet_cells, t.merged_ranges), "SELECT * FROM filled", SHEET_IN, FILLED)
register("header_depth", lambda t: ly.header_depth(t.sheet_cells, t.merged_ranges).select("doc_id", "sheet_no", "depth"),
         "SELECT doc_id, sheet_no, depth FROM depths", SHEET_IN, DEPTH)
register("qualified_headers",
         lambda t: ly.qualified_headers(ly.merged_cell_fill(t.sheet_cells, t.merged_ranges), ly.header_depth(t.sheet_cells, t.merged_ranges)),
         "SELECT * FROM heads", SHEET_IN, ",\n".join([FILLED, DEPTH, HEADS]))
register("sheet_render", lambda t: ly.sheet_render(t.sheet_cells, t.merged_ranges),
         """SELECT d.doc_id, d.sheet_no, '--- Sheet: ' || sheet_name || ' ---' || chr(10) || '| ' || hs || ' |' || chr(10) || '| ' || ds || ' |' || chr(10) ||
              coalesce(rs || chr(10), '') || chr(10) AS text FROM depths d JOIN (SELECT doc_id, sheet_no, string_agg(header, ' | ' ORDER BY col_no) AS hs,
              string_agg(repeat('-', greatest(3, length(header))), ' | ' ORDER BY col_no) AS ds FROM heads GROUP BY ALL) h ON h.doc_id = d.doc_id AND h.sheet_no = d.sheet_no
            LEFT JOIN (SELECT doc_id, sheet_no, string_agg(line, chr(10) ORDER BY row_no) AS rs FROM rlines GROUP BY ALL) r ON r.doc_id = d.doc_id AND r.sheet_no = d.sheet_no""",
         SHEET_IN, ",\n".join([FILLED, DEPTH, HEADS, ROWS]))
register("sheet_extract_stats", lambda t: ly.sheet_extract_stats(t.sheet_cells, t.merged_ranges),
         """SELECT d.doc_id, d.sheet_no, depth AS header_rows, coalesce(n, 0) AS data_rows, last_col - first_col + 1 AS columns, CAST(coalesce(c, 0) AS BIGINT) AS circuit_codes,
              first_line, last_line FROM depths d LEFT JOIN (SELECT doc_id, sheet_no, count(*) AS n, sum(len(regexp_extract_all(line, '(?i)FNT[0-9]+'))) AS c,
              arg_min(line, row_no) AS first_line, arg_max(line, row_no) AS last_line FROM rlines GROUP BY ALL) r ON r.doc_id = d.doc_id AND r.sheet_no = d.sheet_no""",
         SHEET_IN, ",\n".join([FILLED, DEPTH, ROWS]))
