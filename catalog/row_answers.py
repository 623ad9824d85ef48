"""Answers about some rows of a table, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import tables as ct
from catalog.inputs import Tables, register
from catalog.sqltext import BLANK, TRIM, quote
from foliant import vocab
from foliant.operators import row_answers as ra, tables as tb
from foliant.session import cut_lineage

_TABLES = ",\n".join([ct.LOADED, ct.SHEETS, ct.HEADERS, ct.CONCEPTS])
Q = "lower(query_text)"


def _resolved(name: str, source: str) -> str:
    """The column rules of the catalog's tables over another list of questions."""
    return (ct.RESOLVE.replace("column_hits", f"{name}_hits").replace("resolved AS", f"{name} AS").replace("sheet_questions", source))


def _bound(pattern: str) -> str:
    number, unit = f"regexp_extract({Q}, {quote(pattern)}, 1)", f"regexp_extract({Q}, {quote(pattern)}, 2)"
    return f"CASE WHEN {number} <> '' THEN CASE WHEN {unit} <> '' THEN {ct.MBPS(f'({number} || {unit})')} ELSE {ct.PLAIN(f'({number})')} END END"


_UNIT = " || ".join(f"regexp_extract({Q}, {quote(p)}, 2)" for p in (vocab.ABOVE_NUMBER, vocab.BELOW_NUMBER))
CONDITIONS = f"""conds AS (SELECT * FROM (SELECT *, {_bound(vocab.ABOVE_NUMBER)} AS low, {_bound(vocab.BELOW_NUMBER)} AS high,
      nullif(regexp_extract({Q}, {quote(vocab.EQUALS_VALUE)}, 1), '') AS equals, {_UNIT} <> '' AS unit FROM filter_questions) z
    WHERE low IS NOT NULL OR high IS NOT NULL OR equals IS NOT NULL),
  {_resolved('fresolved', 'conds')},
  fnamed AS (SELECT c.*, r.col_name FROM conds c JOIN fresolved r ON r.query_id = c.query_id),
  fplaces AS (SELECT n.*, h.sheet_no, h.col_no FROM fnamed n JOIN (SELECT doc_set_id, lower(col_name) AS target, sheet_no, min(col_no) AS col_no FROM headers
      GROUP BY ALL) h ON h.doc_set_id = n.doc_set_id AND h.target = lower(n.col_name)),
  fcells AS (SELECT p.*, r.sheet_name, r.doc_id, r.ln, r.columns, r.cells, r.cells[p.col_no + 1] AS v FROM fplaces p JOIN rowz r
      ON r.doc_set_id = p.doc_set_id AND r.sheet_no = p.sheet_no WHERE NOT r.is_header),
  fread AS (SELECT *, CASE WHEN unit THEN {ct.MBPS('v')} ELSE {ct.PLAIN('v')} END AS x FROM fcells WHERE NOT {BLANK('v')}),
  fmet AS (SELECT * FROM fread WHERE (low IS NULL OR x > low) AND (high IS NULL OR x < high) AND (equals IS NULL OR lower({TRIM('v')}) = equals))"""
FNEEDS = ["sheet_texts", "filter_questions"]
FEXTRA = ",\n".join([_TABLES, CONDITIONS])


def _read(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(tb.load_tables(t.sheet_texts))
    return rows, cut_lineage(tb.headers_of(tb.sheets_of(rows)))


register("filter_answers", lambda t: ra.filter_answers(t.filter_questions, *_read(t)),
         """SELECT n.query_id, n.doc_set_id, n.col_name AS column_used, coalesce(m.matching, 0) AS matching, coalesce(m.distinct_values, 0) AS distinct_values,
              coalesce(m.first_values, '') AS first_values FROM fnamed n LEFT JOIN (
                SELECT query_id, CAST(sum(n) AS BIGINT) AS matching, count(*) AS distinct_values,
                  array_to_string(list(v ORDER BY pos)[1:10], ',') AS first_values
                FROM (SELECT query_id, lower(v) AS low, count(*) AS n, min((sheet_no, doc_id, ln)) AS pos, arg_min(v, (sheet_no, doc_id, ln)) AS v FROM fmet GROUP BY ALL) z
                GROUP BY query_id) m ON m.query_id = n.query_id""", FNEEDS, FEXTRA)
register("filtered_rows",
         lambda t: ra.filtered_rows(t.filter_questions, *_read(t), shown=F.array_join("cells", "¦")).select("query_id", "doc_set_id", "sheet_no", "sheet_name",
                                                                                                            "doc_id", "row"),
         "SELECT query_id, doc_set_id, sheet_no, sheet_name, doc_id, array_to_string(cells, '¦') AS row FROM fmet", FNEEDS, FEXTRA)

_PART = "regexp_extract(lower(query_text), " + quote(vocab.GROUP_PARTS) + ", {i})"
GROUPS = f"""gparts AS (SELECT query_id, doc_set_id, {_PART.format(i=1)} AS m, {_PART.format(i=2)} AS g FROM group_questions),
  gq AS (SELECT query_id, doc_set_id, g AS query_text FROM gparts WHERE g <> ''), mq AS (SELECT query_id, doc_set_id, m AS query_text FROM gparts WHERE g <> ''),
  {_resolved('gresolved', 'gq')}, {_resolved('mresolved', 'mq')},
  greq AS (SELECT * FROM (SELECT p.query_id, p.doc_set_id, g.col_name AS group_column, CASE WHEN i IN ('Sum', 'Average', 'Maximum', 'Minimum') THEN i ELSE 'Count' END AS measure,
        CASE WHEN i IN ('Sum', 'Average', 'Maximum', 'Minimum') THEN m.col_name END AS measure_column
      FROM (SELECT *, {ct.intent_sql('m')} AS i FROM gparts) p JOIN gresolved g ON g.query_id = p.query_id LEFT JOIN mresolved m ON m.query_id = p.query_id) z
    WHERE measure = 'Count' OR measure_column IS NOT NULL),
  gplace AS (SELECT doc_set_id, lower(col_name) AS target, sheet_no, min(col_no) AS col_no FROM headers GROUP BY ALL),
  gcells AS (SELECT q.*, {TRIM('r.cells[a.col_no + 1]')} AS grp, r.cells[b.col_no + 1] AS v FROM greq q JOIN gplace a ON a.doc_set_id = q.doc_set_id AND a.target = lower(q.group_column)
      LEFT JOIN gplace b ON b.doc_set_id = q.doc_set_id AND b.sheet_no = a.sheet_no AND b.target = lower(q.measure_column)
      JOIN rowz r ON r.doc_set_id = q.doc_set_id AND r.sheet_no = a.sheet_no AND NOT r.is_header WHERE measure = 'Count' OR b.col_no IS NOT NULL),
  gread AS (SELECT *, {ct.PLAIN('v')} AS x FROM gcells)"""
register("group_answers",
         lambda t: ra.group_answers(t.group_questions, *_read(t)),
         """SELECT query_id, doc_set_id, group_column, measure, measure_column, min(grp) AS group_value, count(*) AS n, CASE measure WHEN 'Count' THEN CAST(count(*) AS DOUBLE)
              WHEN 'Sum' THEN CAST(sum(CAST(x AS DECIMAL(30, 6))) AS DOUBLE) WHEN 'Average' THEN CAST(sum(CAST(x AS DECIMAL(30, 6))) AS DOUBLE) / count(x)
              WHEN 'Maximum' THEN max(x) ELSE min(x) END AS value
            FROM gread GROUP BY query_id, doc_set_id, group_column, measure, measure_column, lower(grp)""",
         ["sheet_texts", "group_questions"], ",\n".join([_TABLES, GROUPS]))
