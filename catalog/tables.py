"""Tables inside texts and exact answers over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.inputs import Tables, register
from catalog.sqltext import BLANK, TRIM, any_of, in_list, map_case, quote
from foliant import vocab
from foliant.functions import columns as names, numbers, text
from foliant.operators import answers as an, tables as tb
from foliant.session import cut_lineage

# ── SQL: parsing ──────────────────────────────────────────────────────────────


def CELLS(line: str) -> str:
    inner = f"replace(substring({line}, 2, length({line}) - 2), chr(92) || '|', chr(1))"
    return f"[{TRIM('replace(c, chr(1), ' + quote('|') + ')')} for c in string_split({inner}, '|')]"


def PAD(cells: str, cols: str) -> str:
    return f"[coalesce(({cells})[i], '') for i in range(1, len({cols}) + 1)]"


def parse(source: str) -> str:
    mark = r"'^---\s*Sheet:\s*(.+?)\s*---\s*$'"
    return f"""lines AS (SELECT doc_set_id, doc_id, document_type, generate_subscripts(a, 1) AS ln, {TRIM('unnest(a)')} AS l
      FROM (SELECT *, string_split(text, chr(10)) AS a FROM {source}) z),
    num AS (SELECT *, regexp_matches(l, {mark}) AS is_mark, {TRIM(f"regexp_extract(l, {mark}, 1)")} AS nm,
      sum(CAST(regexp_matches(l, {mark}) AS BIGINT)) OVER (PARTITION BY doc_set_id ORDER BY doc_id, ln) AS sheet_no FROM lines),
    marks AS (SELECT doc_set_id, sheet_no, nm FROM num WHERE is_mark),
    trows AS (SELECT n.doc_set_id, CAST(n.sheet_no AS BIGINT) AS sheet_no, doc_id, ln, l, coalesce(m.nm, '') AS sheet_name,
        row_number() OVER (PARTITION BY n.doc_set_id, n.sheet_no ORDER BY doc_id, ln) AS rn
      FROM num n LEFT JOIN marks m ON m.doc_set_id = n.doc_set_id AND m.sheet_no = n.sheet_no
      WHERE NOT is_mark AND starts_with(l, '|') AND ends_with(l, '|') AND length(l) >= 3
        AND NOT regexp_matches(l, '^\\|[\\s\\-|:]+\\|$')),
    md AS (SELECT t.doc_set_id, t.sheet_no, t.sheet_name, t.doc_id, t.ln, t.rn = 1 AS is_header, h.columns,
        {PAD(CELLS('t.l'), 'h.columns')} AS cells
      FROM trows t JOIN (SELECT doc_set_id, sheet_no, {CELLS('l')} AS columns FROM trows WHERE rn = 1) h
        ON h.doc_set_id = t.doc_set_id AND h.sheet_no = t.sheet_no)"""


def FIELDS(line: str, delimiter: str) -> str:
    def one(ch: str, sql: str) -> str:
        field = f'{ch}([^"{ch}]*(?:"[^"]*(?:""[^"]*)*(?:"|$)[^"{ch}]*)*)'
        return f"WHEN {delimiter} = {sql} THEN regexp_extract_all({sql} || {line}, {quote(field)}, 1)"
    raw = f"CASE {one(chr(9), 'chr(9)')} {one(';', quote(';'))} {one(',', quote(','))} END"
    unquoted = 'replace(regexp_replace(f, \'"([^"]*(?:""[^"]*)*)(?:"|$)\', \'\\1\', \'g\'), \'""\', \'"\')'
    return f"[{TRIM(unquoted)} for f in {raw}]"


DELIMITER = ("CASE WHEN a >= b AND a >= c THEN chr(9) WHEN b > c THEN ';' ELSE ',' END")


def delimited(source: str, skip: str) -> str:
    return f"""raws AS (SELECT doc_set_id, doc_id, generate_subscripts(a, 1) AS ln, unnest(a) AS l
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS a FROM {source}
            WHERE document_type IN ('Excel', 'Csv') {skip}) z),
    heads AS (SELECT *, length(l) - length(replace(l, chr(9), '')) AS a, length(l) - length(replace(l, ';', '')) AS b,
        length(l) - length(replace(l, ',', '')) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_set_id
          ORDER BY doc_id, ln) AS rn, count(*) OVER (PARTITION BY doc_set_id) AS n FROM raws) z WHERE rn = 1 AND n >= 2),
    delims AS (SELECT doc_set_id, doc_id AS hdoc, ln AS hln, l, {DELIMITER} AS d FROM heads),
    heads2 AS (SELECT *, {FIELDS('l', 'd')} AS columns FROM delims),
    csv AS (SELECT r.doc_set_id, CAST(1 AS BIGINT) AS sheet_no, 'Sheet1' AS sheet_name, r.doc_id, r.ln,
        r.doc_id = h.hdoc AND r.ln = h.hln AS is_header, h.columns, {PAD(FIELDS('r.l', 'h.d'), 'h.columns')} AS cells
      FROM raws r JOIN heads2 h ON h.doc_set_id = r.doc_set_id
      WHERE NOT {BLANK('r.l')} OR (r.doc_id = h.hdoc AND r.ln = h.hln))"""


LOADED = (parse("sheet_texts") + ",\n" + delimited("sheet_texts", "AND doc_set_id NOT IN (SELECT doc_set_id FROM md)")
          + ",\nrowz AS (SELECT * FROM md UNION ALL SELECT * FROM csv)")
FLAT = "translate(upper({c}), ' _-./', '')"


def flat(c: str) -> str:
    return f"translate(upper({c}), ' _-./', '')"


def canon(c: str) -> str:
    return f"coalesce({map_case(flat(c), names.CONCEPT_OF)}, {c})"


SHEETS = """sheets AS (SELECT doc_set_id, sheet_no, any_value(sheet_name) AS sheet_name, any_value(columns) AS columns,
      CAST(count(*) FILTER (NOT is_header) AS BIGINT) AS n_rows FROM rowz GROUP BY doc_set_id, sheet_no)"""
HEADERS = f"""headers AS (SELECT *, {flat('col_name')} AS fl, {canon('col_name')} AS canon FROM (
      SELECT doc_set_id, sheet_no, sheet_name, n_rows, generate_subscripts(columns, 1) - 1 AS col_no, unnest(columns) AS col_name
      FROM sheets) z)"""
CONCEPTS = "concepts AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', [{in_list(w)}])" for i, (c, w) in enumerate(vocab.CONCEPT_TERMS)) + ") v(no, concept, words))"
RESOLVE = f"""column_hits AS (
    SELECT q.query_id, q.doc_set_id, 1 AS step, 0 AS no, -n_rows AS size, sheet_no, 0 AS sub, col_no, col_name
      FROM sheet_questions q JOIN headers h ON h.doc_set_id = q.doc_set_id
      WHERE NOT {BLANK('col_name')} AND contains(lower(query_text), lower(col_name))
    UNION ALL SELECT q.query_id, q.doc_set_id, 2, 0, -n_rows, sheet_no, 0, col_no, col_name
      FROM sheet_questions q JOIN headers h ON h.doc_set_id = q.doc_set_id
      WHERE NOT {BLANK('col_name')} AND contains(lower(query_text), lower(canon))
    UNION ALL SELECT q.query_id, q.doc_set_id, 3, c.no, -n_rows, sheet_no, CASE WHEN fl = concept THEN 1 ELSE 2 END, col_no, col_name
      FROM sheet_questions q JOIN headers h ON h.doc_set_id = q.doc_set_id
      JOIN concepts c ON len(list_filter(c.words, lambda w: contains(lower(query_text), w))) > 0 AND h.canon = c.concept
    UNION ALL SELECT q.query_id, q.doc_set_id, 4, c.no, -n_rows, sheet_no, 0, col_no, col_name
      FROM sheet_questions q JOIN headers h ON h.doc_set_id = q.doc_set_id
      JOIN concepts c ON len(list_filter(c.words, lambda w: contains(lower(query_text), w))) > 0 AND contains(h.fl, c.concept)),
    resolved AS (SELECT query_id, doc_set_id, col_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY step, no, size, sheet_no, sub, col_no) AS r FROM column_hits) z WHERE r = 1)"""


def NUMBER(e: str) -> str:
    body = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    t = TRIM(e)
    return (f"CASE WHEN regexp_matches({t}, '^[+-]?{body}$') THEN TRY_CAST(replace(replace({t}, ',', ''), '+', '') AS DOUBLE) "
            f"WHEN regexp_matches({t}, '^{body}\\+$') THEN TRY_CAST(replace(rtrim({t}, '+'), ',', '') AS DOUBLE) "
            f"WHEN regexp_matches({t}, '^{body}-$') THEN -TRY_CAST(replace(rtrim({t}, '-'), ',', '') AS DOUBLE) "
            f"WHEN regexp_matches({t}, '^\\({body}\\)$') THEN -TRY_CAST(replace(substring({t}, 2, length({t}) - 2), ',', '') AS DOUBLE) END")


def PLAIN(v: str) -> str:
    c = f"rtrim(replace({v}, ' ', ''), 'GMKTbBps')"
    clean = (f"CASE WHEN contains({c}, ',') AND NOT contains({c}, '.') AND length({c}) - length(replace({c}, ',', '')) = 1 "
             f"THEN replace({c}, ',', '.') WHEN contains({c}, ',') AND strpos({c}, '.') > strpos({c}, ',') "
             f"THEN replace({c}, ',', '') ELSE {c} END")
    return f"CASE WHEN NOT {BLANK(v)} THEN {NUMBER('(' + clean + ')')} END"


def MBPS(v: str) -> str:
    t = TRIM(v)
    u = f"upper(right({t}, 1))"
    digits = f"CASE WHEN {u} IN ('G', 'T', 'M', 'K') THEN left({t}, length({t}) - 1) ELSE {t} END"
    factor = f"CASE {u} WHEN 'G' THEN 1000.0 WHEN 'T' THEN 1000000.0 WHEN 'K' THEN 0.001 ELSE 1.0 END"
    return f"CASE WHEN NOT {BLANK(v)} THEN ({NUMBER('rtrim(' + digits + ', ' + quote('bBpPsSit') + ')')}) * CAST({factor} AS DOUBLE) END"


def SHOW(v: str) -> str:
    scaled = f"CAST((abs({v}) - floor(abs({v}))) * 4611686018427387904.0 AS BIGINT)::HUGEINT"
    cents = f"(({scaled} * 100 + 2305843009213693952) // 4611686018427387904)"
    return (f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CASE WHEN {v} < 0 THEN '-' ELSE '' END || "
            f"CAST(CAST(floor(abs({v})) AS BIGINT) + CASE WHEN {cents} >= 100 THEN 1 ELSE 0 END AS VARCHAR) || '.' || "
            f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') END")


def intent_sql(q: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(q, w)} THEN '{i}'" for i, w in vocab.INTENT_KEYWORDS) + " ELSE 'SpecificLookup' END"


INTENT = f"asked AS (SELECT *, {intent_sql('lower(query_text)')} AS intent FROM sheet_questions)"
ELIGIBLE = "eligible AS (" + " UNION ALL ".join(
    f"SELECT query_id, doc_set_id, intent, query_text, '{n}' AS extractor FROM asked WHERE intent IN ({in_list(serves)})"
    + (f" AND {any_of('lower(query_text)', terms)}" if terms else "") for n, _, _, serves, terms in vocab.EXTRACTORS) + ")"
TOTALS = """totals AS (SELECT doc_set_id, CAST(sum(n_rows) AS BIGINT) AS total_rows,
      CASE WHEN count(*) FILTER (sheet_name <> '') = 1 THEN max(sheet_name) FILTER (sheet_name <> '') END AS only_sheet
      FROM sheets GROUP BY doc_set_id HAVING sum(n_rows) > 0)"""
EXTRA = f"""extra AS (SELECT doc_set_id, extractor, arg_min(col_name, (sheet_no, col_no)) AS col_name FROM (
      SELECT *, 'CircuitExtractor' AS extractor FROM headers WHERE lower({TRIM("replace(replace(col_name, '_', ' '), '-', ' ')")})
        IN ({in_list(vocab.CIRCUIT_COLUMNS)})
      UNION ALL SELECT *, 'InterfaceExtractor' FROM headers WHERE lower({TRIM('col_name')}) IN ({in_list(vocab.INTERFACE_COLUMNS)})
      UNION ALL SELECT *, 'IpAddressExtractor' FROM headers WHERE lower({TRIM('col_name')}) IN ({in_list(vocab.IP_COLUMNS)})) z
      GROUP BY doc_set_id, extractor)"""
TARGETS = """targets AS (SELECT e.*, coalesce(r.col_name, x.col_name) AS col_name FROM eligible e
      LEFT JOIN resolved r ON r.query_id = e.query_id LEFT JOIN extra x ON x.doc_set_id = e.doc_set_id AND x.extractor = e.extractor
      WHERE NOT (e.extractor = 'GenericColumn' AND e.intent IN ('Count', 'Aggregation')) AND e.extractor <> 'VlanExtractor')"""
VALUES = """places AS (SELECT h.doc_set_id, lower(h.col_name) AS target, h.sheet_no, min(h.col_no) AS col_no FROM headers h
      WHERE (h.doc_set_id, lower(h.col_name)) IN (SELECT (doc_set_id, lower(col_name)) FROM targets WHERE col_name IS NOT NULL)
      GROUP BY ALL),
    vals AS (SELECT r.doc_set_id, p.target, r.sheet_no, r.doc_id, r.ln, r.cells[p.col_no + 1] AS value FROM rowz r
      JOIN places p ON p.doc_set_id = r.doc_set_id AND p.sheet_no = r.sheet_no WHERE NOT r.is_header)"""


def figures(name: str, source: str) -> str:
    return f"""{name}_n AS (SELECT *, {PLAIN('value')} AS plain, {MBPS('value')} AS mbps,
        upper(right({TRIM('value')}, 1)) IN ('G', 'M', 'T', 'K') AS unit FROM {source} WHERE NOT {BLANK('value')}),
    {name}_d AS (SELECT doc_set_id, target, lower(value) AS low, arg_min(value, (sheet_no, doc_id, ln)) AS v,
        min((sheet_no, doc_id, ln)) AS pos FROM {name}_n GROUP BY ALL),
    {name}_f AS (SELECT doc_set_id, target, count(*) AS distinct_n FROM {name}_d GROUP BY ALL),
    {name}_t AS (SELECT doc_set_id, target, string_agg(v, ',' ORDER BY pos) AS first_values FROM (SELECT *, row_number() OVER (
        PARTITION BY doc_set_id, target ORDER BY pos) AS r FROM {name}_d) z WHERE r <= 10 GROUP BY ALL),
    {name} AS (SELECT a.*, f.distinct_n, t.first_values FROM (SELECT doc_set_id, target, count(*) AS filled, count(plain) AS plain_n,
        sum(plain) AS plain_sum, max(plain) AS plain_max, min(plain) AS plain_min, count(mbps) AS mbps_n, sum(mbps) AS mbps_sum,
        max(mbps) AS mbps_max, min(mbps) AS mbps_min, bool_or(unit) AS has_unit FROM {name}_n GROUP BY ALL) a
      JOIN {name}_f f ON f.doc_set_id = a.doc_set_id AND f.target = a.target
      JOIN {name}_t t ON t.doc_set_id = a.doc_set_id AND t.target = a.target)"""


VERB = ("CASE intent WHEN 'DistinctCount' THEN 'Distinct' WHEN 'Count' THEN 'Count' WHEN 'Sum' THEN 'Sum' "
        "WHEN 'Average' THEN 'Average' WHEN 'Maximum' THEN 'Max' WHEN 'Minimum' THEN 'Min' END")


def agg(k: str) -> str:
    return (f"CASE intent WHEN 'Sum' THEN {k}_sum WHEN 'Average' THEN {k}_sum / {k}_n WHEN 'Maximum' THEN {k}_max "
            f"WHEN 'Minimum' THEN {k}_min END")


def answer(extractor: str, source: str, **f: str) -> str:
    order = [e[0] for e in vocab.EXTRACTORS].index(extractor)
    _, version, priority, _, _ = vocab.EXTRACTORS[order]
    g = {"value": "''", "confidence": "100.0", "method": "''", "rows_processed": "total_rows", "column_used": "NULL", "sheet_name": "NULL",
         "is_exact": "true", "column_matched": "true", "fallback_extractor": "NULL", "values_extracted": "0", "distinct_values": "0",
         "rejected_rows": "0", "first_values": "NULL", **f, "extractor_name": f"'{extractor}'", "extractor_version": f"'{version}'",
         "extractor_priority": str(priority), "extractor_order": str(order)}
    t = {"confidence": "DOUBLE", "rows_processed": "BIGINT", "values_extracted": "BIGINT", "distinct_values": "BIGINT",
         "rejected_rows": "BIGINT", "extractor_priority": "INTEGER", "extractor_order": "INTEGER", "is_exact": "BOOLEAN",
         "column_matched": "BOOLEAN"}
    cols = ", ".join(f"CAST({v} AS {t.get(k, 'VARCHAR')}) AS {k}" for k, v in g.items())
    return f"SELECT * FROM (SELECT query_id, doc_set_id, {cols} FROM ({source}) s) w WHERE value IS NOT NULL"


CANON = canon("col_name")
BASIS = ",\n".join([LOADED, SHEETS, HEADERS, CONCEPTS, RESOLVE, INTENT, ELIGIBLE, TOTALS, EXTRA, TARGETS, VALUES, figures("figs", "vals")])
FIGURED = ("SELECT t.*, o.total_rows, f.* EXCLUDE (doc_set_id, target) FROM targets t JOIN totals o ON o.doc_set_id = t.doc_set_id "
           "LEFT JOIN figs f ON f.doc_set_id = t.doc_set_id AND f.target = lower(t.col_name) "
           "WHERE t.col_name IS NOT NULL AND extractor = '{e}'")
A_ROWS = answer("GenericColumn", "SELECT e.*, o.total_rows, o.only_sheet FROM eligible e JOIN totals o ON o.doc_set_id = e.doc_set_id "
                "WHERE extractor = 'GenericColumn' AND intent IN ('Count', 'Aggregation')", value="total_rows",
                method="'Count(rows)'", column_matched="false", sheet_name="only_sheet")


def a_column(extractor: str, where: str) -> str:
    return answer(extractor, FIGURED.format(e=extractor) + where,
                  value="CASE WHEN intent = 'DistinctCount' THEN coalesce(distinct_n, 0) ELSE coalesce(filled, 0) END",
                  method=f"{VERB} || '(' || {CANON} || ')'", column_used="col_name", values_extracted="coalesce(filled, 0)",
                  distinct_values="coalesce(distinct_n, 0)", first_values="coalesce(first_values, '')")


A_DISTINCT = a_column("GenericColumn", " AND intent = 'DistinctCount'")
A_NUMERIC = answer("GenericColumn", f"SELECT *, {agg('plain')} AS v FROM ({FIGURED.format(e='GenericColumn')} AND intent IN "
                   "('Sum', 'Average', 'Maximum', 'Minimum')) y", value=SHOW("v"), method=f"{VERB} || '(' || {CANON} || ')'",
                   column_used="col_name")
A_BANDWIDTH = answer("BandwidthExtractor", f"SELECT *, CASE WHEN NOT coalesce(has_unit, false) AND coalesce(plain_n, 0) > coalesce(mbps_n, 0) "
                     f"THEN {agg('plain')} ELSE {agg('mbps')} END AS v FROM ({FIGURED.format(e='BandwidthExtractor')}) y",
                     value=SHOW("v"), method=f"{VERB} || '(' || {CANON} || ')'", column_used="col_name")
COUNTING = " AND intent IN ('Count', 'DistinctCount')"
A_CIRCUIT, A_IFACE_COL, A_IP_COL = (a_column(e, COUNTING) for e in ("CircuitExtractor", "InterfaceExtractor", "IpAddressExtractor"))
VLAN = f"""vlan_t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_set_id ORDER BY n_rows DESC, sheet_no, sub, col_no) AS r
      FROM (SELECT *, CASE WHEN fl = 'VLAN' THEN 1 WHEN canon = 'VLAN' THEN 2 ELSE 3 END AS sub FROM headers
            WHERE canon = 'VLAN' OR contains(fl, 'VLAN')) z) y WHERE r = 1),
    vlan_p AS (SELECT t.doc_set_id, t.sheet_no, t.sheet_name AS vlan_sheet, t.col_name, (SELECT min(col_no) FROM headers h
        WHERE h.doc_set_id = t.doc_set_id AND h.sheet_no = t.sheet_no AND lower(h.col_name) = lower(t.col_name)) AS col_no FROM vlan_t t),
    vlan_v AS (SELECT r.doc_set_id, 'v' AS target, r.sheet_no, r.doc_id, r.ln, r.cells[p.col_no + 1] AS value FROM rowz r
      JOIN vlan_p p ON p.doc_set_id = r.doc_set_id AND p.sheet_no = r.sheet_no WHERE NOT r.is_header),
    {figures('vfigs', 'vlan_v')},
    tok AS (SELECT doc_set_id, CASE WHEN t BETWEEN 1 AND 4094 THEN t END AS vlan FROM (SELECT doc_set_id,
        TRY_CAST(regexp_extract(cells[1], '^\\s*([0-9]{{1,4}})(?:[^\\pL\\pN_]|$)', 1) AS INTEGER) AS t FROM rowz
        WHERE doc_set_id NOT IN (SELECT doc_set_id FROM vlan_t)) z),
    tokf AS (SELECT doc_set_id, count(vlan) AS extracted, count(*) - count(vlan) AS rejected, count(DISTINCT vlan) AS ids, max(vlan) AS hi,
        min(vlan) AS lo, array_to_string(list_sort(list_distinct(list(vlan)))[1:10], ',') AS firsts FROM tok GROUP BY doc_set_id)"""
IS_D, IS_C = "intent = 'DistinctCount'", "intent = 'Count'"
A_VLAN = answer("VlanExtractor", f"SELECT *, {agg('plain')} AS v FROM (SELECT e.*, p.col_name, p.vlan_sheet, o.total_rows, f.* EXCLUDE (doc_set_id, target) "
                "FROM eligible e JOIN vlan_p p ON p.doc_set_id = e.doc_set_id JOIN totals o ON o.doc_set_id = e.doc_set_id "
                "LEFT JOIN vfigs f ON f.doc_set_id = e.doc_set_id WHERE e.extractor = 'VlanExtractor') y",
                value=f"CASE WHEN {IS_D} THEN CAST(coalesce(distinct_n, 0) AS VARCHAR) WHEN {IS_C} THEN CAST(coalesce(filled, 0) AS VARCHAR) ELSE {SHOW('v')} END",
                method=f"{VERB} || '(' || {CANON} || ') in ''' || vlan_sheet || ''''", column_used="col_name",
                values_extracted=f"CASE WHEN {IS_D} OR {IS_C} THEN coalesce(filled, 0) ELSE 0 END",
                distinct_values=f"CASE WHEN {IS_D} THEN coalesce(distinct_n, 0) ELSE 0 END",
                first_values=f"CASE WHEN {IS_D} THEN coalesce(first_values, '') END")
A_TOKEN = answer("VlanExtractor", "SELECT e.*, o.total_rows, f.* EXCLUDE (doc_set_id) FROM eligible e JOIN totals o ON o.doc_set_id = e.doc_set_id "
                 "JOIN tokf f ON f.doc_set_id = e.doc_set_id WHERE e.extractor = 'VlanExtractor' AND ids > 0",
                 value=f"CASE WHEN {IS_D} THEN ids WHEN {IS_C} THEN extracted WHEN intent = 'Maximum' THEN hi ELSE lo END",
                 method=f"CASE WHEN {IS_D} THEN 'Distinct(VLAN_ID_FROM_FIRST_TOKEN)' WHEN {IS_C} THEN 'Count(VLAN_ROWS_FROM_FIRST_TOKEN)' "
                 "WHEN intent = 'Maximum' THEN 'Max(VLAN_ID_FROM_FIRST_TOKEN)' ELSE 'Min(VLAN_ID_FROM_FIRST_TOKEN)' END",
                 confidence="95.0", is_exact="false", column_matched="false", column_used="'VLAN(first-token)'",
                 fallback_extractor="'VlanFirstToken'", values_extracted=f"CASE WHEN {IS_D} OR {IS_C} THEN extracted ELSE 0 END",
                 distinct_values=f"CASE WHEN {IS_D} THEN ids ELSE 0 END", rejected_rows=f"CASE WHEN {IS_D} THEN rejected ELSE 0 END",
                 first_values=f"CASE WHEN {IS_D} THEN firsts END")
IFACE_RE = vocab.INTERFACE_NAME.replace("(?i)", "")
IP_RE = vocab.IPV4.replace(r"\b", "")
SCANS = f"""cellz AS (SELECT doc_set_id, sheet_no, doc_id, ln, generate_subscripts(cells, 1) AS k, unnest(cells) AS value FROM rowz WHERE NOT is_header),
    ifc AS (SELECT doc_set_id, lower(v) AS low, arg_min(v, pos) AS v FROM (SELECT doc_set_id, {TRIM('value')} AS v, (sheet_no, doc_id, ln, k) AS pos
        FROM cellz WHERE regexp_matches({TRIM('value')}, {quote(IFACE_RE)}, 'i')) z GROUP BY ALL),
    ipc AS (SELECT doc_set_id, v FROM (SELECT doc_set_id, unnest(regexp_extract_all(value, {quote(vocab.IPV4)})) AS v FROM cellz) z GROUP BY ALL),
    ifs AS (SELECT doc_set_id, count(*) AS n, array_to_string(list_sort(list(v))[1:10], ',') AS firsts FROM ifc GROUP BY doc_set_id),
    ips AS (SELECT doc_set_id, count(*) AS n, array_to_string(list_sort(list(v))[1:10], ',') AS firsts FROM ipc GROUP BY doc_set_id)"""


def a_scan(extractor: str, table: str, label: str, column: str, fallback: str) -> str:
    return answer(extractor, f"SELECT t.*, o.total_rows, f.n, f.firsts FROM targets t JOIN totals o ON o.doc_set_id = t.doc_set_id "
                  f"JOIN {table} f ON f.doc_set_id = t.doc_set_id WHERE extractor = '{extractor}' AND t.col_name IS NULL",
                  value="n", confidence="95.0", method=f"{VERB} || '({label})'", column_used=f"'{column}'", is_exact="false",
                  column_matched="false", fallback_extractor=f"'{fallback}'", distinct_values="n", first_values="firsts")


A_IFACE_SCAN = a_scan("InterfaceExtractor", "ifs", "INTERFACE_FROM_CONTENT", "Interface(content-scan)", "InterfaceContentScan")
A_IP_SCAN = a_scan("IpAddressExtractor", "ips", "IPv4_FROM_CONTENT", "IPv4(content-scan)", "IpContentScan")
NEEDS = ["sheet_texts", "sheet_questions"]
FULL = ",\n".join([BASIS, VLAN, SCANS])
A_ALL = " UNION ALL ".join([A_ROWS, A_DISTINCT, A_NUMERIC, A_BANDWIDTH, A_CIRCUIT, A_IFACE_COL, A_IP_COL, A_VLAN, A_TOKEN,
                            A_IFACE_SCAN, A_IP_SCAN])
ARBITRATED = f"""SELECT * EXCLUDE (extractor_order, r), FROM (SELECT *, CAST(count(*) OVER (PARTITION BY query_id, doc_set_id) AS INTEGER) AS candidate_count,
    row_number() OVER (PARTITION BY query_id, doc_set_id ORDER BY confidence DESC, extractor_priority DESC, values_extracted DESC,
      extractor_order) AS r FROM ({A_ALL}) c WHERE confidence >= 95) z WHERE r = 1"""

# ── registration ──────────────────────────────────────────────────────────────


class Work:
    """Shared frames of one answer query."""

    def __init__(self, t: Tables):
        self.rows = cut_lineage(tb.load_tables(t.sheet_texts))
        self.sheets = cut_lineage(tb.sheets_of(self.rows))
        self.headers, self.totals = tb.headers_of(self.sheets), an.set_totals(self.sheets)
        self.asked = an.classify(t.sheet_questions)
        self.eligible = cut_lineage(an.extractor_eligibility(cut_lineage(self.asked)))
        self.targets = cut_lineage(an.question_columns(self.eligible, self.headers))

    def figured(self, *extractors: str, intents: tuple[str, ...] = ()) -> DataFrame:
        chosen = self.targets.where(F.col("extractor").isin(list(extractors)))
        if intents:
            chosen = chosen.where(F.col("intent").isin(list(intents)))
        return an.with_figures(chosen, self.rows, self.headers, self.totals)


CELL_COLS = ["doc_set_id", "sheet_no", "sheet_name", "doc_id", "col_no", "col_name", "value"]
register("markdown_cells", lambda t: tb.markdown_cells(tb.table_rows(t.workbooks)).select(*CELL_COLS),
         """SELECT doc_set_id, sheet_no, sheet_name, doc_id, CAST(i - 1 AS INTEGER) AS col_no, columns[i] AS col_name, cells[i] AS value
            FROM (SELECT *, unnest(range(1, len(columns) + 1)) AS i FROM md WHERE NOT is_header) z""", ["workbooks"], parse("workbooks"))
register("pad_or_trim",
         lambda t: tb.table_rows(t.workbooks).select("doc_set_id", "sheet_no", "doc_id", "is_header", F.size("cells").alias("width"),
                                                     F.array_join("cells", "¦").alias("row")),
         """SELECT doc_set_id, sheet_no, doc_id, is_header, CAST(len(cells) AS INTEGER) AS width, array_to_string(cells, '¦') AS row FROM md""",
         ["workbooks"], parse("workbooks"))
register("read_delimited_text",
         lambda t: tb.delimited_rows(t.csv_docs).select("doc_set_id", "doc_id", "is_header", F.array_join("cells", "¦").alias("row")),
         "SELECT doc_set_id, doc_id, is_header, array_to_string(cells, '¦') AS row FROM csv", ["csv_docs"], delimited("csv_docs", ""))
register("load_tables",
         lambda t: tb.load_tables(t.sheet_texts).select("doc_set_id", "sheet_no", "sheet_name", "doc_id", "is_header",
                                                        F.array_join("columns", "¦").alias("columns"), F.array_join("cells", "¦").alias("row")),
         """SELECT doc_set_id, sheet_no, sheet_name, doc_id, is_header, array_to_string(columns, '¦') AS columns,
              array_to_string(cells, '¦') AS row FROM rowz""", ["sheet_texts"], LOADED)
_HEADS = ",\n".join([LOADED, SHEETS, HEADERS])


def _headers(t: Tables) -> DataFrame:
    return tb.headers_of(tb.sheets_of(tb.load_tables(t.sheet_texts)))


register("flatten_name", lambda t: _headers(t).select("doc_set_id", "sheet_no", "col_no", names.flatten_name("col_name").alias("flat")),
         "SELECT doc_set_id, sheet_no, CAST(col_no AS INTEGER) AS col_no, fl AS flat FROM headers", ["sheet_texts"], _HEADS)
register("canonical_column", lambda t: _headers(t).select("doc_set_id", "sheet_no", "col_no", names.canonical_column("col_name").alias("canonical")),
         "SELECT doc_set_id, sheet_no, CAST(col_no AS INTEGER) AS col_no, canon AS canonical FROM headers", ["sheet_texts"], _HEADS)
register("find_best_column",
         lambda t: tb.find_best_column(t.sheet_questions.select("doc_set_id", F.explode(F.split(F.lower("query_text"), r"[ ?\n]")).alias("concept"))
                                       .where(F.length("concept") > 0), _headers(t)),
         f"""SELECT c.doc_set_id, concept, arg_min(col_name, (CASE WHEN fl = cf THEN 1 ELSE 2 END, sheet_no, col_no)) AS col_name FROM (
               SELECT w.doc_set_id, concept, {flat('concept')} AS cf, {canon('concept')} AS cc FROM (SELECT DISTINCT doc_set_id,
                 unnest(regexp_split_to_array(lower(query_text), '[ ?\\n]')) AS concept FROM sheet_questions) w WHERE concept <> '') c
             JOIN headers h ON h.doc_set_id = c.doc_set_id AND (h.fl = c.cf OR (h.canon = c.cc AND c.cc <> concept))
             GROUP BY ALL""", NEEDS, _HEADS)
register("resolve_target_column", lambda t: tb.resolve_target_column(t.sheet_questions, _headers(t)),
         "SELECT * FROM resolved", NEEDS, ",\n".join([_HEADS, CONCEPTS, RESOLVE]))


def _values(t: Tables) -> DataFrame:
    w = Work(t)
    named = w.targets.where(F.col("col_name").isNotNull())
    return tb.column_values(tb.sheet_columns(named, w.headers), w.rows)


_VALS = ",\n".join([LOADED, SHEETS, HEADERS, CONCEPTS, RESOLVE, INTENT, ELIGIBLE, EXTRA, TARGETS, VALUES])
register("column_values", lambda t: _values(t).select("doc_set_id", "target", "sheet_no", "doc_id", "value"),
         "SELECT doc_set_id, target, sheet_no, doc_id, value FROM vals", NEEDS, _VALS)
# number readers run over every cell, numeric or not
_CELLS = LOADED + ",\ncellv AS (SELECT doc_set_id, sheet_no, doc_id, unnest(cells) AS value FROM rowz WHERE NOT is_header)"


def _cells(t: Tables) -> DataFrame:
    return tb.markdown_cells(tb.load_tables(t.sheet_texts)).select("doc_set_id", "sheet_no", "doc_id", "value")


register("parse_numeric", lambda t: _cells(t).withColumn("number", numbers.parse_numeric("value")),
         f"SELECT doc_set_id, sheet_no, doc_id, value, {PLAIN('value')} AS number FROM cellv", ["sheet_texts"], _CELLS)
register("parse_bandwidth", lambda t: _cells(t).withColumn("mbps", numbers.parse_bandwidth("value")),
         f"SELECT doc_set_id, sheet_no, doc_id, value, {MBPS('value')} AS mbps FROM cellv", ["sheet_texts"], _CELLS)
register("format_result",
         lambda t: t.lineitem.select("l_orderkey", "l_linenumber", numbers.format_result(F.col("l_extendedprice") * F.col("l_discount") / 8).alias("shown"),
                                     numbers.format_result(-F.col("l_quantity")).alias("whole")),
         f"""SELECT l_orderkey, l_linenumber, {SHOW('v')} AS shown, {SHOW('w')} AS whole FROM (
               SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount / 8 AS v, -l_quantity AS w FROM lineitem) z""")

register("extractor_eligibility", lambda t: an.extractor_eligibility(an.classify(t.sheet_questions)).drop("query_text"),
         "SELECT query_id, doc_set_id, intent, extractor FROM eligible", ["sheet_questions"], ",\n".join([INTENT, ELIGIBLE]))
register("agg_count_rows", lambda t: (lambda w: an.count_row_answers(w.eligible, w.totals))(Work(t)), A_ROWS, NEEDS, BASIS)
register("agg_count_nonblank",
         lambda t: (lambda f: an.column_count_answers(f, "CircuitExtractor").unionByName(an.column_count_answers(f, "InterfaceExtractor"))
                    .unionByName(an.column_count_answers(f, "IpAddressExtractor")))(
             Work(t).figured("CircuitExtractor", "InterfaceExtractor", "IpAddressExtractor", intents=("Count",))),
         " UNION ALL ".join(a_column(e, " AND intent = 'Count'") for e in ("CircuitExtractor", "InterfaceExtractor", "IpAddressExtractor")),
         NEEDS, BASIS)
register("agg_distinct", lambda t: an.column_count_answers(Work(t).figured("GenericColumn", intents=("DistinctCount",)), "GenericColumn"),
         A_DISTINCT, NEEDS, BASIS)
for _n, _i in (("agg_sum", "Sum"), ("agg_avg", "Average"), ("agg_max", "Maximum"), ("agg_min", "Minimum")):
    register(_n, lambda t, i=_i: an.numeric_answers(Work(t).figured("GenericColumn", intents=(i,))),
             f"SELECT n.* FROM ({A_NUMERIC}) n JOIN asked a ON a.query_id = n.query_id WHERE a.intent = '{_i}'", NEEDS, BASIS)
register("agg_bandwidth", lambda t: an.bandwidth_answers(Work(t).figured("BandwidthExtractor")), A_BANDWIDTH, NEEDS, BASIS)
register("agg_vlan", lambda t: (lambda w: an.vlan_answers(w.eligible, w.rows, w.sheets, w.totals))(Work(t)), A_VLAN, NEEDS,
         ",\n".join([BASIS, VLAN]))
register("agg_vlan_first_token", lambda t: (lambda w: an.vlan_first_token_answers(w.eligible, w.rows, w.sheets, w.totals))(Work(t)),
         A_TOKEN, NEEDS, ",\n".join([BASIS, VLAN]))
register("agg_circuit", lambda t: an.column_count_answers(Work(t).figured("CircuitExtractor"), "CircuitExtractor"), A_CIRCUIT, NEEDS, BASIS)
register("agg_interface",
         lambda t: (lambda w: an.column_count_answers(w.figured("InterfaceExtractor"), "InterfaceExtractor")
                    .unionByName(an.interface_scan_answers(w.targets, w.rows, w.totals)))(Work(t)),
         f"{A_IFACE_COL} UNION ALL {A_IFACE_SCAN}", NEEDS, FULL)
register("agg_ip",
         lambda t: (lambda w: an.column_count_answers(w.figured("IpAddressExtractor"), "IpAddressExtractor")
                    .unionByName(an.ip_scan_answers(w.targets, w.rows, w.totals)))(Work(t)),
         f"{A_IP_COL} UNION ALL {A_IP_SCAN}", NEEDS, FULL)
register("answer_arbitration", lambda t: an.exact_answers(t.sheet_questions, t.sheet_texts), ARBITRATED, NEEDS, FULL)
