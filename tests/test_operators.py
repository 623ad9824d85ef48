"""Operators against literal loops and small worked tables."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import (answers as an, chunking as ch, context as cx, layout as ly, operations as op, retrieval as r, segments as sg,
                               tables as tb)
from foliant.options import DEFAULTS
from foliant.plans import ranking


def scored_rows(seed):
    rnd = random.Random(seed)
    return [(q, c, c % 3, rnd.randrange(12), rnd.choice([None, 1, 2]), round(rnd.random(), 2)) for q in range(5) for c in range(rnd.randrange(1, 60))]


SCORED = "query_id int, chunk_id bigint, doc_id bigint, chunk_index int, page_number int, score double"


def by_rank(df):
    out = {}
    for row in df.orderBy("query_id", "rank").collect():
        out.setdefault(row.query_id, []).append(row.chunk_id)
    return out


def order(rows):
    return sorted(rows, key=lambda x: (-x[5], x[1]))


def expect_pages(rows, top, per_page):
    chosen, seen = [], {}
    for x in order(rows):
        key = (x[2], x[4])
        if len(chosen) < top and seen.get(key, 0) < per_page:
            seen[key] = seen.get(key, 0) + 1
            chosen.append(x)
    for x in order(rows):
        if len(chosen) < top and x not in chosen:
            chosen.append(x)
    return [x[1] for x in chosen]


def expect_threshold(rows, t):
    kept = [x for x in rows if x[5] >= t]
    return kept or order(rows)[:3]


def test_page_diversity_matches_a_loop(spark):
    rows = scored_rows(1)
    got = by_rank(r.page_diversity(spark.createDataFrame(rows, SCORED), 8, 2))
    for q in {x[0] for x in rows}:
        assert got[q] == expect_pages([x for x in rows if x[0] == q], 8, 2)


def test_select_ranked_matches_a_loop(spark):
    rows = scored_rows(2) + [(9, c, 0, c, 1, 0.01 * c) for c in range(7)]
    options = replace(DEFAULTS, min_score=0.4, max_per_page=2)
    got = by_rank(r.select_ranked(spark.createDataFrame(rows, SCORED), 8, options))
    for q in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == q]
        assert got[q] == expect_pages(expect_threshold(mine, 0.4), 8, 2)


def test_document_wide_sample_matches_a_loop(spark):
    rows, top = scored_rows(3), 8
    options = replace(DEFAULTS, min_score=0.4)
    got = by_rank(r.document_wide_sample(spark.createDataFrame(rows, SCORED), top, options))
    for q in {x[0] for x in rows}:
        mine, half = [x for x in rows if x[0] == q], top // 2
        chosen = order(expect_threshold(mine, 0.4))[:half]
        line = sorted(mine, key=lambda x: (x[3], x[1]))
        step = max(1, len(line) // (half + 1))
        spread = [line[i] for i in range(step, len(line), step)][:half]
        chosen += [x for x in spread if x not in chosen]
        assert got[q] == [x[1] for x in order(chosen)]


def test_keyword_search_equals_substring_search(spark):
    rnd = random.Random(5)
    needles = ["FNT002400", "FNT-002400", "AB123", "1.2.3.4", "10.255.1.10"]
    hay = ["xfnt002400y", "fnt-0024001", "zab1234", "ab-123", "11.2.3.45", "1.2.3.4.5", "210.255.1.100", "fnt 002400", "9.1.2.3.4", "1..2.3.4", "Äab123"]
    chunks = [(i, i % 2, " ".join(rnd.sample(hay, 3))) for i in range(40)]
    queries = [(i, f"om {n} och {m}") for i, (n, m) in enumerate(zip(needles, needles[1:] + needles[:1]))]
    scope = [(q, d) for q, _ in queries for d in (0, 1)]
    got = r.keyword_search(spark.createDataFrame(queries, "query_id int, query_text string"), spark.createDataFrame(scope, "query_id int, doc_id int"),
                           spark.createDataFrame([(0, "Ready"), (1, "Queued")], "doc_id int, status string"),
                           spark.createDataFrame(chunks, "chunk_id int, doc_id int, content string")).collect()
    want = {(q, c) for q, (n, m) in enumerate(zip(needles, needles[1:] + needles[:1])) for c, d, s in chunks
            if d == 0 and (n.lower() in s.lower() or m.lower() in s.lower())}
    assert {(x.query_id, x.chunk_id) for x in got} == want


def test_pack_is_greedy():
    rnd = random.Random(7)
    for _ in range(200):
        lengths, header, limit = [rnd.randrange(0, 90) for _ in range(rnd.randrange(0, 40))], rnd.randrange(0, 60), 120
        bins, used = [], None
        for n in lengths:
            if used is None or used + n + 1 > limit:
                bins.append(0)
                used = header
            bins[-1] += 1
            used += n + 1
        got = ch.pack(np.array(lengths), header, limit)
        assert [b["n"] for b in got] == bins
        assert [b["start"] for b in got] == [1 + sum(bins[:i]) for i in range(len(bins))]


def test_chunk_text_covers_long_texts(spark):
    rnd = random.Random(11)
    words = " ".join(rnd.choice(["alfa", "beta.", "gamma!", "delta\n", "epsilon\n\n"]) for _ in range(4000))
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| rad {i} | {'x' * 40} |" for i in range(200))
    docs = spark.createDataFrame([(1, words), (2, "--- Page 1 ---\nkort\n--- Page 2 ---\n" + words), (3, table), (4, "  ")], "doc_id int, text string")
    rows = ch.chunk_text(docs).orderBy("doc_id", "chunk_index").collect()
    assert {x.doc_id for x in rows} == {1, 2, 3}
    for d in (1, 2, 3):
        mine = [x for x in rows if x.doc_id == d]
        assert [x.chunk_index for x in mine] == list(range(len(mine)))
        assert all(80 <= x.character_count == len(x.content) <= 3000 + 40 for x in mine)
    starts = [x.content for x in rows if x.doc_id == 3 and x.content.startswith("|")]
    assert all(c.startswith("| a | b |\n| --- | --- |") for c in starts)
    assert all(x.page_number == 2 for x in rows if x.doc_id == 2)
    assert next(x for x in rows if x.doc_id == 2).content.startswith("kort\n\n")  # tail of page 1 opens page 2


def test_sheet_chunks_keep_rows_whole(spark):
    lines = [f"| {i} | {'y' * (i % 70)} |" for i in range(300)]
    textual = "--- Sheet: Blad ---\n| Nr | Text |\n| --- | --- |\n" + "\n".join(lines) + "\n--- Sheet: Tom ---\n| " + "h" * 90 + " |\n"
    rows = ch.chunk_router(spark.createDataFrame([(1, textual)], "doc_id int, text string")).orderBy("chunk_index").collect()
    body = [ln for x in rows if x.heading == "Blad" for ln in x.content.split("\n")[3:]]
    assert body == lines
    assert all(len(x.content) <= 3000 for x in rows)
    assert rows[-1].heading == "Tom" and rows[-1].content.endswith("| " + "-" * 90 + " |")


def test_render_and_parse_round_trip(spark):
    cells = [(1, 1, "Ark", i, j, v) for i, row in enumerate([["Namn", "VLAN"], ["a|b", "10"], ["c", "20"]], 1) for j, v in enumerate(row, 1)]
    df = spark.createDataFrame(cells, "doc_id int, sheet_no int, sheet_name string, row_no int, col_no int, value string")
    none = spark.createDataFrame([], "doc_id int, sheet_no int, r1 int, c1 int, r2 int, c2 int")
    texts = ly.sheet_render(df, none).select(F.lit(1).alias("doc_set_id"), "doc_id", "text", F.lit("Excel").alias("document_type"))
    got = tb.markdown_cells(tb.load_tables(texts)).orderBy("row_no", "col_no").collect()
    assert [(x.sheet_name, x.col_name, x.value) for x in got] == [("Ark", "Namn", "a|b"), ("Ark", "VLAN", "10"), ("Ark", "Namn", "c"), ("Ark", "VLAN", "20")]


def test_qualified_headers(spark):
    cells = [(1, 1, "s", 1, 1, "Primary"), (1, 1, "s", 1, 2, ""), (1, 1, "s", 2, 1, "VLAN"), (1, 1, "s", 2, 2, "VLAN"), (1, 1, "s", 3, 1, "1"), (1, 1, "s", 3, 2, "2")]
    df = spark.createDataFrame(cells, "doc_id int, sheet_no int, sheet_name string, row_no int, col_no int, value string")
    merged = spark.createDataFrame([(1, 1, 1, 1, 1, 2)], "doc_id int, sheet_no int, r1 int, c1 int, r2 int, c2 int")
    heads = ly.qualified_headers(ly.merged_cell_fill(df, merged), ly.header_depth(df, merged)).orderBy("col_no").collect()
    assert [h.header for h in heads] == ["Primary_VLAN_1", "Primary_VLAN_2"]


def test_larger_vlan_sheet_wins(spark):
    core = "--- Sheet: Core ---\n| VLAN |\n|---|\n" + "\n".join(f"| {i} |" for i in range(1, 12))
    links = "\n--- Sheet: Links ---\n| Nätbrygga_Vlan | X |\n|---|---|\n" + "\n".join(f"| {i % 134 + 1} | y |" for i in range(268))
    texts = spark.createDataFrame([(1, 1, "Excel", core + links)], "doc_set_id int, doc_id int, document_type string, text string")
    queries = spark.createDataFrame([(1, 1, "Hur många unika vlan finns?"), (2, 1, "hur många vlan"), (3, 1, "högsta vlan")], "query_id int, doc_set_id int, query_text string")
    got = {x.query_id: x for x in an.exact_answers(queries, texts).collect()}
    assert (got[1].value, got[1].extractor_name, got[1].column_used) == ("134", "VlanExtractor", "Nätbrygga_Vlan")
    assert got[2].value == "268" and got[3].value == "134" and got[1].rows_processed == 279


def test_unmarked_tables_of_a_set_merge(spark):
    texts = spark.createDataFrame([(1, 1, "Excel", "| Namn | Antal |\n| a | 1 |"), (1, 2, "Excel", "| b | 2 |\n| c |"), (2, 3, "Csv", "x;y\n1;2"), (2, 4, "Csv", "3;\"4;5\"")],
                                  "doc_set_id int, doc_id int, document_type string, text string")
    rows = tb.load_tables(texts).where("not is_header").orderBy("doc_set_id", "doc_id", "row_no").collect()
    assert [list(x.cells) for x in rows] == [["a", "1"], ["b", "2"], ["c", ""], ["1", "2"], ["3", "4;5"]]


def test_batches_match_a_walk(spark):
    rnd = random.Random(13)
    sizes = [(q, i, i // 7, i % 7, rnd.randrange(1, 60)) for q in range(4) for i in range(rnd.randrange(1, 70))]
    options = replace(DEFAULTS, full_document_chars=150, max_passes=4)
    got = {(x.query_id, x.chunk_id): x.batch_no for x in cx.batch_split(spark.createDataFrame(
        sizes, "query_id int, chunk_id int, doc_id int, chunk_index int, chars int"), options).collect()}
    want = {}
    for q in range(4):
        no, used = 1, 0
        for _, c, _, _, n in [x for x in sizes if x[0] == q]:
            if no < 4 and used and used + n > 150:
                no, used = no + 1, 0
            used += n
            want[(q, c)] = no
    assert got == want


def test_ordered_context_keeps_to_its_budget(spark):
    rnd = random.Random(17)
    chunks = [(i, i // 5, i % 5, "z" * rnd.randrange(0, 120)) for i in range(40)]
    sizes = spark.createDataFrame([(1, c, d, k, f"T{d}", "f", len(s)) for c, d, k, s in chunks],
                                  "query_id int, chunk_id int, doc_id int, chunk_index int, title string, file_name string, body_chars int")
    contents = spark.createDataFrame(chunks, "chunk_id int, doc_id int, chunk_index int, content string")
    for budget in (10, 200, 900):
        parts, left, title, sent = [], budget, None, 0
        for c, d, k, s in chunks:
            head = "" if title == d else f"--- Dokument: T{d} (Fil: f) ---\n"
            if left <= 0 or len(head) > left:
                break
            title = d
            left -= len(head)
            parts.append(head + s[:left] + "\n\n")
            left -= len(s[:left]) + 2
            sent += 1
        got = cx.ordered_context(cx.ordered_chunks(sizes, budget), contents).collect()
        assert (got[0].context, got[0].chunks_sent) == ("".join(parts).strip(), sent) if sent else got == []


def test_words_join_the_latest_line(spark):
    words = [(1, 1, w, float(x), float(x + 5), b) for w, x, b in [("a", 0, 100.0), ("b", 40, 98.5), ("c", 60, 97.0), ("d", 0, 96.9), ("e", 3, 94.0)]]
    df = spark.createDataFrame(words, "doc_id int, page int, word string, left_x double, right_x double, bottom double")
    got = [(x.line_no, x.line) for x in ly.line_render(df).orderBy("line_no").collect()]
    assert got == [(1, "a | b"), (2, "d | c"), (3, "e")]


def test_guard_stops_at_the_first_silent_or_blocking_step(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    steps = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("x", 0, False)], "step string, step_order int, enabled boolean")
    verdicts = spark.createDataFrame([(1, "a", "Allow", None), (1, "b", "Allow", None), (2, "b", "Block", "no"), (3, "a", "Block", "pii"), (3, "b", "Allow", None)],
                                     "doc_id int, step string, action string, reason string")
    got = {x.doc_id: (x.should_continue, x.stopped_by, x.error_message) for x in op.guard_verdict(docs, steps, verdicts).collect()}
    assert got == {1: (True, None, None), 2: (False, "a", "Pipeline component returned empty response."), 3: (False, "a", "pii")}


def test_page_segments(spark):
    df = spark.createDataFrame([(1, "intro\n--- Page 3 ---\nx\n--- Page 4 ---\n \n"), (2, " none ")], "doc_id int, text string")
    got = [(x.doc_id, x.page_number, x.content) for x in sg.page_segments(df).orderBy("doc_id", "segment_no").collect()]
    assert got == [(1, None, "intro"), (1, 3, "x"), (2, None, " none ")]


def test_blank_documents_do_not_use_up_the_budget(spark):
    """Expected text from a literal loop over the documents."""
    rows = [(1, i, f"T{i}", "txt", "" if i < 12 else "ab" * (i - 10)) for i in range(15)] + [(1, 5000, "T", "txt", "late")]
    documents = spark.createDataFrame(rows, "query_id long, doc_id long, title string, document_type string, text string")
    got = cx._document_pieces(documents, 7, F.lit("<"), ">").orderBy("doc_id").collect()
    used, expected = 0, []
    for _, doc, _, _, body in rows:
        if used < 7:
            expected.append((doc, f"<{body[:7 - used]}>"))
        used += len(body)
    assert [(r["doc_id"], r["piece"]) for r in got] == expected


def test_a_seventh_extractor_answers(spark):
    """Registered from outside: eligibility, priority and answers, without a change to the built-in ones."""
    def answers(basis):
        sheets = basis.sheets.groupBy("doc_set_id").agg(F.count(F.lit(1)).alias("sheets"))
        asked = basis.eligible.where(F.col("extractor") == "SheetCounter").join(sheets, "doc_set_id").join(basis.totals, "doc_set_id")
        return an.answer_rows(asked, "SheetCounter", value=F.col("sheets").cast("string"), method="Count(sheets)")

    text = "--- Sheet: A ---\n| Site | Cost |\n| x | 1 |\n| y | 2 |\n--- Sheet: B ---\n| Site | Cost |\n| z | 3 |\n"
    texts = spark.createDataFrame([(1, 10, "Excel", text)], "doc_set_id int, doc_id int, document_type string, text string")
    queries = spark.createDataFrame([(1, 1, "How many sheets? number of rows"), (2, 1, "number of rows"), (3, 1, "sum of cost")], "query_id int, doc_set_id int, query_text string")
    plain = {x.query_id: (x.value, x.extractor_name) for x in an.exact_answers(queries, texts).collect()}
    assert plain == {1: ("3", "GenericColumn"), 2: ("3", "GenericColumn"), 3: ("6", "GenericColumn")}
    an.register_extractor(an.Extractor("SheetCounter", "1.0", 2000, an.serves(["Count"], ["sheets"]), answers, needs_column=False))
    try:
        got = {x.query_id: (x.value, x.extractor_name, x.candidate_count) for x in an.exact_answers(queries, texts).collect()}
    finally:
        an.unregister_extractor("SheetCounter")
    assert got == {1: ("2", "SheetCounter", 2), 2: ("3", "GenericColumn", 1), 3: ("6", "GenericColumn", 1)}


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_buckets_of_a_hot_group_keep_the_order(spark, ids):
    rnd = random.Random(4)
    make = (lambda n: n) if ids == "bigint" else (lambda n: f"k{n * 7919 % 5000:05d}")
    rows = [(1, make(i), rnd.randrange(9)) for i in range(3000)] + [(2, make(i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, f"g int, o {ids}, n int").repartition(3)
    placed = ranking.order_buckets(df, ["g"], "o", 100)
    sizes = [x["count"] for x in placed.where("g = 1").groupBy("_bucket").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 400 and placed.where("g = 2").select("_bucket").distinct().count() == 1
    ranked = ranking.bucketed_rank(placed, ["g"], {"_b": F.col("_bucket")}, [F.col("o")])
    want = {}
    for g in (1, 2):
        for i, o in enumerate(sorted(r[1] for r in rows if r[0] == g), 1):
            want[(g, o)] = i
    assert {(x.g, x.o): x.position for x in ranked.collect()} == want
    running = ranking.exclusive_running(placed, ["g"], F.col("_bucket"), "o", {"before": F.col("n")}, {})
    total = {}
    for g, o, n in sorted(rows):
        total[(g, o)] = total.get(("sum", g), 0)
        total[("sum", g)] = total.get(("sum", g), 0) + n
    assert all(x.before == total[(x.g, x.o)] for x in running.collect())


def test_parts_join_to_the_whole(spark):
    pieces = [(1, i, "x" * (i % 7) + f"{i}\n") for i in range(200)] + [(1, 300, "y" * 90), (1, 301, "end"), (2, 0, "one")]
    df = spark.createDataFrame(pieces, "k int, o int, piece string").repartition(4)
    parts = ranking.text_parts(df, ["k"], "o", "piece", 40).orderBy("k", "part_no").collect()
    for k in (1, 2):
        mine = [p for p in parts if p.k == k]
        assert [p.part_no for p in mine] == list(range(len(mine))) and "".join(p.text for p in mine) == "".join(p for g, _, p in pieces if g == k)
        assert all(len(p.text) < 40 + 90 for p in mine)


def test_sheet_parts_join_to_the_rendered_sheet(spark):
    cells = spark.createDataFrame([(1, 1, "S", r, c, f"v{r}{c}") for r in range(1, 40) for c in (1, 2)], "doc_id int, sheet_no int, sheet_name string, row_no int, col_no int, value string")
    merged = spark.createDataFrame([], "doc_id int, sheet_no int, r1 int, c1 int, r2 int, c2 int")
    whole = ly.sheet_render(cells, merged).first().text
    parts = ly.sheet_parts(cells, merged, 100).orderBy("part_no").collect()
    assert len(parts) > 3 and "".join(p.text for p in parts) == whole


def test_missing_titles_lose_no_text(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "aaa"), (2, 2, 0, "bbb"), (3, 2, 1, "ccc")], "chunk_id int, doc_id int, chunk_index int, content string")
    sizes = spark.createDataFrame([(1, 1, 1, 0, None, None, 3), (1, 2, 2, 0, "T", None, 3), (1, 3, 2, 1, "T", None, 3)],
                                  "query_id int, chunk_id int, doc_id int, chunk_index int, title string, file_name string, body_chars int")
    got = cx.ordered_context(cx.ordered_chunks(sizes, 500), chunks).first()
    assert got.chunks_sent == 3 and got.context == "--- Dokument:  (Fil: ) ---\naaa\n\n--- Dokument: T (Fil: ) ---\nbbb\n\nccc"
    found = spark.createDataFrame([(1, 5, 0.9, None, None, None, None, 0, "text")],
                                  "query_id int, chunk_id int, score double, title string, file_name string, page_number int, heading string, chunk_index int, content string")
    assert "text" in cx.ranked_context(found).first().context
    late = spark.createDataFrame([(1, f"d{i:03d}", None, "Txt", "x" * 10) for i in range(30)], "query_id int, doc_id string, title string, document_type string, text string")
    queries = spark.createDataFrame([(1, "q")], "query_id int, query_text string")
    assert cx.direct_context(queries, late).first().prompt.count("x" * 10) == 30
