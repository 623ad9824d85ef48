"""Questions that share a scope get what each would get alone."""

import re
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import vectors as vec
from foliant.operators import context as cx, coverage as cv, retrieval as r, row_answers as ra, strategy as st
from foliant.options import DEFAULTS
from foliant.plans import blocks, scopes

DOCS = "doc_id bigint, title string, status string, document_type string, processing_stage string, progress_current int, progress_total int, extracted_text string"


def links():
    """Questions 0 to 11 over sets 0 to 2; question 5 has two sets, question 6 one of them twice."""
    return [(q, q % 3) for q in range(12)] + [(5, 1), (6, 0)]


def rows(df):
    return sorted(tuple(str(v) for v in x) for x in df.select(*sorted(df.columns)).collect())


def both(spark, monkeypatch):
    """(scope of every question, asked and None), (scope of every set, asked)."""
    monkeypatch.setattr(scopes, "BLOCK_QUESTIONS", 2)
    monkeypatch.setattr(scopes, "BLOCK_ROWS", 3)
    monkeypatch.setattr(scopes, "TASK_PAIRS", 4)
    asking = spark.createDataFrame(links(), "query_id bigint, set_no bigint")
    inside = spark.createDataFrame([(s, d) for s in range(3) for d in range(9) if d % 3 == s or d == 4], "set_no bigint, doc_id bigint")
    asked, sets = scopes.shared_scopes(asking, "set_no")
    alone = asking.join(inside, "set_no").select("query_id", "doc_id").distinct()
    return alone, sets.join(inside, "set_no").select("query_id", "doc_id").distinct(), asked


def test_scopes_are_named_by_their_sets(spark):
    asked, sets = scopes.shared_scopes(spark.createDataFrame([*links(), (None, 2), (77, None)], "query_id bigint, set_no bigint"), "set_no")
    got = {x.query_id: x.scope_id for x in asked.collect()}
    assert got[5] == "[1,2]" and got[6] == "[0]" and got[None] == got[2] == "[2]" and 77 not in got
    assert sorted((x.query_id, x.set_no) for x in sets.collect()) == [("[0]", 0), ("[1,2]", 1), ("[1,2]", 2), ("[1]", 1), ("[2]", 2)]


def test_rows_of_a_scope_go_to_its_questions(spark, monkeypatch):
    alone, shared, asked = both(spark, monkeypatch)
    assert rows(scopes.to_questions(shared, asked)) == rows(alone)
    queries = spark.createDataFrame([(q, f"t{q}") for q in [*range(12), 3, 99]], "query_id bigint, query_text string")
    counts = lambda df: df.groupBy("query_id").count()
    for how in ("inner", "left"):
        assert rows(scopes.per_question(queries, counts(shared), asked, how)) == rows(queries.join(counts(alone), "query_id", how))


def test_contexts_and_guards_by_scope(spark, monkeypatch):
    alone, shared, asked = both(spark, monkeypatch)
    queries = spark.createDataFrame([(q, f"t{q}", "ListModels" if q % 2 else "Other") for q in [*range(12), 99]], "query_id bigint, query_text string, intent string")
    docs = spark.createDataFrame([(d, f"D{d}", "Queued" if d == 3 else "Ready", "Excel" if d % 2 else "Txt", None, d, 9, f"FG-{d}00A {'x' * d * 900}") for d in range(9)], DOCS)
    files = spark.createDataFrame([], "file_id bigint, original_file_name string")
    chunks = spark.createDataFrame([(d * 2 + k, d, k, f"| FG-{d}{k}0A | {'y' * 700} |") for d in range(9) for k in range(2)], "chunk_id bigint, doc_id bigint, chunk_index int, content string")
    named = docs.withColumn("file_id", docs.doc_id)
    assert rows(st.processing_guard(queries, shared, docs, asked)) == rows(st.processing_guard(queries, alone, docs))
    none = queries.select("query_id").limit(0)
    assert rows(st.choose_strategy(queries, shared, docs, none, asked=asked)) == rows(st.choose_strategy(queries, alone, docs, none))
    texts = st.document_texts(docs)
    for build in (cx.direct_context, cx.enumeration_context):
        assert rows(build(queries, st.ready_sizes(shared, docs), texts=texts, asked=asked)) == rows(build(queries, st.ready_sizes(alone, docs), texts=texts))
    one, many = (r.full_document_sizes(x, named, chunks, files) for x in (alone, shared))
    assert rows(scopes.to_questions(cx.batch_split(many), asked)) == rows(cx.batch_split(one))
    a, b = (cx.ordered_chunks(x, 3000) for x in (one, many))
    assert rows(cv.context_coverage(many, b, cx.ordered_context(b, chunks), asked)) == rows(cv.context_coverage(one, a, cx.ordered_context(a, chunks)))
    a, b = (cx.batch_context(cx.batch_split(x), x, chunks) for x in (one, many))
    assert rows(cx.extraction_requests(queries, b, asked=asked)) == rows(cx.extraction_requests(queries, a))


def test_retrieval_by_scope(spark, monkeypatch):
    alone, shared, asked = both(spark, monkeypatch)
    for name, value in {"BLOCK_POINTS": 8, "BLOCK_QUESTIONS": 3, "PRUNE_PAIRS": 20}.items():
        monkeypatch.setattr(blocks, name, value)
    rnd = np.random.default_rng(5)
    vector = lambda: [float(x) for x in rnd.standard_normal(4).astype(np.float32)]
    docs = spark.createDataFrame([(d, "Queued" if d == 8 else "Ready") for d in range(9)], "doc_id bigint, status string")
    chunks = spark.createDataFrame([(c, c % 9, c // 9, 1, f"fnt00{c % 4}1 and 10.0.0.{c % 5} x") for c in range(54)],
                                   "chunk_id bigint, doc_id bigint, chunk_index int, page_number int, content string")
    vectors = spark.createDataFrame([(c, "" if c % 5 == 0 else "acme", "m", vector()) for c in range(54)], "chunk_id bigint, provider string, model string, vector array<float>")
    asking = spark.createDataFrame([(q, "acme", "m", vector()) for q in range(12)], "query_id bigint, provider string, model string, query_vector array<float>")
    queries = spark.createDataFrame([(q, f"FNT00{q % 4}1 or fnt0021 FNT0001, 10.0.0.{q % 5}") for q in range(12)], "query_id bigint, query_text string")
    for found in (lambda s, a: r.keyword_search(queries, s, docs, chunks, asked=a), lambda s, a: r.embedding_candidates(s, docs, chunks, vectors, asking, a),
                  lambda s, a: r.exact_scan(s, docs, chunks, vectors, asking, asked=a),
                  lambda s, a: r.search_fallback(spark.createDataFrame([(1, 4, 4, .9)], "query_id bigint, chunk_id bigint, doc_id bigint, score double"),
                                                 r.keyword_search(queries, s, docs, chunks, asked=a), s, docs, chunks, vectors, asking, asked=a)):
        assert rows(found(shared, asked)) == rows(found(alone, None)) != []
    hits = {(q, c) for q in range(12) for c in range(54) if (q, c % 9) in {(x.query_id, x.doc_id) for x in alone.collect()} and c % 9 != 8
            and (c % 4 in (q % 4, 0) or c % 5 == q % 5)}
    assert sorted((x.query_id, x.chunk_id) for x in r.keyword_search(queries, shared, docs, chunks, asked=asked).collect()) == sorted(hits)


def pairs_and_hits(spark):
    """Documents, chunks, vectors (two spaces, one without length, one infinite, one chunk twice), question vectors and keyword hits."""
    rnd = np.random.default_rng(8)
    vector = lambda: [float(x) for x in rnd.standard_normal(4).astype(np.float32)]
    docs = spark.createDataFrame([(d, "Queued" if d == 8 else "Ready") for d in range(9)], "doc_id bigint, status string")
    chunks = spark.createDataFrame([(c, c % 9, None if c == 20 else c // 9, 1) for c in [*range(54), 13]], "chunk_id bigint, doc_id bigint, chunk_index int, page_number int")
    vectors = spark.createDataFrame([(c, "" if c % 5 == 0 else "acme", "m", [0.0] * 4 if c == 4 else [float("inf")] * 4 if c == 9 else vector()) for c in range(54)],
                                    "chunk_id bigint, provider string, model string, vector array<float>")
    asking = spark.createDataFrame([(q, p, "m", vector()) for q in range(12) for p in (("acme", "other") if q == 4 else ("other",) if q == 3 else ("acme",))],
                                   "query_id bigint, provider string, model string, query_vector array<float>")
    hits = spark.createDataFrame([(q, c, c % 9) for q in range(12) for c in range(54) if (q + c) % 7 == 0] + [(1, 13, 5), (1, 22, 4), (1, 22, 3), (2, None, 1), (None, 2, 2), (77, 2, 2)],
                                 "query_id int, chunk_id int, doc_id int")
    return docs, chunks, vectors, asking, hits


def test_keyword_hits_meet_pairs_where_they_are_made(spark):
    docs, chunks, vectors, asking, hits = pairs_and_hits(spark)
    asked, sets = scopes.shared_scopes(spark.createDataFrame(links(), "query_id bigint, set_no bigint"), "set_no")
    shared = sets.join(docs.selectExpr("doc_id", "doc_id % 3 AS set_no"), "set_no").select("query_id", "doc_id")
    marked = r.keyword_boost(r.exact_scan(shared, docs, chunks, vectors, asking, asked=asked, marks=hits))
    got = rows(marked)
    assert got == rows(r.keyword_boost(r.exact_scan(shared, docs, chunks, vectors, asking, asked=asked), hits)) != []
    assert marked.columns == r.RANKING and sum(x[-1] == "0.92" for x in got) > 9
    assert "Join" not in marked._jdf.queryExecution().sparkPlan().toString().split("FlatMapCoGroups")[0]


def test_a_wide_sample_without_all_pairs(spark):
    docs, chunks, vectors, asking, _ = pairs_and_hits(spark)
    chunks = chunks.dropDuplicates(["chunk_id"])
    asked, sets = scopes.shared_scopes(spark.createDataFrame(links(), "query_id bigint, set_no bigint"), "set_no")
    shared = sets.join(docs.selectExpr("doc_id", "doc_id % 3 AS set_no"), "set_no").select("query_id", "doc_id")
    options = replace(DEFAULTS, min_score=0.1)
    scan = r.wide_scan(shared, docs, chunks, vectors, asking, 6, options, asked)
    assert rows(r.document_wide_sample(scan, 6, options)) == rows(r.document_wide_sample(r.exact_scan(shared, docs, chunks, vectors, asking, asked=asked), 6, options)) != []
    assert scan.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 6 + 3


def test_thresholds_and_pages_without_all_pairs(spark):
    docs, chunks, vectors, asking, _ = pairs_and_hits(spark)
    chunks = chunks.dropDuplicates(["chunk_id"])
    asked, sets = scopes.shared_scopes(spark.createDataFrame(links(), "query_id bigint, set_no bigint"), "set_no")
    shared = sets.join(docs.selectExpr("doc_id", "doc_id % 3 AS set_no"), "set_no").select("query_id", "doc_id")
    every = r.exact_scan(shared, docs, chunks, vectors, asking, asked=asked).localCheckpoint()
    for least in (0.4, 0.99):
        options = replace(DEFAULTS, min_score=least)
        scan = r.threshold_scan(shared, docs, chunks, vectors, asking, options, asked)
        assert rows(r.threshold_or_top(scan, options)) == rows(r.threshold_or_top(every, options)) != []
        assert scan.where("not best").count() < every.count()
    # two of three pages hold most chunks: the first rows do not settle every question
    for top, per_page in ((2, 3), (3, 1), (40, 1)):
        scan = r.page_scan(shared, docs, chunks, vectors, asking, top, per_page, asked)
        assert rows(r.page_diversity(scan, top, per_page)) == rows(r.page_diversity(every, top, per_page)) != []
        assert scan.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= (8 if top == 2 else 96)


def test_pages_that_crowd_the_best_rows_are_asked_again(spark):
    docs = spark.createDataFrame([(d, "Ready") for d in range(3)], "doc_id bigint, status string")
    chunks = spark.createDataFrame([(c, 0 if c < 30 else 1 + c % 2, c, 1) for c in range(40)], "chunk_id bigint, doc_id bigint, chunk_index int, page_number int")
    vectors = spark.createDataFrame([(c, "acme", "m", [1.0, c / 40]) for c in range(40)], "chunk_id bigint, provider string, model string, vector array<float>")
    asking = spark.createDataFrame([(q, "acme", "m", [1.0, 0.0]) for q in range(2)], "query_id bigint, provider string, model string, query_vector array<float>")
    shared = spark.createDataFrame([(q, d) for q in range(2) for d in range(3)], "query_id bigint, doc_id bigint")
    best = r.page_diversity(r.page_scan(shared, docs, chunks, vectors, asking, 2, 1), 2, 1)
    assert sorted((x.query_id, x.chunk_id) for x in best.collect()) == [(0, 0), (0, 30), (1, 0), (1, 30)]


def cosine_by_hand(a, b):
    """Products in float, added in double one after the other."""
    def added(x, y):
        total = 0.0
        for m, n in zip(x, y, strict=True):
            total += float(np.float32(m) * np.float32(n))
        return total
    if a is None or b is None or len(a) != len(b) or not a or None in a or None in b or added(a, a) <= 0 or added(b, b) <= 0:
        return 0.0
    return added(a, b) / (np.sqrt(added(a, a)) * np.sqrt(added(b, b)))


def test_cosines_of_all_pairs_come_from_blocks(spark, monkeypatch):
    for name, value in {"BLOCK_MANY": 3, "BLOCK_ROWS": 4, "TASK_PAIRS": 16}.items():
        monkeypatch.setattr(scopes, name, value)
    monkeypatch.setattr(vec, "PAIRS", 5)
    rnd = np.random.default_rng(3)
    vector = lambda n=7: [float(x) for x in rnd.standard_normal(n).astype(np.float32)]
    odd = [None, [], [0.0] * 7, [1.0, None, *[2.0] * 5], vector(3)]
    asking = [(q, q % 3, odd[q] if q < 5 else vector()) for q in range(20)] + [(6, 1, vector()), (7, None, vector())]
    stored = [(p % 4, p, odd[p] if p < 5 else vector()) for p in range(25)] + [(2, None, vector()), (None, 99, vector())]
    found = scopes.pair_cosines(spark.createDataFrame(asking, "query_id bigint, scope_id bigint, query_vector array<float>"),
                                spark.createDataFrame(stored, "query_id bigint, vec_id bigint, embedding array<float>"), "query_vector", "embedding")
    want = sorted((str(q), str(p), str(cosine_by_hand(v, w))) for q, s, v in asking for t, p, w in stored if s is not None and s == t)
    assert sorted((str(x.query_id), str(x.vec_id), str(x.score)) for x in found.collect()) == want
    pairs = spark.createDataFrame([(v, w) for _, _, v in asking for _, _, w in stored], "v array<float>, w array<float>")
    assert [x[0] for x in pairs.select(vec.cosine_similarity("v", "w")).collect()] == [cosine_by_hand(v, w) for _, _, v in asking for _, _, w in stored]


def test_rows_that_meet_conditions_are_given_to_their_questions(spark, monkeypatch):
    for name, value in {"BLOCK_MANY": 2, "BLOCK_ROWS": 3, "TASK_PAIRS": 4}.items():
        monkeypatch.setattr(scopes, name, value)
    queries = spark.createDataFrame([(q, q % 2, f"rows with vlan above {q % 3 * 10}") for q in range(9)] + [(9, 0, "rows where status is open"), (3, 1, "vlan under 5")],
                                    "query_id bigint, doc_set_id bigint, query_text string")
    cells = [(s, 1, "S", d, r, False, ["Vlan", "Status"], [str(r * 7), "Open " if r % 2 else ""]) for s in range(2) for d in range(2) for r in range(1, 6)]
    read = spark.createDataFrame(cells + cells[:1] + [(0, 1, "S", 0, 0, True, ["Vlan", "Status"], ["Vlan", "Status"])],
                                 "doc_set_id bigint, sheet_no bigint, sheet_name string, doc_id bigint, row_no int, is_header boolean, columns array<string>, cells array<string>")
    headers = spark.createDataFrame([(s, 1, 10, c, n) for s in range(2) for c, n in enumerate(["Vlan", "Status"])], "doc_set_id bigint, sheet_no bigint, n_rows bigint, col_no int, col_name string")
    got = ra.filtered_rows(queries, read, headers, shown=F.array_join("cells", "/"))
    want = [(q, q % 2, d, r, c[0] + "/" + c[1]) for q in range(9) for s, _, _, d, r, _, _, c in cells + cells[:1] if s == q % 2 and int(c[0]) > q % 3 * 10]
    want += [(9, 0, d, r, c[0] + "/" + c[1]) for s, _, _, d, r, _, _, c in cells + cells[:1] if s == 0 and r % 2]
    assert sorted((x.query_id, x.doc_set_id, x.doc_id, x.row_no, x.row) for x in got.collect()) == sorted(want)
    assert sorted((x.query_id, x.doc_id, x.row_no) for x in ra.filtered_rows(queries, read, headers).collect()) == sorted((q, d, r) for q, _, d, r, _ in want)


def test_keyword_hits_that_cannot_be_chosen_stay_away(spark):
    rnd = np.random.default_rng(6)
    options = replace(DEFAULTS, top_k=4, fallback_rows=2, max_per_page=2, min_score=0.1)
    docs = spark.createDataFrame([(d, "Ready") for d in range(12)], "doc_id bigint, status string")
    # crowded and thin pages; half the chunks have each identifier
    where = [(c, c % 3 if c < 40 else c % 12, int(rnd.integers(0, 3)) or None) for c in range(90)]
    chunks = spark.createDataFrame([(c, d, c, p, " ".join(["fnt0001"] * int(rnd.integers(0, 2)) + ["fnt0002"] * (c % 20 == 0) + ["fnt0003"] * (c % 3 == 0 and c < 40))) for c, d, p in where],
                                   "chunk_id bigint, doc_id bigint, chunk_index int, page_number int, content string")
    texts = ["FNT0001", "FNT0002", "FNT0003 FNT0002", "FNT0001 FNT0003", "FNT0003", "nothing"]
    queries = spark.createDataFrame([(q, texts[q % 6]) for q in range(24)], "query_id bigint, query_text string")
    scope = spark.createDataFrame([(q, d) for q in range(24) for d in range(12) if d < 3 or (q + d) % 2], "query_id bigint, doc_id bigint")
    hits = spark.createDataFrame([(q, c, where[c][1], float(rnd.choice([0.3, 0.92, 0.95, 0.05]))) for q in range(24) for c in range(90) if rnd.random() < 0.1],
                                 "query_id bigint, chunk_id bigint, doc_id bigint, score double").localCheckpoint()
    place = chunks.select("chunk_id", "page_number", "chunk_index")
    few = queries.where("query_id < 18").select("query_id")
    every, some = (r.keyword_search(queries, scope, docs, chunks, options, few=f) for f in (None, few))
    chosen = lambda found: rows(r.select_ranked(r.hybrid_merge(hits, found).join(place, "chunk_id").select(*r.RANKING), 4, options))
    assert chosen(some) == chosen(every) != []
    assert some.where("query_id < 18").count() < every.where("query_id < 18").count() / 2
    assert rows(some.where("query_id >= 18")) == rows(every.where("query_id >= 18"))


def moved(df, column):
    """Exchanges that a column goes through."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return sum(bool(re.match(r"\(\d+\) Exchange", block)) and bool(re.search(rf"\b{column}#", block)) for block in text.split("\n\n"))


def test_texts_move_once_and_not_to_their_questions(spark, monkeypatch):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(d, f"T{d}", d) for d in range(3)] + [(1, "again", None)], "doc_id bigint, title string, file_id bigint")
        files = spark.createDataFrame([(0, "f0"), (2, "f2")], "file_id bigint, original_file_name string")
        chunks = spark.createDataFrame([(c, c % 4, c, 1, "h", f"text {c}") for c in [*range(8), 5]] + [(6, 1, 6, 1, "h", "other"), (None, 1, 1, 1, "h", "x")],
                                       "chunk_id bigint, doc_id bigint, chunk_index int, page_number int, heading string, content string")
        hits = spark.createDataFrame([(q, c, 0.9, 77) for q in range(2) for c in (1, 3, 5, 6)], "query_id bigint, chunk_id bigint, score double, doc_id bigint")
        found = r.hits_to_chunks(hits, chunks, docs, files)
        # 1 and 5 in document 1, which comes twice; 3 has no document; 5 comes twice, 6 in two documents
        assert sorted((x.chunk_id, x.content, x.file_name) for x in found.where("query_id = 1").collect()) == sorted(
            [(1, "text 1", "T1"), (1, "text 1", "again"), (6, "text 6", "f2"), (6, "other", "T1"), (6, "other", "again")] + [(5, "text 5", n) for n in ("T1", "again")] * 2)
        assert moved(found, "content") == 1
        assert moved(r.retrieval_report(found), "content") == 1 == moved(cx.ranked_context(found), "content")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
