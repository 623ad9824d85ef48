"""Work on lines, words and texts is dealt to tasks by its size, with the rows it had before."""

from pyspark.sql import functions as F

from foliant.operators import layout as ly, tables as tb

TEXTS = "doc_set_id bigint, doc_id bigint, document_type string, text string"


def parts_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_lines_of_one_set_are_taken_apart_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tb, "TASK_LINES", 20, raising=False)
    csv = [(1, d, "Csv", "a;b;c\n" * (d == 0) + "".join(f"{d};{i};\"x;{i}\"\n" for i in range(10))) for d in range(40)]
    piped = [(2, d, "Excel", f"--- Sheet: S{d} ---\n| a | b |\n| --- | --- |\n" + "".join(f"| {d} | {i} | more |\n" for i in range(10))) for d in range(40)]
    rows = tb.load_tables(spark.createDataFrame(csv + piped, TEXTS)).where("not is_header")
    got = rows.groupBy("doc_set_id").agg(F.count(F.lit(1)), F.collect_set(F.size("cells"))).collect()
    assert sorted(map(tuple, got)) == [(1, 400, [3]), (2, 400, [2])]
    for one in (1, 2):
        assert parts_with_rows(rows.where(F.col("doc_set_id") == one)) >= 10


def test_padding_reads_a_line_once(spark):
    df = spark.createDataFrame([(["x", None],), ([],), (None,), (["a", "b", "c", "d"],)], "cells array<string>")
    padded = df.select(tb.pad_or_trim(F.col("cells"), F.lit(3)).alias("c"))
    assert [r.c for r in padded.collect()] == [["x", "", ""], ["", "", ""], ["", "", ""], ["a", "b", "c"]]
    parsed = df.select(tb.pad_or_trim(tb.split_row(F.concat(F.lit("| "), F.col("cells")[0], F.lit(" |"))), F.lit(3)).alias("c"))
    plan = parsed._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and "sequence(" not in plan


def test_words_move_once_on_their_way_to_lines(spark, monkeypatch):
    monkeypatch.setattr(ly, "TASK_WORDS", 50, raising=False)
    words = spark.createDataFrame([(d, p, f"w{i}", float(i % 3 * 40), float(i % 3 * 40 + 15), 800.0 - i // 3 * 12 + i % 3 * 0.5 - 0.5)
                                   for d in range(6) for p in range(3) for i in range(30)],
                                  "doc_id bigint, page int, word string, left_x double, right_x double, bottom double")
    lines = ly.line_render(words)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = lines.where("doc_id = 4 and page = 2").orderBy("line_no").collect()
    assert [x.line for x in got] == [f"w{3 * i} | w{3 * i + 1} | w{3 * i + 2}" for i in range(10)]
    assert lines.count() == 180 and parts_with_rows(lines) > 4
    heights = ly.words_to_lines(words)
    assert heights.count() == 6 * 3 * 30 and parts_with_rows(heights) > 4
