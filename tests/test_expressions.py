"""Worked examples of single expressions."""

from pyspark.sql import functions as F

from foliant import vocab
from foliant.functions import columns, intents, kinds, numbers, text, vectors


def values(spark, items, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_bandwidth(spark):
    cells = ["1G", "100M", "10G", "500", "10Gbps", "64k", "", "x", "1,5G", " 2 T "]
    assert values(spark, cells, numbers.parse_bandwidth) == [1000.0, 100.0, 10000.0, 500.0, None, 0.064, None, None, 15000.0, 2000000.0]


def test_numbers(spark):
    cells = ["1,234", "1,234.5", "1,234,567", "1.234,5", "10Gbps", "5 000", "(12)", "7-", "+3", "1e3", "5d", "k", "", "NaN", "1,2.3,4", "12k"]
    assert values(spark, cells, numbers.parse_numeric) == [1.234, 1234.5, 1234567.0, None, 10.0, 5000.0, -12.0, -7.0, 3.0, 1000.0, None,
                                                           None, None, None, 12.34, None]


def test_format_result(spark):
    cells = [3.0, 1.005, 0.125, -2.5, 0.005, 1234567.891, 0.999, -0.001]
    assert values(spark, cells, numbers.format_result, "double") == ["3", "1.00", "0.13", "-2.50", "0.01", "1234567.89", "1.00", "-0.00"]


def test_column_concepts(spark):
    assert values(spark, ["VLAN_ID", "Bandwidth", "UnknownCol"], columns.canonical_column) == ["VLAN", "BANDWIDTH", "UnknownCol"]
    seen = {}
    for concept, aliases in vocab.COLUMN_ALIASES:
        for alias in aliases:
            assert seen.setdefault(columns.flatten(alias), concept) == concept  # no alias has two concepts


def test_intents(spark):
    asked = ["Hur många portar har FG-60F?", "what does X mean", "Hur många unika vlan", "list all models", "hela tabellen", "total bandwidth",
             "gruppera per site", "jämför A", "summera", "hej"]
    assert values(spark, asked, intents.classify_intent) == [
        "SpecificLookup", "Average", "DistinctCount", "Enumeration", "TableEnumeration", "Sum", "Aggregation", "Comparison", "Summary", "SpecificLookup"]


def test_identifiers_and_codes(spark):
    ids = values(spark, ["FNT002400 ABC12345 FNT-002400 10.255.1.10 fnt1 FNT002400"], text.identifiers)[0]
    assert ids == ["FNT002400", "ABC12345", "FNT-002400", "10.255.1.10"]
    codes = values(spark, ["FG-120G, FG/FWF-30G, SW-200F, AP-430F, FGT-1000D, WF-100, ABC-1234X-5"], text.model_codes)[0]
    assert codes == ["FG-120G", "FG/FWF-30G", "SW-200F", "AP-430F", "FGT-1000D", "WF-100", "ABC-1234X-5"]


def test_cleaning(spark):
    assert values(spark, ["10Gbps", "a1b2c", "  "], text.cleanup_page_artifacts) == ["10 Gbps", "a1 b2 c", "  "]
    assert values(spark, ["x\r\n\n\n\ny\tz\n      q   w"], text.normalize_text) == ["x\n\ny z\n  q w"]
    assert values(spark, ["FG-120 G FWF-60 F FG/FWF-30  G fg-1 G"], text.join_model_suffix) == ["FG-120G FWF-60F FG/FWF-30G fg-1 G"]


def test_headings(spark):
    asked = ["\n1.2 Intro\nx", "KAPITEL Å", "Label:\n", "GROß", "plain", "   \nX", "1234", "A" * 81, "1." + "x" * 110]
    assert values(spark, asked, text.detect_heading) == ["1.2 Intro", "KAPITEL Å", "Label", "GROß", None, None, None, None, ("1." + "x" * 110)[:100]]


def test_titles_and_previews(spark):
    assert values(spark, [" ", "a\r\nb", "x" * 50], text.conversation_title) == ["Ny chatt", "a  b", "x" * 42 + "..."]
    assert values(spark, ["ab\ncd\r", "abcdef", " "], lambda c: text.preview(c, 5)) == ["ab cd", "abcde…", ""]
    assert values(spark, ["", "abc", "abcde"], text.token_estimate) == [0, 1, 2]


def test_items(spark):
    answer = "- a\n* b\n• c\n| x |\n1. d\n 2) e\n3.f\nplain"
    assert values(spark, [answer], text.count_response_items) == [6]
    assert values(spark, ["| h |\n|---|:-:|\n| 1 |\nx\n|a| b"], text.count_source_rows) == [2]


def test_kinds(spark):
    df = spark.createDataFrame([(".JSON", None), (".xls", None), ("", "TEXT/csv"), (".bin", "application/x")], "e string, m string")
    assert [r[0] for r in df.select(kinds.route_document_type("e", "m")).collect()] == ["Code", "Excel", "Csv", "Unknown"]
    assert [r[0] for r in df.select(kinds.route_file_type("e", "m")).collect()] == ["Document", "Document", "Document", "Other"]


def test_cosine_paths_agree(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], []), ([3.0, 4.0], [3.0, 4.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    one = [round(r[0], 9) for r in df.select(vectors.cosine_similarity("a", "b")).collect()]
    two = [round(r[0], 9) for r in df.select(vectors.cosine_from(vectors.dot("a", "b"), vectors.norm("a"), vectors.norm("b"))).collect()]
    assert one == [0.707106781, 0.0, 0.0, 0.0, 1.0]
    assert two == one
