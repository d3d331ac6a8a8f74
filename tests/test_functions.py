import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import loose_json as J
from pagewright.functions import text as T


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr(F.col("x"))).collect()]


def test_table_count(spark):
    rows = ["| a |\n\n| b |", "| a |\n| b |\n\n| c |\n| d |", "| a |\n| b |\ntext\n| c |\n| d |", "| a |", "x\r\n| a |\r\n| b |\r\n", " | a |\n | b |", "| a | \n| b |\n", None]
    assert values(spark, rows, T.table_count) == [1, 1, 2, 0, 1, 0, 1, 0]


def test_white_space_is_unicode(spark):
    assert values(spark, ["a 　b ", None], T.compact) == ["a b", None]


def test_byte_estimate_rounds_half_to_even(spark):
    assert values(spark, ["xx", "x" * 6, "x" * 10], T.base64_bytes) == [2, 4, 8]


def test_short_hash(spark):
    assert values(spark, ["iVBORw0KGgo="], T.short_hash) == ["2808447b"]


def test_render_scale(spark):
    rows = [float("nan"), float("inf"), 0.0, -1.0, 2.5, 5.0, None]
    assert values(spark, rows, G.render_scale, "x double") == [2.0, 2.0, 2.0, 2.0, 2.5, 3.0, 2.0]


def test_page_sized(spark):
    boxes = [(0.0, 100.0, 0.0, 82.0), (3.0, 97.0, 3.0, 97.0), (0.0, 65.0, 0.0, 100.0)]
    df = spark.createDataFrame([(b,) for b in boxes], "x struct<l: double, r: double, t: double, b: double>")
    assert [r[0] for r in df.select(G.is_page_sized(F.col("x"), F.lit(100.0), F.lit(100.0))).collect()] == [True, True, False]


def test_file_size_label(spark):
    assert values(spark, [0, 1023, 1536, 5 * 1024 * 1024], T.file_size_label, "x bigint") == ["0 B", "1023 B", "1.5 KB", "5.0 MB"]


def test_item_type_and_page_from_path(spark):
    assert values(spark, ["Table", "picture", "paragraph"], T.item_type) == ["table", "figure", "text"]
    assert values(spark, ["local.page[12]", "pages.3.x", "none"], T.page_from_path) == [12, 3, None]


def test_repaired_json():
    assert J.repaired_json('{"a":"hel') == '{"a":"hel"}'
    assert J.repaired_json('{"a":["x","y') == '{"a":["x","y"]}'
    assert J.repaired_json('{"a":{"b":1}') == '{"a":{"b":1}}'
    assert [J.repaired_json(x) for x in ('{"a":1,', '{"a":1,"b', '{"a":1,"b":', '{"a":"x\\')] == [None] * 4


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=5), st.lists(st.text(max_size=6), max_size=3), max_size=3))
def test_repair_leaves_whole_json_alone(value):
    text = json.dumps(value)
    assert J.repaired_json(text) == text


def test_parsed_status(spark):
    rows = [(1, '{"a": 1}'), (2, '```json\n{"a": 1}\n```'), (3, 'Here it is: {"a": 1} Bye'), (4, '{"a": "b'), (5, ""), (6, None), (7, "no json")]
    out = {r.id: r.status for r in J.parsed(spark.createDataFrame(rows, "id bigint, v string"), "id", "v").collect()}
    assert out == {1: "valid", 2: "fenced", 3: "fenced", 4: "repaired", 5: "empty", 6: "empty", 7: "error"}


def test_description_defaults_and_block(spark):
    text = json.dumps({"visualDescription": " A plot ", "importantVisualElements": ["x", " "], "visibleTextNotInOcr": None})
    df = spark.createDataFrame([(text,), ("{cut",)], "x string").select(J.description(F.col("x")).alias("d"))
    rows = df.select("d.visual_type", "d.confidence", J.markdown_block(F.col("d"))).where("visual_type IS NOT NULL").collect()
    assert [tuple(r) for r in rows] == [("mixed", "medium", "### Visual Explanation\n\nA plot\n\nImportant visual elements:\n- x")]
