import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import loose_json as J
from pagewright.functions import text as T
from pagewright.operators import cache as C
from pagewright.operators import describe as D
from pagewright.operators import layout as L
from pagewright.operators import markdown as M
from pagewright.operators import trees
from pagewright.sources import files
from pagewright.streaming import ingest


def test_insert_descriptions(spark):
    docs = spark.createDataFrame([(1, "[Page 1]\n\nA\n\n---\n\n[Page 2]"), (2, " [Page 1] x")], "id int, text string")
    blocks = spark.createDataFrame([(1, "2", 0, "D2"), (1, "9", 0, "D9")], "id int, page_key string, ord int, block string")
    out = M.with_descriptions(M.split_sections(docs, "id", "text"), blocks, "id").orderBy("id", "pos").collect()
    assert "\n\n---\n\n".join(r.body for r in out if r.id == 1) == "[Page 1]\n\nA\n\n---\n\n[Page 2]\n\nD2\n\n---\n\n[Page 9]\n\nD9"
    assert [r.body for r in out if r.id == 2] == ["[Page 1] x"]


def test_only_the_first_section_of_a_page_claims_blocks(spark):
    docs = spark.createDataFrame([(1, "[Page 1]\n\na\n\n---\n\n[Page 1]\n\nb")], "id int, text string")
    blocks = spark.createDataFrame([(1, "1", 0, "D"), (1, "1", 1, "E")], "id int, page_key string, ord int, block string")
    out = M.with_descriptions(M.split_sections(docs, "id", "text"), blocks, "id").orderBy("pos").collect()
    assert [r.body for r in out] == ["[Page 1]\n\na\n\nD\n\nE", "[Page 1]\n\nb"]


def test_page_markdown_and_split_are_inverse(spark):
    rows = [("d", i, i, i + 1 if i else None, f" text {i} ") for i in range(5)] + [("d", 5, 5, 6, "  ")]
    df = spark.createDataFrame(rows, "doc_id string, idx int, chunk_id int, pageno int, content string")
    md = M.page_markdown(df)
    parts = M.split_sections(md, "doc_id", "markdown").orderBy("pos").collect()
    assert [p.page_key for p in parts] == ["1", "2", "3", "4", "5", "6"]
    assert parts[0].body == "[Page 1]\n\ntext 0" and parts[5].body == "[Page 6]"


def test_force_ocr(spark):
    rows = [("a", "x" * 20)] * 2 + [("a", "")] + [("b", "x" * 20)] + [("b", None)] * 2 + [("c", "y" * 12)] * 14 + [("c", " ")] * 6 + [("d", "y" * 12)] * 13 + [("d", " ")] * 7
    out = {r.doc_id: r.retry for r in M.force_ocr(spark.createDataFrame(rows, "doc_id string, content string")).collect()}
    assert out == {"a": False, "b": True, "c": False, "d": True}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 60)] * 4), min_size=1, max_size=12), st.randoms())
def test_clusters_do_not_depend_on_the_order(boxes, rnd):
    a = np.array([[min(x, y), max(x, y), min(z, w), max(z, w)] for x, y, z, w in boxes], dtype=float)
    order = list(range(len(a)))
    rnd.shuffle(order)
    one, two = L.components(a, 12), L.components(a[order], 12)
    groups = lambda label, idx: {frozenset(idx[i] for i in np.flatnonzero(label == c)) for c in set(label)}
    assert groups(one, list(range(len(a)))) == groups(two, order)


def test_a_box_bridges_two(spark):
    assert len(set(L.components(np.array([[0, 10, 0, 10], [40, 50, 0, 10], [20, 30, 0, 10]], float), 12))) == 1
    assert len(set(L.components(np.array([[0, 10, 0, 10], [22.1, 30, 0, 10]], float), 12))) == 2


def test_skip_reasons(spark):
    images = spark.createDataFrame([("d", str(i), f"f{i if i != 1 else 1}") for i in range(5)] + [("d", "1b", "f1")], "doc_id string, id string, fingerprint string")
    rows = [("d", "0", "ready", 1, 0.12), ("d", "1", "ready", 1, 0.5), ("d", "2", "ready", 0, 0.0), ("d", "3", "error", None, None)]
    out = {r.image_id: (r.skip_reasons, r.kept) for r in L.decisions(images, spark.createDataFrame(rows, "doc_id string, image_id string, status string, picture_box_count int, picture_area_ratio double")).collect()}
    assert out["0"] == ("", True)
    assert out["1"] == ("repeated 2x", False)
    assert out["2"] == ("picture boxes < 1; picture area < 12%; below vision threshold", False)
    assert out["3"] == ("load failed", False) and out["4"] == ("analyzing", False)


def test_upsert_keeps_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 10, "t0"), (2, "b", 20, "t0")], "id int, name string, size int, created string")
    new = spark.createDataFrame([(2, "B", 99, "t1"), (2, "BB", 98, "t2"), (3, "c", 30, "t1")], "id int, name string, size int, created string")
    once = C.upserted(old, new, ["id"], ["size", "created"], ["created"])
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, "a", 10, "t0"), (2, "BB", 20, "t0"), (3, "c", 30, "t1")]
    assert sorted(map(tuple, C.upserted(once, new, ["id"], ["size", "created"], ["created"]).collect())) == rows


def test_lookup_counts_add_up(spark):
    wanted = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("d", ""), ("d", None)], "doc_id string, h string")
    cache = spark.createDataFrame([("a",), ("a",), ("",)], "h string")
    assert [tuple(r) for r in C.lookup_totals(wanted, cache, "h", ["doc_id"]).collect()] == [("d", 3, 2, 1)]
    cached, missing = C.split_by_cache(wanted, cache, "h")
    assert (cached.count(), missing.count()) == (2, 3)


def test_versions(spark, tmp_path):
    C.write_version(spark.range(3), str(tmp_path))
    C.write_version(spark.range(5), str(tmp_path))
    assert C.read_version(spark, str(tmp_path)).count() == 5


def test_provider_errors_are_rows_and_retries_end():
    calls = []

    def flaky(job):
        calls.append(job)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    waits = []
    assert D.with_retry(flaky, 6, 4.0, waits.append)({}) == "ok"
    assert 4 <= waits[0] < 5 and 8 <= waits[1] < 9


def test_described(spark):
    jobs = spark.createDataFrame([("d", "1", "h"), ("d", "2", "h")], "doc_id string, image_id string, slide_hash string")

    def call(job):
        if job["image_id"] == "2":
            raise ValueError("no")
        return "{}"

    assert sorted((r.image_id, r.content, r.error) for r in D.described(jobs, call).collect()) == [("1", "{}", None), ("2", None, "no")]


def test_uploads_and_pages(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"x")
    decks, rejected = files.uploads(spark, str(tmp_path))
    assert [r.file_name for r in decks.collect()] == ["a.PDF"] and [r.file_name for r in rejected.collect()] == ["b.txt"]

    def broken(_):
        raise RuntimeError("broken")

    out = files.pages(decks, [broken, lambda b: b.decode().split("\f")]).orderBy("idx").collect()
    assert [(r.idx, r.page_number, r.text, r.warning) for r in out] == [(0, 1, "one", "broken"), (1, 2, "two", "broken")]
    assert files.pages(decks, [broken]).collect()[0].warning == "broken"


def test_upsert_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    root = str(tmp_path / "out")
    ingest.upsert_stream(ingest.arriving(spark, str(src), schema), root, ["id"], [], ["at"])
    spark.createDataFrame([(2, "c", 2)], schema).write.mode("append").parquet(str(src))
    ingest.upsert_stream(ingest.arriving(spark, str(src), schema), root, ["id"], [], ["at"])
    assert sorted(map(tuple, C.read_version(spark, root).collect())) == [(1, "a", 1), (2, "c", 2)]


def test_reading_order(spark):
    doc = {
        "body": {"children": [{"$ref": "#/texts/1"}, {"$ref": "#/groups~1x/0"}, {"$ref": "#/nowhere/9"}, {"$ref": "#/texts/1"}]},
        "groups/x": [{"prov": [{"page_no": 3}], "children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups~1x/0"}]}],
        "texts": [{"text": "a", "label": "title"}, {"orig": "b"}, {"text": "c"}], "tables": [{"text": "t"}],
    }
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "[]"), (4, "{")], "id int, j string")
    rows = [(r.id, r.ref, r.page, r.text, r.type) for r in trees.items(df, ["id"], "j").orderBy("id", "ord").collect()]
    assert [r[1] for r in rows] == ["#/texts/1", "#/groups~1x/0", "#/texts/0", "#/texts/2", "#/tables/0"]
    assert [r[2] for r in rows] == [None, 3, 3, None, None] and [r[4] for r in rows][-1] == "table" and {r[0] for r in rows} == {1}


# -- rules of the second round -------------------------------------------------------------------------------------------


def test_boxes_under_other_names_and_from_below(spark):
    rows = [('{"left": 5, "x1": 9, "top": 7, "y0": 1}',), ('{"l": 1, "r": 2, "t": 3}',), ('{"x0": 0, "right": 4, "y1": 0, "bottom": 2, "coord_origin": "topleft"}',), (None,)]
    out = [r.b for r in spark.createDataFrame(rows, "j string").select(G.box_from_json(F.col("j")).alias("b")).collect()]
    assert tuple(out[0]) == (5.0, 9.0, 7.0, 1.0, "BOTTOMLEFT") and out[1] is None and tuple(out[2]) == (0.0, 4.0, 0.0, 2.0, "TOPLEFT") and out[3] is None
    box = spark.createDataFrame([((2.0, 98.0, 97.0, 1.0, None),), ((0.0, 100.0, 0.0, 70.0, "TOPLEFT"),)], "b struct<l double, r double, t double, b double, coordOrigin string>")
    flags = box.select(G.is_page_sized(F.col("b"), F.lit(100.0), F.lit(100.0)).alias("p"), G.is_valid(F.col("b")).alias("v"), G.to_canvas(F.col("b"), F.lit(100.0), F.lit(100.0), F.lit(200.0), F.lit(200.0)).alias("c")).collect()
    assert [(r.p, r.v, r.c.y) for r in flags] == [(True, True, 6.0), (False, True, 0.0)]
    sizes = spark.createDataFrame([('{"page_size": {"width": 10, "height": "20"}}',), ('{"width": 0, "height": 3}',)], "j string").select(G.page_size_from_json(F.col("j")).alias("s")).collect()
    assert tuple(sizes[0].s) == (10.0, 20.0) and sizes[1].s is None


def test_tables_formats_and_sources(spark):
    text = "| a | b |\n|---|:-:|\n| 1 |  2   3 | 4 |\n|  |  |\nno row"
    one = spark.createDataFrame([(text, "Section_Header", "A title", "list_item", "point", " " + "QUJD" * 30, "jpg")], "t string, l string, x string, m string, y string, b string, k string")
    out = one.select(
        T.pipe_table(T.cells(F.col("t"))).alias("table"), T.formatted(F.col("l"), F.col("x")).alias("head"), T.formatted(F.col("m"), F.col("y")).alias("entry"),
        T.formatted(F.col("m"), F.lit("- x")).alias("own"), T.image_source(F.col("b"), F.col("k")).alias("uri"), T.image_source(F.lit("short"), F.col("k")).alias("none"),
    ).first()
    assert out.table == "| a | b |  |\n| --- | --- | --- |\n| 1 | 2 3 | 4 |"
    assert (out.head, out.entry, out.own, out.none) == ("## A title", "- point", "- x", "") and out.uri == "data:image/jpeg;base64," + "QUJD" * 30
    sizes = spark.createDataFrame([(0,), (900,), (1536,), (15 * 1024 + 700,), (5 << 40,)], "n bigint").select(T.file_size_label(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["0 B", "900 B", "1.5 KB", "16 KB", "5120 GB"]


def test_more_than_two_hundred_pages_are_one_document(spark):
    rows = [(k, "d", k, (k % 150) + 1 if k < 230 else None, f"text {k}") for k in range(231)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_id string, idx int, pageno int, content string")
    whole = M.page_markdown(chunks).collect()
    assert len(whole) == 1 and whole[0].markdown.count("\n\n---\n\n") == 230
    pages = M.page_aware_markdown(chunks).collect()[0].markdown.split("\n\n---\n\n")
    assert pages[0] == "[Page 1]\n\ntext 0\n\ntext 150" and pages[9].startswith("[Page 10]") and pages[-1] == "[Page Unknown]\n\ntext 230" and len(pages) == 151


def test_strict_lookup_and_read_through(spark):
    cache = spark.createDataFrame([("n", "h1", 1, "old"), ("n", "h1", 2, "new"), ("n", None, 3, "none")], "namespace string, slide_hash string, at int, block string")
    wanted = spark.createDataFrame([("n", "h1"), ("m", "h1"), ("n", None)], "namespace string, slide_hash string")
    out = C.strict_lookup(wanted, cache, ["namespace", "slide_hash"], ["block"], "at").collect()
    assert sorted((r.namespace, r.slide_hash or "", r.cached_block, r.hit) for r in out) == [("m", "h1", None, False), ("n", "", None, False), ("n", "h1", "new", True)]
    images = spark.createDataFrame([("d", "a", "h1", 10), ("d", "b", "h2", 10), ("e", "c", "h2", 10), ("d", "x", "h3", 10), ("d", "z", "", 10), ("d", "y", "h4", 99)], "doc_id string, id string, slide_hash string, byte_estimate bigint")
    held = spark.createDataFrame([(1, "h1", "block", 5)], "desc_id bigint, slide_hash string, markdown_block string, updated_at int")

    def call(job):
        if job["slide_hash"] == "h3":
            raise ValueError("no answer")
        return "said " + job["slide_hash"]

    answers, new = D.read_through(images, held, call, most=50, at_once=2)
    assert {(r.image_id, r.status, r.content) for r in answers.collect()} == {("a", "hit", "block"), ("b", "miss", "said h2"), ("c", "miss", "said h2"), ("x", "error", None), ("y", "error", None), ("z", "error", None)}
    assert [(r.slide_hash, r.content) for r in new.collect()] == [("h2", "said h2")]


def test_clusters_do_not_depend_on_order():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 80):
        x = rng.uniform(0, 600, (n, 2))
        boxes = np.c_[x[:, 0], x[:, 0] + rng.uniform(1, 60, n), x[:, 1], x[:, 1] + rng.uniform(1, 60, n)]
        near = lambda a, b: max(a[0], b[0]) - min(a[1], b[1]) <= 12 and max(a[2], b[2]) - min(a[3], b[3]) <= 12
        label = list(range(n))
        for _ in range(n):
            label = [min(label[j] for j in range(n) if j == i or near(boxes[i], boxes[j])) for i in range(n)]
        assert L.components(boxes, 12.0).tolist() == label


def test_versions_survive_a_lost_pointer(spark, tmp_path):
    root = str(tmp_path / "t")
    assert C.read_version(spark, root) is None
    C.write_version(spark.createDataFrame([(1,)], "x int"), root)
    (tmp_path / "t" / "pointers" / "n=000000000002").mkdir()  # a write that was lost before it was whole
    assert [r.x for r in C.read_version(spark, root).collect()] == [1]


def test_newest_and_late_windows(spark, tmp_path):
    found = spark.createDataFrame([("f/a.pdf", 1), ("f/b.pdf", 2), ("g/c.pdf", 2), ("g/d.pdf", 2)], "path string, modificationTime int")
    assert sorted((r.folder, r.path) for r in files.newest(found).collect()) == [("f", "f/b.pdf"), ("g", "g/d.pdf")]
    source = tmp_path / "in"
    at = lambda h: f"2025-01-01 {h:02}:10:00"
    for n, hours in enumerate(([1, 1, 2], [9], [10], [1, 20])):  # the last batch brings a row that comes 18 hours late
        spark.createDataFrame([(at(h), "k") for h in hours], "t string, kind string").selectExpr("cast(t as timestamp) as ts", "kind").coalesce(1).write.mode("append").parquet(str(source))
        import time

        time.sleep(1.1)
    stream = ingest.arriving(spark, str(source), spark.read.parquet(str(source)).schema, files=1)
    done = ingest.run_to_table(ingest.windowed_counts(stream, "ts", "kind"))
    assert sorted((r["window"].start.hour, r.n) for r in done.collect()) == [(1, 2), (2, 1), (9, 1), (10, 1)]


def test_trees_of_items(spark):
    cells = [{"start_row_offset_idx": r, "end_row_offset_idx": r, "start_col_offset_idx": c, "end_col_offset_idx": c, "text": t} for r, c, t in ((0, 0, ""), (1, 0, "a"), (1, 1, "b  c"), (3, 0, "1"), (3, 1, "old"), (3, 1, "2"))]
    document = {
        "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/pictures/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/0"}, {"$ref": "#/nowhere/9"}]},
        "groups": [{"page_no": 4, "children": [{"$ref": "#/texts/1"}, {"$ref": "#/groups/0"}]}],
        "texts": [{"label": "section_header", "text": "Head", "prov": [{"page_no": 1}]}, {"label": "list_item", "text": "point"}, {"text": "in the picture"}, {"text": "unseen"}],
        "pictures": [{"label": "picture", "prov": [{"page_no": 2}], "children": [{"$ref": "#/texts/2"}], "captions": ["A", {"text": "bridge"}], "image": {"uri": "x.png"}}],
        "tables": [{"label": "table", "prov": [{"page_no": 3}], "data": {"table_cells": cells}}],
    }
    df = spark.createDataFrame([(1, json.dumps({"result": {"document": json.dumps(document)}})), (2, "no json"), (3, None)], "id int, j string")
    out = [(r.ref, r.page, r.type, r.content) for r in trees.items(df, ["id"], "j").orderBy("ord").collect()]
    figure = "[Figure on Page 2]\nExtracted text from image OCR:\nin the picture\nCaption: A bridge\nImage reference: x.png\n" + trees.FIGURE_END
    assert out[:4] == [("#/texts/0", 1, "text", "## Head"), ("#/texts/1", 4, "text", "- point"), ("#/pictures/0", 2, "figure", figure), ("#/tables/0", 3, "table", "| a | b c |\n| --- | --- |\n| 1 | 2 |")]
    assert [o[0] for o in out[4:]] == ["#/texts/3"] and trees.table_count(document) == 1


def test_markdown_and_documents_in_responses():
    assert trees.found_markdown({"a": {"md": "# x"}, "result": {"markdown": "  ", "document": {"md_content": "found"}}}) == ("found", "result.document.md_content")
    assert trees.found_markdown({"a": {"b": "plain", "text_md": "one"}, "markdown_content": "two"}) == ("two", "markdown_content")
    assert trees.found_markdown({"a": ["short", "# A heading that is long enough"]}) == ("# A heading that is long enough", "a.1") and trees.found_markdown([1]) == ("", "")
    assert trees.structured({"data": {"document": '{"texts": [1]}'}})[1] == "data.document" and trees.structured({"document": {"x": 1}}) == (None, "")


def test_cut_descriptions_are_read_too(spark):
    rows = [(1, '{"visualType": "chart", "visualDescription": "Whole."}'), (2, '```json\n{"visualType": "photo", "visualDescription": "Cut in the mid'), (3, "nothing"), (4, None), (5, ""), (6, 'Here: {"importantVisualElements": ["a", " "]} end')]
    out = {r.desc_id: (r.status, r.visual_type, r.visual_description, r.elements) for r in J.descriptions(spark.createDataFrame(rows, "desc_id int, description_json string"), "desc_id", "description_json").collect()}
    assert out == {1: ("read", "chart", "Whole.", []), 2: ("repaired", "photo", "Cut in the mid", []), 6: ("read", "mixed", "", ["a"])}


def test_intermediate_tables(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from pagewright import session as S

    df = spark.createDataFrame([(1,)], "x int")
    assert S.stored(df).collect() == df.collect() and S.exists(spark, S.work_dir(spark))
    df.write.parquet(str(tmp_path / "in"))
    calls = []

    def made():
        calls.append(1)
        return df

    for _ in range(2):
        assert S.stored_once(made, [str(tmp_path / "in")], spark, "once").collect() == df.collect()
    df.write.mode("append").parquet(str(tmp_path / "in"))
    S.stored_once(made, [str(tmp_path / "in")], spark, "once")
    assert len(calls) == 2
    unset = SimpleNamespace(get=lambda key, default: None)
    with pytest.raises(RuntimeError):
        S.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(applicationId="a", master="spark://host:7077")))
    own = S.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(applicationId="b", master="local[2]")))
    assert own == S.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(applicationId="b", master="local[2]")))


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, at int")
    C.write_version(frame([(k, "first", 0) for k in range(50)]), root)
    C.merge_version(frame([(60, "new", 1)]), root, ["k"], [], ["at"], buckets=8)  # puts all rows into buckets
    before = C._pointer(spark, root)
    C.merge_version(frame([(7, "again", 2), (7, "older", 1)]), root, ["k"], [], ["at"], buckets=8)
    after = C._pointer(spark, root)
    assert len([b for b in before if before[b] != after[b]]) == 1 and set(before) == set(after)
    out = {r.k: r.v for r in C.read_version(spark, root).collect()}
    assert out == {**{k: "first" for k in range(50)}, 7: "again", 60: "new"}
    C.merge_version(frame([]), root, ["k"], [], ["at"], buckets=8)
    assert C._pointer(spark, root) == after
