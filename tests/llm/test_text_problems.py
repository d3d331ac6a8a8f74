import json

import pytest

from pagewright.llm import leaks, mojibake, ocr, site_lines, subjects, truncation

# -- wrong encodings -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", ["naïve Größe, 3 µm", "Только для слушателей", "l’équipe à 40 €", "seção • não"])
def test_round_trip(encoding, text):
    try:
        bad = text.encode().decode(encoding)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())
    fixed, layers, rest = mojibake.repair(bad, {})
    assert (fixed, rest) == (text, False) and layers >= 1


def test_two_layers_lost_bytes_and_one_byte_text():
    twice = "naïve – für".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(twice, {}) == ("naïve – für", 2, False)
    assert mojibake.repair("Verst�ndnis", {})[2] is True
    assert mojibake.repair("Таблица по теме".encode("cp1251").decode("cp1252"), {})[0] == "Таблица по теме"


@pytest.mark.parametrize("text", ["NÃO, LIÇÃO", "plain", "“Über” – 3 °C ≥ 2 € • α-decay × µ", "Слово о полку", "à l’étude", "в разделе «США»"])
def test_right_text_is_left_alone(text):
    assert mojibake.repair(text, {}) is None


@pytest.mark.parametrize("text", ["Das ÄÖÜ « Zeichen » ± 5 µ 20 °", "ÀÉÈ été", "ÜÖÄ und ÄÖÜ", "Æ Ø Å"])
def test_a_few_accented_capitals_are_right(text):
    assert mojibake.repair(text, {}) is None


@pytest.mark.parametrize("encoding", ["cp1251", "koi8_r"])
def test_cyrillic_of_one_byte(encoding):
    text = "Сравнение ледников и рек: таблица по теме, см. рисунок 4"
    fixed, layers, rest = mojibake.repair("Title\n" + text.encode(encoding).decode("latin-1") + "\nnaïve end", {})
    assert (fixed, layers, rest) == ("Title\n" + text + "\nnaïve end", 1, False)


def test_five_layers():
    bad = "é"
    for _ in range(5):
        bad = bad.encode().decode("latin-1")
    assert mojibake.repair(bad, {}) == ("é", 5, False)


def test_garbled_table(spark):
    rows = [(1, "naÃ¯ve", "x"), (2, None, "x"), (3, "", "x"), (4, "fine", "x"), (4, "Ã¼", "x"), (5, "Ã¼ " * 50_000, "x")]
    df = spark.createDataFrame(rows, "chunk_id bigint, content string, restored string")
    out = mojibake.garbled(df).collect()
    assert sorted(r.chunk_id for r in out) == [1, 4, 5] and next(r.restored for r in out if r.chunk_id == 1) == "naïve"
    assert mojibake.garbled(df.where("false")).count() == 0


# -- repeated lines ------------------------------------------------------------------------------------------------------

PAGES = "chunk_id bigint, doc_id string, documentname string, content string, site string"


def site(spark):
    line = "All rights reserved by the course office {}"
    rows = [(k, f"d{k}", "A.example/x" if k % 2 else "a.example/x", line.format(k) + f"\nown {k}", "z") for k in range(5)]
    rows += [(10, "d9", None, line.format(1), "z"), (11, "d1", "a.example/y", None, "z"), (12, None, "a.example/y", line.format(7), "z"), (13, "e1", "b.example/x", line.format(1), "z")]
    return spark.createDataFrame(rows, PAGES)


def test_repeated_lines_and_rebuilt_pages(spark):
    pages = site(spark)
    found = site_lines.repeated_lines(pages)
    assert sorted((r.chunk_id, r.line_no) for r in found.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (12, 0)]
    out = {r.chunk_id: r.content for r in site_lines.without_lines(pages, found).collect()}
    assert out[0] == "own 0" and out[12] == "" and 13 not in out
    assert site_lines.repeated_lines(pages.where("false")).count() == 0


def test_deltas_add_up(spark):
    pages = site(spark)
    old, new = pages.where("chunk_id < 3"), pages.where("chunk_id >= 2")  # one row is in both
    crossed = site_lines.newly_crossed(old, new).collect()
    assert [(r.site, r.docs) for r in crossed] == [("a.example", 5)]
    assert site_lines.newly_crossed(pages, new).count() == 0


def test_state_is_kept_and_old_pages_are_not_read_again(spark, tmp_path):
    line = "All rights reserved by the course office"
    page = lambda k, doc, *more: (k, doc, "a.example/x", "\n".join([*more, f"own {k}"]), None)
    frame = lambda rows: spark.createDataFrame(rows, PAGES.replace("site string", "extra string"))
    first = [page(k, f"d{k}", line) for k in range(3)]
    state = site_lines.LineState(spark, str(tmp_path / "state"))
    state.merge(frame(first))
    assert state.crossings().count() == 0
    second = [page(3, "d3", line), page(4, "d2", line), page(5, "d5")]
    state = site_lines.LineState(spark, str(tmp_path / "state"))  # opened again
    assert state.deltas == 1
    state.merge(frame(second))
    assert [(r.site, r.docs, r.direction) for r in state.crossings().collect()] == [("a.example", 4, "up")]
    assert sorted(r.chunk_id for r in state.cases().collect()) == [0, 1, 2, 3, 4]
    assert sorted((r.chunk_id, r.content) for r in site_lines.rebuilt(frame(first + second), state).collect()) == [(k, f"own {k}") for k in range(5)]
    # as the site grows the line falls below a share of it, and its pages are made whole again
    third = [page(10 + k, f"e{k}") for k in range(90)]
    state.merge(frame(third))
    assert [(r.docs, r.direction) for r in state.crossings().collect()] == [(4, "down")] and state.cases().count() == 0
    assert sorted((r.chunk_id, r.content) for r in site_lines.rebuilt(frame(first + second + third), state).collect()) == [(k, f"{line}\nown {k}") for k in range(5)]
    state.merge(frame(third[:0]))
    assert state.crossings().count() == 0 and state.touched().count() == 0


# -- cut values ----------------------------------------------------------------------------------------------------------


def value(text, **more):
    return json.dumps({"pageNumber": 1, "visualDescription": text, "teachingExplanation": "", "importantVisualElements": [], **more}, ensure_ascii=False)


def test_truncated(spark):
    whole = [value(f"The red pump number {k} leads to the wall. The blue pump is larger than the door.") for k in range(60)]
    notes = [value("See panel (b)") for _ in range(10)] + [value("Rule: y = 3x + 4") for _ in range(5)]
    bad = [whole[0][:70], "```json\n" + whole[1][:50], value("The red pump leads to the w"), value("The blue pump is larger than the…"), whole[2][:-2]]
    fine = ["```json\n" + whole[3] + "\n```", whole[4][:-1] + ",}", "{}", "", None, "Here: " + whole[5], value('A "quoted" word. \\ Ends well.')]
    rows = [(k, "m" if k % 3 else None, v, 0) for k, v in enumerate(whole + notes + bad + fine)]
    df = spark.createDataFrame(rows, "desc_id bigint, model_id string, description_json string, id int")
    at = len(whole) + len(notes)
    assert sorted(r.id for r in truncation.truncated(df).collect()) == list(range(at, at + len(bad)))
    shares = truncation.shares(df).collect()
    assert sum(r.n for r in shares) == len(rows) and sum(r.cut for r in shares) == len(bad)
    assert truncation.truncated(df.where("false")).count() == 0


def test_an_ending_that_recurs_only_at_a_limit_is_cut(spark):
    size = 300  # many values end at this length, and twenty of these with one ending, whose JSON was closed
    ends, rows = "Gauges of the pump are", []
    for k in range(400):
        whole = value(f"The red pump number {k} leads to the wall. " + "The blue pump is larger than the door. " * (k % 9))
        rows.append((k, "m", whole))
    rows += [(1000 + k, "m", value("The red pump leads to the wall. " * 20)[: size - 3] + f"{k:03}") for k in range(60)]
    room = size - len(value("")) - len(ends)
    at_limit = [(2000 + k, "m", value((f"Pump {k:02} leads to the wall. " + "The blue pump is larger than the door. " * 9)[: room - 2] + ". " + ends)) for k in range(20)]
    elsewhere = [(3000 + k, "m", value("The blue pump is larger than the door. " * (1 + k % 9) + ends)) for k in range(20)]
    assert {len(v) for _, _, v in at_limit} == {size}
    schema = "desc_id bigint, model_id string, description_json string"
    found = lambda more: {r.id for r in truncation.truncated(spark.createDataFrame(rows + more, schema)).collect()}
    cut = {1000 + k for k in range(60)}
    assert found(at_limit) == cut | {i for i, _, _ in at_limit}
    assert found(at_limit + elsewhere) == cut and found(elsewhere) == cut


def test_copies_do_not_make_an_ending_complete_and_labels_are_read(spark):
    whole = [value(f"The red pump number {k} leads to the wall. The blue pump is larger than the door.", importantVisualElements=["glacier tongue", "Größe"]) for k in range(40)]
    note = [value("The red pump leads to the wall. " * (k + 1) + "Gauge: see panel (b)") for k in range(5)]
    copies = [value("The red pump leads to the wall. Valves of the pump are larg")] * 30
    labels = [value("All is well.", importantVisualElements=["glacier ton"]), value("All is well.", importantVisualElements=["Gr\u00f6"]), value("All is well.", caption="The red pump leads to the wall and the blu")]
    rows = list(enumerate(whole + note + copies + labels + [value("All is well.", importantVisualElements=["new", "glacier", "x1"])]))
    df = spark.createDataFrame([(i, "m", v) for i, v in rows], "desc_id bigint, model_id string, description_json string")
    assert sorted(r.id for r in truncation.truncated(df).collect()) == list(range(45, 78))


def test_the_posterior_overrules_an_ending_and_limits_may_be_large(spark):
    # of 80 values that stop at 25,000 characters, with their JSON closed there, three stop behind a full sentence
    size, sentence = 25_000, "The blue pump is larger than the door. "
    room = size - len(value(""))
    rows = [(k, "m", value(f"The red pump number {k} leads to the wall. " + sentence * (k * 7 % 900))) for k in range(400)]
    text = lambda k: f"Pump {k:03} leads to the wall. " + sentence * 700
    behind = [f"Pump {k:03} is {'x' * (room % 39 + 39 * 2)}. " + sentence * 700 for k in range(3)]
    behind = [t[: t.rindex(".", 0, room) + 1] for t in behind]
    behind = [("A" * (room - len(t) - 1) + " " + t) if len(t) < room else t for t in behind]
    limited = [(1000 + k, "m", value(text(k)[:room] if k < 77 else behind[k - 77])) for k in range(80)]
    assert {len(v) for _, _, v in limited} == {size} and all(v.count('."') for _, _, v in limited[77:])
    out = {r.id: r for r in truncation.scores(spark.createDataFrame(rows + limited, "desc_id bigint, model_id string, description_json string")).collect()}
    assert {i for i, r in out.items() if r.score > 0} == {i for i, _, _ in limited}
    assert {(out[i].closed, out[i].ending) for i in (1077, 1078, 1079)} == {(True, "ended")} and {out[i].limit.split()[0] for i in (1077, 1078, 1079)} <= {"chars", "bytes", "text"}
    assert all(out[k].ending == "ended" and out[k].score < 0 for k in range(400))
    assert {(r.unit, r.limit) for r in truncation.real_limits(spark.createDataFrame(rows + limited, "desc_id bigint, model_id string, description_json string")).collect()} >= {("chars", size)}


def test_brackets_are_counted():
    assert truncation.json_closes('{"a": {"b": 1}}') and not truncation.json_closes('{"a": {"b": 1}') and not truncation.json_closes('{"a": "b}')


def test_censored_fit_finds_the_limit():
    import numpy as np

    rng = np.random.default_rng(1)
    true = np.exp(rng.normal(6.0, 0.6, 20_000)).astype(int)
    lengths, n = np.unique(np.minimum(true, 640), return_counts=True)
    out = truncation.fit_censored(lengths, n.astype(float), "chars").set_index("len")
    assert out.loc[640, "limit"] == 640 and out.loc[640, "posterior"] > 0.9
    assert abs(out["mu"].iloc[0] - 6.0) < 0.05 and abs(out["sd"].iloc[0] - 0.6) < 0.05
    assert (out.loc[[300, 500], "limit"] == 0).all()


# -- leaks ---------------------------------------------------------------------------------------------------------------


def test_exact_phrases(spark):
    passage = " ".join(f"item{k}" if k % 3 else "the" for k in range(40))
    w = passage.split()
    docs = [
        (1, "before " + " ".join(w[5:17]).upper() + ", after", "x"), (2, " ".join(w[5:16]), "x"), (3, " ".join(w[:11] + ["gap"] + w[11:22]), "x"), (4, None, "x"), (5, "", "x"),
        (6, passage, "x"), (6, passage, "x"), (7, ("filler " * 20_000) + " ".join(w[20:32]), "x"), (None, passage, "x"),
    ]
    items = [(1, "a", passage), (2, "a", passage), (3, "b", None), (4, "b", "too short"), (5, "b", "other " * 5 + "words " * 9)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, eval_set string, passage string")
    index = leaks.token_index(d)
    found = leaks.exact_phrases(index, i)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(a, b) for a in (1, 6, 7) for b in (1, 2)]
    assert {r.item_id: r.documents for r in leaks.leaked_items(found, i).collect()} == {1: 3, 2: 3, 3: 0, 4: 0, 5: 0}
    empty = leaks.token_index(d.where("false"))
    for search in (leaks.exact_phrases, leaks.proximity):
        assert search(empty, i).count() == 0 and search(index, i.where("false")).count() == 0


def test_proximity(spark):
    passage = " ".join(f"item{k}" for k in range(40))
    w = passage.split()
    changed = " ".join("other" if k % 10 == 5 else x for k, x in enumerate(w))  # a word changed in every ten
    longer = " ".join(w[:8] + ["more"] + w[8:16] + ["and", "more"] + w[16:])
    docs = [(1, "before " * 7 + changed), (2, longer), (3, " ".join(w[20:32])), (4, " ".join(w[20:30])), (5, " ".join(w[:8]) + " gap" * 60 + " " + " ".join(w[8:16])), (6, " ".join(reversed(w)))]
    index = leaks.token_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    items = spark.createDataFrame([(1, passage)], "item_id bigint, passage string")
    assert {r.doc_id: r.terms for r in leaks.proximity(index, items).collect()} == {1: 16, 2: 28, 3: 8}
    assert [r.doc_id for r in leaks.exact_phrases(index, items).orderBy("doc_id").collect()] == [2, 3]


def test_index_shards_and_blocks_of_items(spark, monkeypatch):
    import random

    rng = random.Random(9)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90))] for _ in range(120)]
    passages = [[*rng.choice(texts)[:30]] if k % 2 else [rng.choice("abcdefgh") for _ in range(20)] for k in range(30)]
    monkeypatch.setattr(leaks, "SHARD_WORDS", 300)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 150)
    monkeypatch.setattr(leaks, "ALIGNED_AT_ONCE", 50)
    index = leaks.token_index(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string"))
    items = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id bigint, passage string")
    grams = lambda t: {tuple(t[k : k + 12]) for k in range(len(t) - 11)}
    assert {(r.doc_id, r.item_id) for r in leaks.exact_phrases(index, items).collect()} == {(a, b) for a, t in enumerate(texts) for b, p in enumerate(passages) if grams(t) & grams(p)}


# -- scanned pages -------------------------------------------------------------------------------------------------------


def test_furniture_features():
    assert [ocr.number_value(x) for x in ("17", "xiv", "iv", "iix", "mil")] == [17, 14, 4, None, None]
    assert ocr.folded("The small tunc in the clock") == ocr.folded("Thc srnall tune in thc dock")
    rows = sorted(ocr.line_features("Unit 3. the running title of this deck   12\nbody text of the page\n- 4 -"), key=lambda r: r[0])
    assert [(r[0], r[4], r[5]) for r in rows] == [(0, 12, False), (1, None, False), (2, 4, True)]


def test_scanned_pages(spark):
    body = "The measured value of the garden wall is larger than the wooden bridge. Every painted window leads to the central station."
    rows = [(k, f"d{k // 10}", k % 10, k % 10 + 1, body) for k in range(300)]
    title = "Unit 7. the history of the northern railway"
    scan = [
        f"{title}\nThe mea-\nsured value of thc garden wall\nis larger than the bridge.\n41", f"{title}\nEvery painted window leads to the station.\n42",
        f"43   {title}\nThe wooden bridge is larger.", "The garden wall\nis larger than the wooden bridge.\n44",
    ]
    rows += [(1000 + k, "scan", k, k + 1, x) for k, x in enumerate(scan)] + [(2000, None, 0, None, None), (2001, "e", 0, 1, ""), (2002, "f", None, None, body)]
    df = spark.createDataFrame(rows, "chunk_id bigint, doc_id string, idx int, pageno int, content string")
    out = {r.chunk_id: r for r in ocr.repaired(df).collect()}
    assert sorted(out[1000].damage) == ["hyphen", "misread", "pageno", "runhead"]
    assert out[1000].text == "The measured value of the garden wall is larger than the bridge."
    assert sorted(out[1001].damage) == ["pageno", "runhead"] and sorted(out[1002].damage) == ["pageno", "runhead"]
    assert list(out[1003].damage) == ["pageno"] and not any(len(out[k].damage) for k in range(300))
    assert 2000 not in out and list(out[2001].damage) == []
    assert ocr.damages(df.where("false")).count() == 0


def test_the_perceptron_decides_on_words_it_has_not_seen(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    parts = ["gar", "win", "mar", "pla", "sil", "let", "cas", "mir", "can", "thun", "bre", "for"], ["den", "dow", "ket", "net", "ver", "ter", "tle", "ror", "dle", "der"], ["s", "ing", "less", "worm", "mill", "tide", "clock", "heim"]
    right = [a + b + c for a in parts[0] for b in parts[1] for c in parts[2]]
    shown, held = right[::2], right[1::2]  # the editor is trained on the first half
    known = spark.createDataFrame([(w, None, None, 400) for w in shown], "word string, hyphen string, right string, n bigint")
    weights = ocr.train(known)
    bad = [(g[0], w) for w in held if (g := ocr.garble(w, rng)) and g[0] not in right]
    words = spark.createDataFrame([(w, None, None, 400) for w in right] + [(g, None, None, 1) for g in dict(bad)] + [("gar", "-", "dens", 1), ("2", "-", "dens", 1), ("planets", "-", "castles", 1)], known.schema)

    def verdicts(weights):
        editor = spark.sparkContext.broadcast((weights, 40))
        out = ocr.word_verdicts(words, editor, ocr.Editor(weights, 40)).unionByName(ocr.line_end_verdicts(words, editor))
        return {r.key: r.value for r in out.collect()}

    found = verdicts(weights)
    assert sum(found.get(g) == w for g, w in bad) >= 0.95 * len(bad) and not set(found) & set(right)
    assert found["gar\x1f-\x1fdens"] == "join" and "planets\x1f-\x1fcastles" not in found
    assert verdicts({}) == {}  # the counts alone find nothing


def test_verdicts_do_not_depend_on_how_large_the_corpus_is(spark):
    from itertools import product

    usual = [a + b + c for a, b, c in product(("gar", "win", "mar", "pla", "sil", "let", "mir", "thun"), ("den", "dow", "ket", "net", "ver", "ter"), ("s", "ing", "less", "tide"))] + ["as", "at", "on", "with"]
    rows = [(w, 4000) for w in usual] + [("cas", 200), ("cat", 40), ("con", 700), ("(as", 30), ("(at", 300), ("(on", 200), ("vvith", 3), ("wifh", 3), ("gardcns", 2), ("w!ndows", 2)]

    def verdicts(times):
        words = spark.createDataFrame([(w, None, None, n * times) for w, n in rows], "word string, hyphen string, right string, n bigint")
        words = ocr.scaled(words, 900_000)
        weights = ocr.train(words)
        return {r.key: r.value for r in ocr.word_verdicts(words, spark.sparkContext.broadcast((weights, 40)), ocr.Editor(weights, 40)).collect()}

    want = {"vvith": "with", "wifh": "with", "gardcns": "gardens", "w!ndows": "windows"}
    assert verdicts(1) == want and verdicts(30) == want


def test_words_behind_a_parenthesis_are_taught(spark):
    taught = [x for kind, x in ocr.examples(["as", "garden", "window", "castle"]) if kind == "word" and x[0].startswith("(") and not x[1]]
    assert taught and all(x[2] == "c" for x in taught)
    known = [{"word": "as", "ops": None, "n": 500}]
    weights = dict(ocr.trained([("word", ["(rown", [[0, "=c"]]], [{"word": "crown", "ops": json.dumps([[0, "=c"]]), "n": 500}])] * 3, {"c(": {"=c": 0.0}}))
    table = {f: {} for f, _ in weights}
    for (f, label), w in weights.items():
        table[f][label] = w
    more = ocr.trained([("word", ["(as", [], "c", 0.1], known)] * 20, table)
    gain = lambda out: out["c(", "=c"] - out.get(("c(", "="), 0.0)
    assert gain(more) < gain(weights)


def test_verdicts_too_many_to_broadcast(spark):
    pages = spark.createDataFrame([(1, "thc wall\nof the gar-\nden"), (2, "nothing here"), (3, "")], "chunk_id bigint, content string")
    verdicts = spark.createDataFrame([("thc", "the"), ("gar\x1f-\x1fden", "join"), ("other", "word")], "key string, value string")
    some, table = ocr.with_verdicts(pages, verdicts, most=1)
    own = {r.chunk_id: json.loads(r.found) if r.found else {} for r in some.collect()}
    assert table is None and own == {1: {"thc": "the", "gar\x1f-\x1fden": "join"}, 2: {}, 3: {}}
    assert ocr.read_page("thc wall\nof the gar-\nden", set(), own[1]) == ("the wall of the garden", True, True)


# -- subjects ------------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    import random

    rng = random.Random(3)
    terms = {"law": ["court", "claim", "statute", "witness", "judge", "verdict"], "music": ["melody", "chord", "violin", "rhythm", "opera", "tempo"], "": ["deadline", "exam", "room", "form", "seminar", "desk"]}

    def sentence(s):
        return " ".join(["The"] + [w for _ in range(4) for w in (rng.choice(terms[s]), rng.choice(["with", "near", "and", "beside"]))]) + "."

    docs, truth, labels = [], set(), []
    for i in range(400):
        own = rng.choice(["law", "music", ""])
        text = " ".join(sentence(own) for _ in range(6))
        if i % 10 == 0:
            text += " " + " ".join(sentence("music") for _ in range(4))
            truth.add((i, "music"))
        if own:
            truth.add((i, own))
            if i % 4 == 0:
                labels.append((i, own.upper() if i % 8 else own))
        docs.append((i, text, "en" if i % 7 else None))
    labels += [(1, "music"), (2, None), (None, "law"), (3, "unknown")]
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "...", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string")
    names = spark.createDataFrame([("law",), ("music",), (None,)], "subject string")
    found = {(r.doc_id, r.subject) for r in subjects.assigned(d, lab, names).collect()}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.05 * len(found)
    assert subjects.assigned(d.where("false"), lab, names).count() == 0


def test_a_frequent_subject_keeps_its_words(spark):
    import random

    rng = random.Random(4)
    terms = {s: [f"{s}{k}" for k in "abcdef"] for s in ("law", "music", "sport", "art", "")}
    sentence = lambda s: " ".join(["The"] + [w for _ in range(4) for w in (rng.choice(terms[s]), rng.choice(["with", "near", "and"]))]) + "."
    own = ["law" if k % 2 else ("music", "sport", "art", "")[k // 2 % 4] for k in range(800)]  # half of all documents treat one subject
    d = spark.createDataFrame([(k, " ".join(sentence(s) for _ in range(6)), "en") for k, s in enumerate(own)], "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame([(k, s) for k, s in enumerate(own) if s and k % 3 == 0], "doc_id bigint, subject string")
    found = {(r.doc_id, r.subject) for r in subjects.assigned(d, lab, spark.createDataFrame([("law",), ("music",), ("sport",), ("art",)], "subject string")).collect()}
    assert found == {(k, s) for k, s in enumerate(own) if s}
    topics, _ = subjects.fit(d, lab, ["art", "law", "music", "sport"])
    tops = dict(zip(topics.names, subjects.top_terms(d, topics, 6)))
    assert set(tops["law", "en"]) == set(terms["law"])


def test_nine_languages_and_shares_of_sentences(spark):
    import random

    rng, docs, truth, lab = random.Random(6), [], set(), []
    langs = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii"]
    word = lambda g, s, k: f"{g}{s}{'abcdefghij'[k]}"
    def sentence(g, s):
        return " ".join(x for _ in range(4) for x in (word(g, s, rng.randrange(10)), word(g, "x", rng.randrange(6)))) + "."
    for g in langs:
        for k in range(60):
            own, other = ("law", "sport") if k % 2 else ("sport", "rest")
            n = k % 4 + 1  # of 8 sentences
            i = len(docs)
            docs.append((i, " ".join([sentence(g, own)] * 0 + [sentence(g, own) for _ in range(8 - n)] + [sentence(g, other) for _ in range(n)]), g if k % 5 else None))
            truth |= {(i, own)} | ({(i, other)} if n >= 2 and other != "rest" else set())
            if k % 3 == 0:
                lab.append((i, own))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    found = {(r.doc_id, r.subject) for r in subjects.assigned(d, spark.createDataFrame(lab, "doc_id bigint, subject string"), spark.createDataFrame([("law",), ("sport",)], "subject string")).collect()}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.05 * len(found)
