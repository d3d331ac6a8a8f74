"""The queries of the numbered problems, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, stored_once, table
from . import leaks, mojibake, near_dups, ocr, packing, site_lines, subjects, truncation

#: Problem 1's tables, with their id and text.
RECORDS = (("chunks", "chunk_id", "content"), ("visual_descriptions", "desc_id", "markdown_block"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = [near_dups.similar_pairs(table(spark, d, t), i, c).select(F.lit(t).alias("tbl"), "id_1", "id_2") for t, i, c in RECORDS]
    return pairs[0].unionByName(pairs[1])


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    groups = [near_dups.classes_of(*near_dups.representatives(table(spark, d, t), i, c)).select(F.lit(t).alias("tbl"), "id", "class_id", "links") for t, i, c in RECORDS]
    return groups[0].unionByName(groups[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.damages(table(spark, d, "chunks"))


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages on which damage was found, repaired."""
    return ocr.repaired(table(spark, d, "chunks")).where(F.size("damage") > 0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "visual_descriptions")).select(F.col("id").alias("desc_id"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares(table(spark, d, "visual_descriptions"))


def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.real_limits(table(spark, d, "visual_descriptions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "chunks")).select("chunk_id")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "chunks"))


def _line_state(spark: SparkSession, d: str) -> site_lines.LineState:
    """Two partitions by time of arrival: the table as it was 90 days before its newest page, and what came since."""
    pages = table(spark, d, "chunks")
    newest = pages.agg(F.max("ingested_at").alias("t")).first().t
    new = F.coalesce(F.col("ingested_at") >= F.lit(newest) - F.expr("interval 90 days"), F.lit(True))
    state = site_lines.LineState(spark)
    for part in (pages.where(~new), pages.where(new)):
        state.merge(part)
    return state


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _line_state(spark, d).cases().select("chunk_id", "line_no")


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_lines(table(spark, d, "chunks"), _line_state(spark, d).cases())


def p5_newly_crossed(spark: SparkSession, d: str) -> DataFrame:
    """Lines that the pages of the last 90 days took over the thresholds or below them, each named by its first page and line."""
    state = _line_state(spark, d)
    at = state.table("lines").join(state.crossings(), ["site", "key"]).groupBy("site", "key", "docs", "direction").agg(F.min(F.struct("chunk_id", "line_no")).alias("at"))
    return at.select("site", "at.chunk_id", "at.line_no", "docs", "direction")


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The pages that those lines stand on, rebuilt."""
    return site_lines.rebuilt(table(spark, d, "chunks"), _line_state(spark, d))


def _containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """pack_sizes has a handful of rows, whatever the scale."""
    rows = table(spark, d, "pack_sizes").where("capacity_tokens > 0").select("container", "capacity_tokens").orderBy("capacity_tokens").toLocalIterator()
    return [(r.container, int(r.capacity_tokens)) for r in rows]


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = stored(packing.token_counts(table(spark, d, "documents")), "sizes")
    return packing.pack_all(sizes, _containers(spark, d)).withColumnRenamed("item_id", "doc_id")


def p6_certificate(spark: SparkSession, d: str) -> DataFrame:
    return packing.certificate(p6_packed(spark, d), _containers(spark, d))


def _token_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the documents, written by the first query that needs it."""
    return stored_once(lambda: leaks.token_index(table(spark, d, "documents")), [f"{d}/documents.parquet"], spark, "token-index")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.exact_phrases(_token_index(spark, d), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leaks.leaked_items(leaks.exact_phrases(_token_index(spark, d), items), items)


def p7_proximity(spark: SparkSession, d: str) -> DataFrame:
    return leaks.proximity(_token_index(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assigned(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p8_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """How many documents, and what share of the corpus, treat each area."""
    docs = table(spark, d, "documents")
    found = p8_found(spark, d).groupBy("subject").agg(F.count("*").alias("documents"))
    total = docs.agg(F.count_distinct("doc_id").alias("all"))
    names = table(spark, d, "subjects").select("subject").join(found, "subject", "left").fillna(0, ["documents"])
    return names.join(F.broadcast(total)).select("subject", "documents", (F.col("documents") / F.col("all")).alias("share"))


def p8_topics(spark: SparkSession, d: str) -> DataFrame:
    """Each topic with its top terms and the subject that they were mapped to, for inspection."""
    docs = table(spark, d, "documents")
    t, _ = subjects.fit(docs, table(spark, d, "subject_labels"), subjects.subject_names(table(spark, d, "subjects")))
    tops = subjects.top_terms(docs, t)
    rows = [(i, lang, meaning, " ".join(top)) for i, ((_, lang), meaning, top) in enumerate(zip(t.names, t.meaning, tops))]
    return spark.createDataFrame(rows, "topic int, lang string, subject string, top_terms string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_PAIRS = r"""
r AS (SELECT 'chunks' AS tbl, chunk_id AS id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS a FROM chunks
      UNION ALL SELECT 'visual_descriptions', desc_id, regexp_extract_all(lower(markdown_block), '[\p{L}\p{N}]+') FROM visual_descriptions),
g AS (SELECT DISTINCT tbl, id, array_to_string(a[i:i + 2], ' ') AS g FROM r, generate_series(1, len(a) - 2) AS s(i) WHERE len(a) >= 30),
n AS (SELECT tbl, id, count(*) AS n FROM g GROUP BY ALL),
both_ AS (SELECT x.tbl, x.id AS id_1, y.id AS id_2, count(*) AS c FROM g x JOIN g y ON x.tbl = y.tbl AND x.g = y.g AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT b.tbl, id_1, id_2 FROM both_ b JOIN n p ON p.tbl = b.tbl AND p.id = id_1 JOIN n q ON q.tbl = b.tbl AND q.id = id_2
          WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9)"""

_LINES = r"""
lines AS (
  SELECT chunk_id, doc_id, split_part(lower(documentname), '/', 1) AS site, i - 1 AS line_no,
         regexp_replace(lower(string_split(content, chr(10))[i]), '[^\p{L}]', '', 'g') AS k
  FROM chunks, generate_series(1, len(string_split(content, chr(10)))) AS g(i)
  WHERE documentname IS NOT NULL AND content IS NOT NULL),
long AS (SELECT * FROM lines WHERE length(k) >= 20),
sizes AS (SELECT split_part(lower(documentname), '/', 1) AS site, count(DISTINCT doc_id) AS n FROM chunks WHERE documentname IS NOT NULL GROUP BY 1),
crossed AS (
  SELECT site, k FROM long JOIN sizes USING (site) GROUP BY site, k, n
  HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) >= 0.05 * n)"""

#: The lines that cross with the pages of the last 90 days.
_CROSSINGS = r"""
all_ AS (SELECT *, coalesce(ingested_at >= (SELECT max(ingested_at) FROM chunks) - INTERVAL 90 DAY, true) AS new FROM chunks WHERE documentname IS NOT NULL),
l AS (
  SELECT chunk_id, doc_id, split_part(lower(documentname), '/', 1) AS site, new, i - 1 AS line_no,
         regexp_replace(lower(string_split(content, chr(10))[i]), '[^\p{L}]', '', 'g') AS k
  FROM all_, generate_series(1, len(string_split(content, chr(10)))) AS g(i) WHERE content IS NOT NULL),
n AS (SELECT split_part(lower(documentname), '/', 1) AS site, count(DISTINCT doc_id) AS n1, count(DISTINCT doc_id) FILTER (WHERE NOT new) AS n0 FROM all_ GROUP BY 1),
c AS (SELECT site, k, count(DISTINCT doc_id) AS d1, count(DISTINCT doc_id) FILTER (WHERE NOT new) AS d0, min((chunk_id, line_no)) AS place FROM l WHERE length(k) >= 20 GROUP BY ALL),
s AS (SELECT *, d1 >= 4 AND d1 >= 0.05 * n1 AS now, d0 >= 4 AND d0 >= 0.05 * n0 AS was FROM c JOIN n USING (site)),
moved AS (SELECT * FROM s WHERE now <> was)"""

_GRAMS = r"""
w AS (SELECT item_id AS id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS a FROM eval_items),
q AS (SELECT DISTINCT id AS item_id, array_to_string(a[i:i + 11], ' ') AS g FROM w, generate_series(1, len(a) - 11) AS s(i)),
x AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents WHERE text IS NOT NULL),
y AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + 11], ' ') AS g FROM x, generate_series(1, len(a) - 11) AS s(i)),
hits AS (SELECT DISTINCT doc_id, item_id FROM y JOIN q USING (g))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_PAIRS} SELECT tbl, id_1, id_2 FROM pairs",
        "p1_classes": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT tbl, id_1 AS a, id_2 AS b FROM pairs UNION ALL SELECT tbl, id_2, id_1 FROM pairs),
            reach AS (SELECT tbl, a, b FROM e UNION SELECT x.tbl, x.a, e.b FROM reach x JOIN e ON e.tbl = x.tbl AND e.a = x.b)
            SELECT tbl, a AS id, least(a, min(b)) AS class_id, any_value(c.n) AS links FROM reach JOIN (SELECT tbl, a, count(*) AS n FROM e GROUP BY tbl, a) c USING (tbl, a) GROUP BY tbl, a""",
        "p5_found": f"WITH {_LINES} SELECT DISTINCT chunk_id, line_no FROM long JOIN crossed USING (site, k)",
        "p5_pages": f"""WITH {_LINES}, bad AS (SELECT DISTINCT chunk_id, line_no FROM long JOIN crossed USING (site, k))
            SELECT l.chunk_id, coalesce(string_agg(string_split(c.content, chr(10))[l.line_no + 1], chr(10) ORDER BY l.line_no) FILTER (WHERE b.line_no IS NULL), '') AS content
            FROM lines l JOIN chunks c USING (chunk_id) LEFT JOIN bad b USING (chunk_id, line_no)
            WHERE chunk_id IN (SELECT chunk_id FROM bad) GROUP BY l.chunk_id""",
        "p5_newly_crossed": f"""WITH {_CROSSINGS}
            SELECT site, place[1] AS chunk_id, place[2] AS line_no, CASE WHEN now THEN d1 ELSE d0 END AS docs, CASE WHEN now THEN 'up' ELSE 'down' END AS direction FROM moved""",
        "p5_rebuilt": f"""WITH {_CROSSINGS}, touched AS (SELECT DISTINCT chunk_id FROM l JOIN moved USING (site, k)),
            bad AS (SELECT DISTINCT chunk_id, line_no FROM l JOIN s USING (site, k) WHERE s.now)
            SELECT l.chunk_id, coalesce(string_agg(string_split(p.content, chr(10))[l.line_no + 1], chr(10) ORDER BY l.line_no) FILTER (WHERE b.line_no IS NULL), '') AS content
            FROM l JOIN touched USING (chunk_id) JOIN chunks p USING (chunk_id) LEFT JOIN bad b USING (chunk_id, line_no) GROUP BY l.chunk_id""",
        "p7_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM hits",
        "p7_proximity": r"""WITH w AS (SELECT DISTINCT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS a FROM eval_items),
            q AS (SELECT item_id, i - 1 AS off, array_to_string(a[i:i + 4], ' ') AS g FROM w, generate_series(1, len(a) - 4) AS s(i) WHERE len(a) >= 12),
            x AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents WHERE text IS NOT NULL),
            y AS (SELECT doc_id, i - 1 AS pos, array_to_string(a[i:i + 4], ' ') AS g FROM x, generate_series(1, len(a) - 4) AS s(i)),
            m AS (SELECT doc_id, item_id, off, floor((pos - off) / 16.0) AS c FROM y JOIN q USING (g)),
            n AS (SELECT doc_id, item_id, cell, count(DISTINCT off) AS terms FROM (SELECT doc_id, item_id, off, c AS cell FROM m UNION ALL SELECT doc_id, item_id, off, c + 1 FROM m) GROUP BY ALL)
            SELECT doc_id, item_id, max(terms) AS terms FROM n WHERE terms >= 8 GROUP BY ALL""",
        "p7_items": f"""WITH {_GRAMS} SELECT e.item_id, e.eval_set, count(h.doc_id) AS documents
            FROM eval_items e LEFT JOIN hits h USING (item_id) GROUP BY ALL""",
    }
