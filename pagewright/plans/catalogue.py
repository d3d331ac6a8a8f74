"""Every query of the core by name, with SQL for the same rows. All read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import loose_json as J
from ..functions import text as T
from ..operators import cache as C
from ..operators import describe as D
from ..operators import layout as L
from ..operators import markdown as M
from ..operators import trees
from ..session import table
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space as Unicode has it, for engines whose patterns only know ASCII's.
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    """Registers the function under its name, with SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- the deck registry ---------------------------------------------------------------------------------------------------


@query("""
    WITH h AS (SELECT document_id, unnest(slide_hashes) AS slide_hash FROM documents_registry),
    n AS (SELECT document_id, count(DISTINCT slide_hash) AS c FROM h WHERE slide_hash IN (SELECT slide_hash FROM visual_descriptions) GROUP BY 1)
    SELECT d.document_id, file_name, page_count, len(slide_hashes) AS slides, coalesce(c, 0) AS cached_descriptions, last_accessed_at
    FROM documents_registry d LEFT JOIN n USING (document_id) ORDER BY last_accessed_at DESC, document_id""")
def deck_listing(spark: SparkSession, d: str) -> DataFrame:
    """Decks by last access, with the number of slides and how many of their distinct slides have a cached description."""
    decks = table(spark, d, "documents_registry")
    cached = table(spark, d, "visual_descriptions").select("slide_hash").where(F.col("slide_hash").isNotNull()).distinct()
    hits = (
        decks.select("document_id", F.explode(F.array_distinct("slide_hashes")).alias("slide_hash"))
        .join(cached, "slide_hash", "left_semi")
        .groupBy("document_id")
        .agg(F.count("*").alias("cached_descriptions"))
    )
    return (
        decks.join(hits, "document_id", "left")
        .select("document_id", "file_name", "page_count", F.size("slide_hashes").alias("slides"), F.coalesce("cached_descriptions", F.lit(0)).alias("cached_descriptions"), "last_accessed_at")
        .orderBy(F.desc("last_accessed_at"), "document_id")
    )


@query("""WITH v AS (SELECT *, CASE WHEN file_size_bytes < 1024 THEN 0 WHEN file_size_bytes < 1048576 THEN 1 WHEN file_size_bytes < 1073741824 THEN 2 ELSE 3 END AS u FROM documents_registry),
    f AS (SELECT *, file_size_bytes / (1024.0::DOUBLE ** u) AS x FROM v)
    SELECT document_id, regexp_replace(file_name, '\\.(pdf|pptx?|odp)$', '', 'i') AS base_name, lower(split_part(file_name, '/', 1)) AS site,
      CASE WHEN coalesce(file_size_bytes, 0) = 0 THEN '0 B' ELSE (CASE WHEN u = 0 OR x >= 10 THEN round(x, 0)::BIGINT::VARCHAR ELSE round(x, 1)::DOUBLE::VARCHAR END) || ' ' || ['B', 'KB', 'MB', 'GB'][u + 1] END AS size_label FROM f""")
def deck_labels(spark: SparkSession, d: str) -> DataFrame:
    decks = table(spark, d, "documents_registry")
    return decks.select("document_id", T.base_name(F.col("file_name")).alias("base_name"), F.lower(F.substring_index("file_name", "/", 1)).alias("site"), T.file_size_label(F.col("file_size_bytes")).alias("size_label"))


# -- caches --------------------------------------------------------------------------------------------------------------


@query("""SELECT namespace_id, slide_hash, model_id, desc_id, updated_at FROM visual_descriptions
    QUALIFY row_number() OVER (PARTITION BY namespace_id, slide_hash, model_id ORDER BY updated_at DESC NULLS LAST, prompt_version, prompt_hash, desc_id) = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = C.latest(table(spark, d, "visual_descriptions"), ["namespace_id", "slide_hash", "model_id"], "updated_at", ["prompt_version", "prompt_hash", "desc_id"])
    return rows.select("namespace_id", "slide_hash", "model_id", "desc_id", "updated_at")


@query("""SELECT doc_id, count(*) AS requested, count(*) FILTER (WHERE slide_hash IN (SELECT slide_hash FROM visual_descriptions)) AS hits,
    count(*) FILTER (WHERE slide_hash NOT IN (SELECT slide_hash FROM visual_descriptions WHERE slide_hash IS NOT NULL)) AS misses
    FROM images WHERE coalesce(slide_hash, '') <> '' GROUP BY doc_id""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.lookup_totals(table(spark, d, "images"), table(spark, d, "visual_descriptions"), "slide_hash", ["doc_id"])


@query("""SELECT doc_id, id, page_number FROM images i WHERE NOT EXISTS (SELECT 1 FROM visual_descriptions v WHERE v.slide_hash = i.slide_hash AND v.slide_hash <> '')""")
def cache_missing(spark: SparkSession, d: str) -> DataFrame:
    """Slides to be described: those that the cache lacks and those without a hash."""
    return C.split_by_cache(table(spark, d, "images"), table(spark, d, "visual_descriptions"), "slide_hash")[1].select("doc_id", "id", "page_number")


@query("""WITH s AS (SELECT doc_id, CASE WHEN coalesce(slide_hash, '') = '' THEN 'error' WHEN slide_hash IN (SELECT slide_hash FROM visual_descriptions) THEN 'hit'
      WHEN byte_estimate > 4194304 THEN 'error' ELSE 'miss' END AS status FROM images)
    SELECT doc_id, count_if(status = 'hit')::BIGINT AS hits, count_if(status = 'miss')::BIGINT AS misses, count_if(status = 'error')::BIGINT AS errors FROM s GROUP BY doc_id""")
def cache_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    s = D.statuses(table(spark, d, "images"), table(spark, d, "visual_descriptions"))
    return s.groupBy("doc_id").agg(*[F.count_if(F.col("status") == k).alias(n) for k, n in (("hit", "hits"), ("miss", "misses"), ("error", "errors"))])


@query("""SELECT doc_id, id AS image_id, CASE WHEN coalesce(slide_hash, '') = '' THEN 'error' WHEN slide_hash IN (SELECT slide_hash FROM visual_descriptions) THEN 'hit'
      WHEN byte_estimate > 300000 THEN 'error' ELSE 'miss' END AS status,
    CASE WHEN coalesce(slide_hash, '') = '' THEN 'Slide hash is missing.' WHEN slide_hash IN (SELECT slide_hash FROM visual_descriptions) THEN NULL
      WHEN byte_estimate > 300000 THEN 'Slide image is ' || byte_estimate || ' bytes, above 300000.' END AS error FROM images""")
def describe_status(spark: SparkSession, d: str) -> DataFrame:
    """With a size limit that some slides exceed."""
    return D.statuses(table(spark, d, "images"), table(spark, d, "visual_descriptions"), 300_000)


@query("""SELECT doc_id, coalesce(nullif(id, ''), 'image') AS image_id, page_number, coalesce(nullif(slide_hash, ''), nullif(fingerprint, ''), sha256(reference)) AS slide_hash,
    coalesce(nullif(fingerprint, ''), substr(coalesce(nullif(slide_hash, ''), nullif(fingerprint, ''), sha256(reference)), 1, 16)) AS fingerprint, coalesce(byte_estimate, 0) AS byte_estimate FROM images""")
def image_jobs(spark: SparkSession, d: str) -> DataFrame:
    return D.jobs(table(spark, d, "images"))


@query("""WITH c AS (SELECT slide_hash, arg_max(markdown_block, (updated_at, desc_id)) AS b FROM visual_descriptions WHERE markdown_block IS NOT NULL GROUP BY 1),
    f AS (SELECT doc_id, id AS image_id, max(slide_hash) AS slide_hash, min(caption) AS b FROM images WHERE caption IS NOT NULL GROUP BY ALL),
    h AS (SELECT slide_hash, min(b) AS b FROM f WHERE coalesce(slide_hash, '') <> '' GROUP BY 1)
    SELECT i.doc_id, i.id AS image_id, i.page_number, coalesce(c.b, h.b, f.b) AS block,
      CASE WHEN c.b IS NOT NULL THEN 'cached' WHEN h.b IS NOT NULL THEN 'fresh' ELSE 'by_id' END AS origin
    FROM images i LEFT JOIN c USING (slide_hash) LEFT JOIN h USING (slide_hash) LEFT JOIN f ON f.doc_id = i.doc_id AND f.image_id = i.id
    WHERE coalesce(c.b, h.b, f.b) IS NOT NULL""")
def ordered_merge(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "images")
    cached = table(spark, d, "visual_descriptions").where("markdown_block IS NOT NULL").groupBy("slide_hash").agg(F.max_by("markdown_block", F.struct("updated_at", "desc_id")).alias("block"))
    fresh = images.where("caption IS NOT NULL").groupBy("doc_id", F.col("id").alias("image_id")).agg(F.max("slide_hash").alias("slide_hash"), F.min("caption").alias("block"))
    return C.merged_in_order(images.withColumnRenamed("id", "image_id"), cached, fresh)


_UPSERT = """
    WITH old AS (SELECT * FROM documents_registry WHERE created_at < TIMESTAMP '2025-10-01'),
    new AS (SELECT document_id, lower(file_name) AS file_name, file_size_bytes + 1 AS file_size_bytes, page_count, slide_hashes, created_at + INTERVAL 1 DAY AS created_at, last_accessed_at + INTERVAL 1 DAY AS last_accessed_at
            FROM documents_registry WHERE last_accessed_at >= TIMESTAMP '2025-08-01')
    SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(n.file_name, o.file_name) AS file_name,
      CASE WHEN o.document_id IS NOT NULL THEN o.file_size_bytes ELSE n.file_size_bytes END AS file_size_bytes, coalesce(n.page_count, o.page_count) AS page_count,
      CASE WHEN o.document_id IS NOT NULL THEN o.created_at ELSE n.created_at END AS created_at, coalesce(n.last_accessed_at, o.last_accessed_at) AS last_accessed_at
    FROM old o FULL JOIN new n USING (document_id)"""


@query(_UPSERT)
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """The registry's later accesses merged into its earlier rows; size and creation time of known decks stay."""
    decks = table(spark, d, "documents_registry")
    old = decks.where(F.col("created_at") < F.expr("timestamp_ntz'2025-10-01'"))
    day = F.expr("interval 1 day")
    new = decks.where(F.col("last_accessed_at") >= F.expr("timestamp_ntz'2025-08-01'"))
    new = new.withColumns({"file_name": F.lower("file_name"), "file_size_bytes": F.col("file_size_bytes") + 1, "created_at": F.col("created_at") + day, "last_accessed_at": F.col("last_accessed_at") + day})
    return C.upserted(old, new, ["document_id"], ["file_size_bytes", "created_at"], ["last_accessed_at"]).drop("slide_hashes")


@query("""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY namespace_id, slide_hash, model_id, prompt_version, prompt_hash ORDER BY created_at, desc_id) AS n,
      row_number() OVER (PARTITION BY namespace_id, slide_hash, model_id, prompt_version, prompt_hash ORDER BY updated_at DESC NULLS LAST, desc_id DESC) AS m FROM visual_descriptions)
    SELECT o.namespace_id, o.slide_hash, o.model_id, o.prompt_version, o.prompt_hash, w.desc_id, o.created_at, w.updated_at, w.latency_ms
    FROM (SELECT * FROM k WHERE n = 1) o JOIN (SELECT * FROM k WHERE m = 1) w USING (namespace_id, slide_hash, model_id, prompt_version, prompt_hash)""")
def upsert_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """First writes as the cache, all rows as incoming: one row per key with the last values and the first creation time."""
    v = table(spark, d, "visual_descriptions").select(*C.CACHE_KEY, "desc_id", "created_at", "updated_at", "latency_ms")
    first = v.withColumn("_n", F.row_number().over(Window.partitionBy(*C.CACHE_KEY).orderBy("created_at", "desc_id"))).where("_n = 1").drop("_n")
    return C.upserted(first, v, C.CACHE_KEY, ["created_at"], ["updated_at", "desc_id"])


@query("""WITH old AS (SELECT * FROM visual_descriptions WHERE created_at < TIMESTAMP '2025-10-01'),
    k AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY namespace_id, slide_hash, model_id, prompt_version, prompt_hash ORDER BY updated_at DESC NULLS LAST, desc_id) = 1)
    SELECT v.desc_id, k.desc_id AS cached_desc_id, k.desc_id IS NOT NULL AS hit FROM visual_descriptions v LEFT JOIN k USING (namespace_id, slide_hash, model_id, prompt_version, prompt_hash)""")
def strict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every request of the table against the cache as it was in autumn: all five parts of the key have to be equal."""
    v = table(spark, d, "visual_descriptions")
    old = v.where(F.col("created_at") < F.expr("timestamp_ntz'2025-10-01'")).select(*C.CACHE_KEY, "desc_id", "updated_at")
    return C.strict_lookup(v.select(*C.CACHE_KEY, "desc_id"), old, C.CACHE_KEY, ["desc_id"], "updated_at").select("desc_id", "cached_desc_id", "hit")


_EXTRACTIONS = f"""x AS (SELECT sha256(d.document_id) AS file_hash, CASE WHEN d.page_count % 3 = 0 THEN 3.0 ELSE 2.0 END AS images_scale, 'eng' AS ocr_language, d.page_count % 2 AS force_ocr,
      d.file_name, d.page_count, d.file_size_bytes, c.n AS table_count, d.created_at, d.last_accessed_at FROM documents_registry d
      LEFT JOIN (SELECT doc_id, count_if(chunk_type = 'table')::BIGINT AS n FROM chunks GROUP BY 1) c ON c.doc_id = d.document_id),
    e AS (SELECT * FROM x WHERE created_at < TIMESTAMP '2025-10-01'),
    n AS (SELECT * REPLACE (lower(file_name) AS file_name, file_size_bytes + 1 AS file_size_bytes, page_count + 1 AS page_count, created_at + INTERVAL 1 DAY AS created_at) FROM x WHERE last_accessed_at >= TIMESTAMP '2025-08-01')"""


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """What the extraction of each deck would be cached as: a key of four parts and the outcome."""
    tables = table(spark, d, "chunks").groupBy(F.col("doc_id").alias("document_id")).agg(F.count_if(F.col("chunk_type") == "table").alias("table_count"))
    rows = table(spark, d, "documents_registry").join(tables, "document_id", "left")
    scale = F.when(F.col("page_count") % 3 == 0, 3.0).otherwise(2.0)
    return rows.select(F.sha2("document_id", 256).alias("file_hash"), scale.alias("images_scale"), F.lit("eng").alias("ocr_language"), (F.col("page_count") % 2).alias("force_ocr"), "file_name", "page_count", "file_size_bytes", "table_count", "created_at", "last_accessed_at")


@query(f"""WITH {_EXTRACTIONS}
    SELECT file_hash, images_scale, ocr_language, force_ocr, coalesce(n.file_name, e.file_name) AS file_name, coalesce(n.page_count, e.page_count) AS page_count,
      CASE WHEN e.file_hash IS NOT NULL THEN e.file_size_bytes ELSE n.file_size_bytes END AS file_size_bytes, CASE WHEN n.file_hash IS NOT NULL THEN n.table_count ELSE e.table_count END AS table_count,
      CASE WHEN e.file_hash IS NOT NULL THEN e.created_at ELSE n.created_at END AS created_at FROM e FULL JOIN n USING (file_hash, images_scale, ocr_language, force_ocr)""")
def upsert_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Later extractions merged into earlier ones: all that they found is taken over, but not the file's size and the time of creation."""
    x = _extractions(spark, d)
    old = x.where(F.col("created_at") < F.expr("timestamp_ntz'2025-10-01'"))
    new = x.where(F.col("last_accessed_at") >= F.expr("timestamp_ntz'2025-08-01'"))
    new = new.withColumns({"file_name": F.lower("file_name"), "file_size_bytes": F.col("file_size_bytes") + 1, "page_count": F.col("page_count") + 1, "created_at": F.col("created_at") + F.expr("interval 1 day")})
    return C.upserted(old, new, C.EXTRACTION_KEY, ["file_size_bytes", "created_at"], ["last_accessed_at"]).drop("last_accessed_at")


@query(f"""WITH {_EXTRACTIONS} SELECT n.file_hash, n.images_scale, n.force_ocr, e.page_count AS cached_page_count, e.file_hash IS NOT NULL AS hit
    FROM n LEFT JOIN e USING (file_hash, images_scale, ocr_language, force_ocr)""")
def extraction_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The decks that come in again, and what the extraction cache has for exactly their file and settings."""
    x = _extractions(spark, d)
    old, new = x.where(F.col("created_at") < F.expr("timestamp_ntz'2025-10-01'")), x.where(F.col("last_accessed_at") >= F.expr("timestamp_ntz'2025-08-01'"))
    return C.strict_lookup(new, old, C.EXTRACTION_KEY, ["page_count"], "created_at").select("file_hash", "images_scale", "force_ocr", "cached_page_count", "hit")


@query("""WITH v AS (SELECT slide_hash, arg_max(markdown_block, (updated_at, desc_id)) FILTER (WHERE markdown_block IS NOT NULL) AS b FROM visual_descriptions WHERE slide_hash <> '' GROUP BY 1)
    SELECT DISTINCT i.doc_id, i.id AS image_id, i.slide_hash, CASE WHEN coalesce(i.slide_hash, '') = '' THEN 'error' WHEN v.slide_hash IS NOT NULL THEN 'hit' WHEN byte_estimate > 600000 THEN 'error' ELSE 'miss' END AS status,
      CASE WHEN v.slide_hash IS NOT NULL THEN b WHEN coalesce(i.slide_hash, '') <> '' AND coalesce(byte_estimate, 0) <= 600000 THEN 'No description of ' || left(i.slide_hash, 16) END AS content
    FROM images i LEFT JOIN v USING (slide_hash)""")
def read_through(spark: SparkSession, d: str) -> DataFrame:
    """Hits from the cache, misses from a provider (here one that has nothing to say), each hash asked once."""
    answers, _ = D.read_through(table(spark, d, "images"), table(spark, d, "visual_descriptions"), lambda job: f"No description of {job['slide_hash'][:16]}", 600_000, 4)
    return answers.select("doc_id", "image_id", "slide_hash", "status", "content")


@query(f"""WITH t AS (SELECT doc_id, coalesce(nullif(pageno, 0)::VARCHAR, 'Unknown') AS page_key, string_agg({strip_sql('content')}, chr(10) || chr(10) ORDER BY idx, chunk_id) AS text FROM chunks WHERE {strip_sql("coalesce(content, '')")} <> '' GROUP BY ALL),
    i AS (SELECT DISTINCT doc_id, id, page_number FROM images)
    SELECT i.doc_id, i.id AS image_id, i.page_number, coalesce(t.text, '') <> '' AS has_text, sha256('{D.TEMPLATE.replace("'", "''")}' || chr(10) || chr(10) || 'Slide: ' || coalesce('Page ' || nullif(i.page_number, 0), 'Unknown page') || chr(10) || 'Existing OCR text from this slide:' || chr(10) ||
      coalesce(nullif(substr({strip_sql(f"regexp_replace(t.text, '{WS}+', ' ', 'g')")}, 1, 1800), ''), '[No OCR text available]') ||
      CASE WHEN a.picture_box_count IS NULL THEN '' ELSE chr(10) || chr(10) || 'Visual detector metrics:' || chr(10) || '- pictureBoxCount: ' || a.picture_box_count || chr(10) || '- pictureAreaRatio: ' || coalesce(round(a.picture_area_ratio * 1e5)::BIGINT::VARCHAR, 'None') ||
        chr(10) || '- residualRatio: ' || coalesce(round(a.residual_ratio * 1e5)::BIGINT::VARCHAR, 'None') || chr(10) || '- edgeRatio: ' || coalesce(round(a.edge_ratio * 1e5)::BIGINT::VARCHAR, 'None') END) AS prompt_hash
    FROM i LEFT JOIN t ON t.doc_id = i.doc_id AND t.page_key = coalesce(nullif(i.page_number, 0)::VARCHAR, 'Unknown')
    LEFT JOIN (SELECT doc_id, image_id, max(picture_box_count) AS picture_box_count, max(picture_area_ratio) AS picture_area_ratio, max(residual_ratio) AS residual_ratio, max(edge_ratio) AS edge_ratio FROM image_analysis GROUP BY ALL) a ON a.doc_id = i.doc_id AND a.image_id = i.id""")
def image_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each slide's prompt, with the text of its page and the detector's figures (ratios in hundred-thousandths)."""
    images = table(spark, d, "images").select("doc_id", "id", "page_number").distinct()
    figures_ = table(spark, d, "image_analysis").groupBy("doc_id", F.col("image_id").alias("id")).agg(F.max("picture_box_count").alias("boxes"), *[F.round(F.max(c) * 1e5).cast("bigint").alias(c) for c in ("picture_area_ratio", "residual_ratio", "edge_ratio")])
    rows = D.with_page_text(images, M.text_by_page(table(spark, d, "chunks"))).join(figures_, ["doc_id", "id"], "left")
    text = F.concat(D.prompt(F.col("page_number"), F.col("page_text")), D.metrics(F.col("boxes"), F.col("picture_area_ratio"), F.col("residual_ratio"), F.col("edge_ratio")))
    return rows.select("doc_id", F.col("id").alias("image_id"), "page_number", (F.col("page_text") != "").alias("has_text"), F.sha2(text, 256).alias("prompt_hash"))


@query("""SELECT model_id, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
    round(count_if(updated_at < created_at) / count(*), 9) AS odd_share FROM visual_descriptions GROUP BY model_id""")
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "visual_descriptions")
    return v.groupBy("model_id").agg(
        F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.percentile("latency_ms", F.lit(0.5)).alias("p50_ms"), F.percentile("latency_ms", F.lit(0.95)).alias("p95_ms"),
        F.round(F.count_if(F.col("updated_at") < F.col("created_at")) / F.count("*"), 9).alias("odd_share"),
    )


# -- scalar kernels ------------------------------------------------------------------------------------------------------


@query("SELECT chunk_id, sha256(content) AS content_hash, substr(sha256(content), 1, 16) AS fingerprint FROM chunks WHERE content IS NOT NULL")
def slide_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("content", 256)
    return table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", h.alias("content_hash"), F.substring(h, 1, 16).alias("fingerprint"))


@query("""SELECT DISTINCT doc_id, id, lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(fingerprint || reference, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, c: xor((a * 33) & 4294967295, c)))) AS hash FROM images WHERE fingerprint IS NOT NULL AND reference IS NOT NULL""")
def short_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "images").where("fingerprint IS NOT NULL AND reference IS NOT NULL")
    return rows.select("doc_id", "id", T.short_hash(F.concat("fingerprint", "reference")).alias("hash")).distinct()


@query(rf"""SELECT chunk_id, substr({strip_sql(f"regexp_replace(content, '{WS}+', ' ', 'g')")}, 1, 1800) AS text FROM chunks WHERE content IS NOT NULL""")
def compact_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", T.compact(F.col("content")).alias("text"))


@query("SELECT chunk_id, round_even(length(to_base64(encode(content))) * 0.75, 0)::BIGINT AS bytes FROM chunks WHERE content IS NOT NULL")
def data_uri_bytes(spark: SparkSession, d: str) -> DataFrame:
    encoded = F.regexp_replace(F.base64(F.encode("content", "UTF-8")), r"[\r\n]", "")
    return table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", T.base64_bytes(encoded).alias("bytes"))


@query("""SELECT doc_id, id, CASE WHEN byte_estimate IS NULL OR byte_estimate <= 100000 THEN 2.0 ELSE least(byte_estimate / 100000.0::DOUBLE - 1, 3.0) END AS scale FROM images""")
def clamp_scale(spark: SparkSession, d: str) -> DataFrame:
    """A scale for each slide by its size, kept in bounds."""
    return table(spark, d, "images").select("doc_id", "id", G.render_scale(F.col("byte_estimate") / 100000.0 - 1).alias("scale"))


@query(r"""SELECT doc_id, coalesce(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AND (regexp_matches(text, '(?m)^#{1,6}\s+\S') OR regexp_matches(text, '(?m)^\s*[-*]\s+\S')
    OR regexp_matches(text, '(?m)^\|.*\|') OR contains(text, '```') OR regexp_matches(text, '\n\s*\n')), false) AS is_markdown FROM documents""")
def looks_like_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.looks_like_markdown(F.col("text")).alias("is_markdown"))


@query("""SELECT chunk_type, CASE WHEN contains(lower(chunk_type), 'table') THEN 'table' WHEN contains(lower(chunk_type), 'figure') OR contains(lower(chunk_type), 'picture')
    OR contains(lower(chunk_type), 'image') THEN 'figure' ELSE 'text' END AS item_type, count(*) AS n FROM chunks GROUP BY ALL""")
def item_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("chunk_type", T.item_type(F.col("chunk_type")).alias("item_type")).agg(F.count("*").alias("n"))


@query(r"SELECT chunk_id, coalesce(pageno, TRY_CAST(nullif(regexp_extract(source_path, '(?:^|\.)pages?[.\[](\d+)', 1), '') AS INT)) AS page FROM chunks")
def inferred_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.coalesce("pageno", T.page_from_path(F.col("source_path"))).alias("page"))


# -- pages and Markdown --------------------------------------------------------------------------------------------------

_SECTION = f"""'[Page ' || coalesce(nullif(pageno, 0), idx + 1) || ']' || CASE WHEN {strip_sql("coalesce(content, '')")} = '' THEN '' ELSE chr(10) || chr(10) || {strip_sql("coalesce(content, '')")} END"""
_BREAK = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(f"SELECT doc_id, string_agg({_SECTION}, {_BREAK} ORDER BY idx, chunk_id) AS markdown FROM chunks GROUP BY ALL")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return M.page_markdown(table(spark, d, "chunks"))


@query(f"""SELECT doc_id, coalesce(nullif(pageno, 0)::VARCHAR, 'Unknown') AS page_key, string_agg({strip_sql('content')}, chr(10) || chr(10) ORDER BY idx, chunk_id) AS text
    FROM chunks WHERE {strip_sql("coalesce(content, '')")} <> '' GROUP BY ALL""")
def page_text_map(spark: SparkSession, d: str) -> DataFrame:
    return M.text_by_page(table(spark, d, "chunks"))


@query(f"""WITH p AS (SELECT doc_id, nullif(pageno, 0) AS n, string_agg({strip_sql('content')}, chr(10) || chr(10) ORDER BY idx, chunk_id) AS text FROM chunks WHERE {strip_sql("coalesce(content, '')")} <> '' GROUP BY ALL)
    SELECT doc_id, string_agg('[Page ' || coalesce(n::VARCHAR, 'Unknown') || ']' || chr(10) || chr(10) || text, {_BREAK} ORDER BY n NULLS LAST) AS markdown FROM p GROUP BY doc_id""")
def page_aware_markdown(spark: SparkSession, d: str) -> DataFrame:
    return M.page_aware_markdown(table(spark, d, "chunks"))


@query(r"""SELECT doc_id, sum(coalesce(len(regexp_extract_all(content, '(?m)(?:^\|.*\|\s*$\n?){2,}')), 0))::BIGINT AS tables FROM chunks GROUP BY doc_id""")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("doc_id").agg(F.sum(T.table_count(F.col("content"))).alias("tables"))


@query(f"""WITH s AS (SELECT doc_id, count(*) AS pages, count_if(length({strip_sql("coalesce(content, '')")}) < 10)::BIGINT AS blank FROM chunks GROUP BY doc_id)
    SELECT *, blank > 0 AND blank >= ceil(pages * 0.35::DOUBLE) AS retry FROM s""")
def blank_page_retry(spark: SparkSession, d: str) -> DataFrame:
    return M.force_ocr(table(spark, d, "chunks"))


@query(rf"""WITH s AS (SELECT doc_id, string_split({strip_sql('text')}, {_BREAK}) AS a FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, i - 1 AS pos, a[i] AS body, nullif(regexp_extract(a[i], '^\[Page ([^\]]+)\]', 1), '') AS page_key FROM s, generate_series(1, len(a)) AS g(i))
    SELECT *, page_key IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, page_key ORDER BY pos) = 1 AS claims FROM r""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return M.split_sections(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")


_BLOCKS = """
    deck AS (SELECT doc_id, deck_id FROM documents WHERE deck_id IS NOT NULL),
    b AS (SELECT DISTINCT deck.doc_id, i.page_number::VARCHAR AS page_key, v.desc_id AS ord, v.markdown_block AS block FROM deck JOIN images i ON i.doc_id = deck.deck_id
          JOIN visual_descriptions v ON v.slide_hash = i.slide_hash AND v.slide_hash <> '' WHERE v.markdown_block IS NOT NULL AND i.page_number IS NOT NULL)"""


@query(rf"""WITH s AS (SELECT doc_id, string_split({strip_sql('text')}, {_BREAK}) AS a FROM documents WHERE text IS NOT NULL AND deck_id IS NOT NULL),
    r AS (SELECT doc_id, i - 1 AS pos, a[i] AS body, nullif(regexp_extract(a[i], '^\[Page ([^\]]+)\]', 1), '') AS page_key FROM s, generate_series(1, len(a)) AS g(i)),
    p AS (SELECT *, page_key IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, page_key ORDER BY pos) = 1 AS claims FROM r), {_BLOCKS},
    g AS (SELECT doc_id, page_key, string_agg(block, chr(10) || chr(10) ORDER BY ord) AS blocks FROM b GROUP BY ALL),
    kept AS (SELECT p.doc_id, pos, CASE WHEN g.blocks IS NULL THEN body ELSE {strip_sql('body')} || chr(10) || chr(10) || g.blocks END AS body
             FROM p LEFT JOIN g ON p.claims AND g.doc_id = p.doc_id AND g.page_key = p.page_key),
    last AS (SELECT doc_id, max(pos) + 1 AS n FROM p GROUP BY 1),
    free AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.claims AND p.doc_id = b.doc_id AND p.page_key = b.page_key))
    SELECT * FROM kept UNION ALL SELECT f.doc_id, n + row_number() OVER (PARTITION BY f.doc_id ORDER BY TRY_CAST(page_key AS INT) NULLS LAST, page_key, ord) - 1,
      '[Page ' || page_key || ']' || chr(10) || chr(10) || block FROM free f JOIN last USING (doc_id)""")
def insert_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Texts of decks with the cached descriptions of the deck's slides at their pages."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND deck_id IS NOT NULL")
    decks = table(spark, d, "documents").where("deck_id IS NOT NULL").select("doc_id", "deck_id")
    slides = table(spark, d, "images").where("page_number IS NOT NULL AND slide_hash <> ''").select(F.col("doc_id").alias("deck_id"), F.col("page_number").cast("string").alias("page_key"), "slide_hash")
    described = table(spark, d, "visual_descriptions").where("markdown_block IS NOT NULL").select("slide_hash", F.col("desc_id").alias("ord"), F.col("markdown_block").alias("block"))
    blocks = decks.join(slides, "deck_id").join(described, "slide_hash").select("doc_id", "page_key", "ord", "block").distinct()
    blocks = blocks.join(docs.select("doc_id"), "doc_id", "left_semi")
    return M.with_descriptions(M.split_sections(docs, "doc_id", "text"), blocks, "doc_id")


@query("""SELECT doc_id, idx, chunk_id FROM chunks ORDER BY doc_id, pageno NULLS LAST, idx, chunk_id""")
def pages_in_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").orderBy("doc_id", F.col("pageno").asc_nulls_last(), "idx", "chunk_id").select("doc_id", "idx", "chunk_id")


@query(rf"""WITH s AS (SELECT doc_id, count(*) AS chunks, count(DISTINCT coalesce(nullif(pageno, 0), idx + 1)) AS pages, sum(length({_SECTION}))::BIGINT AS characters, count_if(chunk_type = 'table')::BIGINT AS tables,
      count_if(chunk_type = 'figure')::BIGINT AS figures FROM chunks GROUP BY doc_id)
    SELECT s.*, coalesce(i.n, 0) AS images, coalesce(i.bytes, 0)::BIGINT AS image_bytes FROM s LEFT JOIN (SELECT doc_id, count(*) AS n, sum(byte_estimate) AS bytes FROM images GROUP BY 1) i USING (doc_id)""")
def stats_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    typed = chunks.select("doc_id", F.coalesce(F.nullif(F.col("pageno"), F.lit(0)), F.col("idx") + 1).alias("page"), "chunk_type", F.length(T.page_section(F.coalesce(F.nullif(F.col("pageno"), F.lit(0)), F.col("idx") + 1), F.col("content"))).alias("n"))
    per_doc = typed.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), F.sum("n").alias("characters"), F.count_if(F.col("chunk_type") == "table").alias("tables"), F.count_if(F.col("chunk_type") == "figure").alias("figures"))
    images = table(spark, d, "images").groupBy("doc_id").agg(F.count("*").alias("images"), F.sum("byte_estimate").alias("image_bytes"))
    return per_doc.join(images, "doc_id", "left").fillna(0, ["images", "image_bytes"])


# -- images and boxes ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, id, page_number, fingerprint, count(*) OVER (PARTITION BY doc_id, fingerprint) AS repeats FROM images")
def repeat_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.repeats(table(spark, d, "images")).select("doc_id", "id", "page_number", "fingerprint", "repeats")


@query("""SELECT DISTINCT doc_id, 'local-page-' || page_number || '-visual' AS figure_id, 'Large visual region candidate' AS caption, page_number, reference, 'page-visual' AS type, len(picture_areas) AS areas, source_path
    FROM images WHERE len(picture_areas) > 0""")
def figures(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "images").where(F.size("picture_areas") > 0)
    return i.select("doc_id", F.concat(F.lit("local-page-"), "page_number", F.lit("-visual")).alias("figure_id"), F.lit("Large visual region candidate").alias("caption"), "page_number", "reference", F.lit("page-visual").alias("type"), F.size("picture_areas").alias("areas"), "source_path").distinct()


@query("""SELECT doc_id, page_number, fingerprint, id FROM images QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, fingerprint ORDER BY id, reference) = 1""")
def figure_dedup(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("doc_id", "page_number", "fingerprint").orderBy("id", "reference"))
    return table(spark, d, "images").withColumn("_n", first).where("_n = 1").select("doc_id", "page_number", "fingerprint", "id")


_AREAS = """a AS (SELECT doc_id, id, i - 1 AS pos, s.width AS w, s.height AS h, p[i].label AS label, p[i].bbox AS x
    FROM (SELECT DISTINCT doc_id, id, page_size AS s, picture_areas AS p FROM images), generate_series(1, len(p)) AS g(i)),
    o AS (SELECT doc_id, id, pos, w, h, label, least(x.l, x.r) AS l, greatest(x.l, x.r) AS r, least(x.t, x.b) AS t, greatest(x.t, x.b) AS b FROM a)"""


@query(f"""WITH {_AREAS}, q AS (SELECT *, CASE WHEN w * h > 0 THEN (r - l) * (b - t) / (w * h) ELSE 0 END AS ratio, greatest(w, h) * 0.04 AS m FROM o),
    z AS (SELECT *, ratio >= 0.82 OR (ratio >= 0.65 AND l <= m AND t <= m AND r >= w - m AND b >= h - m) AS page_sized FROM q)
    SELECT doc_id, id, pos, label, round(ratio, 9) AS ratio, page_sized, r > l AND b > t AND ratio >= CASE WHEN label = 'image' THEN 0.01 ELSE 0.0005 END AND NOT page_sized AS kept FROM z""")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    box, w, h = F.col("box"), F.col("width"), F.col("height")
    return L.areas(table(spark, d, "images")).select(
        "doc_id", "id", "pos", "label", F.round(G.area_ratio(box, w, h), 9).alias("ratio"), G.is_page_sized(box, w, h).alias("page_sized"), G.is_kept_area(box, F.col("label"), w, h).alias("kept")
    )


@query(f"""WITH {_AREAS} SELECT doc_id, id, pos, round(greatest(0, least(x.l, x.r) * 1280.0 / w - 4), 6) AS x,
      round(greatest(0, CASE WHEN contains(upper(coalesce(nullif(x.coordOrigin, ''), 'BOTTOMLEFT')), 'BOTTOM') THEN h - greatest(x.t, x.b) ELSE least(x.t, x.b) END * 720.0 / h - 4), 6) AS y,
      round(least(1280.0, (greatest(x.l, x.r) * 1280.0 / w) - (least(x.l, x.r) * 1280.0 / w) + 8), 6) AS w, round(least(720.0, (greatest(x.t, x.b) - least(x.t, x.b)) * 720.0 / h + 8), 6) AS h FROM a""")
def bbox_to_canvas(spark: SparkSession, d: str) -> DataFrame:
    c = G.to_canvas(F.col("box"), F.col("width"), F.col("height"), F.lit(1280.0), F.lit(720.0), 4.0)
    rows = L.areas(table(spark, d, "images")).select("doc_id", "id", "pos", c.alias("c"))
    return rows.select("doc_id", "id", "pos", *[F.round(f"c.{k}", 6).alias(k) for k in "xywh"])


@query(f"""WITH RECURSIVE {_AREAS}, near AS (SELECT p.doc_id, p.id, p.pos AS a, q.pos AS b FROM o p JOIN o q ON p.doc_id = q.doc_id AND p.id = q.id
      AND greatest(p.l, q.l) - least(p.r, q.r) <= 12 AND greatest(p.t, q.t) - least(p.b, q.b) <= 12),
    reach AS (SELECT doc_id, id, a, b FROM near UNION SELECT r.doc_id, r.id, r.a, n.b FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.id = r.id AND n.a = r.b),
    c AS (SELECT doc_id, id, a AS pos, min(b) AS cluster FROM reach GROUP BY ALL)
    SELECT doc_id, id, cluster, count(*) AS boxes, min(l) AS l, max(r) AS r, min(t) AS t, max(b) AS b FROM c JOIN o USING (doc_id, id, pos) GROUP BY ALL""")
def bbox_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.clusters(table(spark, d, "images"))


@query(f"""WITH {_AREAS} SELECT doc_id, id, count(*) AS boxes, round(least(1, sum(abs(x.r - x.l) * abs(x.b - x.t)) / first(w * h)), 6) AS share FROM a GROUP BY ALL""")
def picture_area_share(spark: SparkSession, d: str) -> DataFrame:
    return L.picture_share(table(spark, d, "images")).withColumn("share", F.round("share", 6))


@query(f"""WITH {_AREAS} SELECT doc_id, id, coalesce(max(w), max(greatest(x.l, x.r))) AS width, coalesce(max(h), max(greatest(x.t, x.b))) AS height FROM a GROUP BY ALL""")
def page_extent(spark: SparkSession, d: str) -> DataFrame:
    return L.page_extent(table(spark, d, "images"))


@query("""WITH r AS (SELECT i.doc_id, i.id AS image_id, i.repeats, status, coalesce(picture_box_count, 0) AS n, coalesce(picture_area_ratio, 0) AS p
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, fingerprint) AS repeats FROM images) i LEFT JOIN image_analysis a ON a.doc_id = i.doc_id AND a.image_id = i.id),
    s AS (SELECT doc_id, image_id, repeats, CASE WHEN status = 'error' THEN 'load failed' WHEN coalesce(status, '') <> 'ready' THEN 'analyzing' ELSE
      concat_ws('; ', CASE WHEN repeats > 1 THEN 'repeated ' || repeats || 'x' END, CASE WHEN n < 1 THEN 'picture boxes < 1' END, CASE WHEN p < 0.12 THEN 'picture area < 12%' END,
        CASE WHEN n < 1 OR p < 0.12 THEN 'below vision threshold' END) END AS skip_reasons FROM r)
    SELECT *, skip_reasons = '' AS kept FROM s""")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return L.decisions(table(spark, d, "images"), table(spark, d, "image_analysis"))


@query("""WITH r AS (SELECT i.doc_id, i.id AS image_id, i.repeats, status, coalesce(picture_box_count, 0) AS n, coalesce(picture_area_ratio, 0) AS p,
      coalesce(text_box_count, 0) >= 1 AND (coalesce(residual_ratio, 0) >= 0.3 OR coalesce(edge_ratio, 0) >= 0.1) AS rest
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, fingerprint) AS repeats FROM images) i LEFT JOIN image_analysis a ON a.doc_id = i.doc_id AND a.image_id = i.id),
    s AS (SELECT doc_id, image_id, repeats, CASE WHEN status = 'error' THEN 'load failed' WHEN coalesce(status, '') <> 'ready' THEN 'analyzing' ELSE
      concat_ws('; ', CASE WHEN repeats > 1 THEN 'repeated ' || repeats || 'x' END, CASE WHEN n < 1 THEN 'picture boxes < 1' END, CASE WHEN p < 0.12 THEN 'picture area < 12%' END,
        CASE WHEN (n < 1 OR p < 0.12) AND NOT rest THEN 'below vision threshold' END) END AS skip_reasons FROM r)
    SELECT *, skip_reasons = '' AS kept FROM s""")
def residual_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate with the fallback on what is left beside the text."""
    return L.decisions(table(spark, d, "images"), table(spark, d, "image_analysis"), L.Filters.of({"residual_fallback": True}))


@query("""WITH r AS (SELECT i.doc_id, i.id, i.slide_hash, count(*) OVER (PARTITION BY i.doc_id, i.fingerprint) AS n FROM images i),
    k AS (SELECT r.doc_id, r.slide_hash, a.status = 'ready' AND r.n <= 1 AND a.picture_box_count >= 1 AND a.picture_area_ratio >= 0.12 AS kept FROM r LEFT JOIN image_analysis a ON a.doc_id = r.doc_id AND a.image_id = r.id),
    v AS (SELECT slide_hash, bool_or(coalesce(markdown_block, '') <> '') AS said FROM visual_descriptions WHERE slide_hash <> '' GROUP BY 1)
    SELECT doc_id, count(*) AS rendered, count_if(kept)::BIGINT AS kept, count_if(kept AND slide_hash IN (SELECT slide_hash FROM v))::BIGINT AS hits, count_if(kept AND slide_hash NOT IN (SELECT slide_hash FROM v) AND slide_hash <> '')::BIGINT AS misses,
      count_if(kept AND slide_hash IN (SELECT slide_hash FROM v WHERE said))::BIGINT AS described, count_if(kept AND coalesce(slide_hash, '') = '')::BIGINT AS failures FROM k GROUP BY doc_id""")
def visual_run_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each deck: rendered and kept slides, cache hits and misses among the kept, usable descriptions, and slides that can't be described."""
    images = table(spark, d, "images")
    gate = L.decisions(images, table(spark, d, "image_analysis")).select("doc_id", "image_id", "kept").distinct()
    said = D.is_usable(F.lit(None).cast("string"), F.col("markdown_block"))
    held = table(spark, d, "visual_descriptions").where("slide_hash <> ''").groupBy("slide_hash").agg(F.bool_or(said).alias("said"))
    rows = images.select("doc_id", F.col("id").alias("image_id"), "slide_hash").join(gate, ["doc_id", "image_id"]).join(held, "slide_hash", "left")
    kept, none, hit = F.col("kept"), F.coalesce("slide_hash", F.lit("")) == "", F.col("said").isNotNull()
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("rendered"), F.count_if(kept).alias("kept"), F.count_if(kept & hit).alias("hits"), F.count_if(kept & ~hit & ~none).alias("misses"),
        F.count_if(kept & F.coalesce("said", F.lit(False))).alias("described"), F.count_if(kept & none).alias("failures"),
    )


@query("""SELECT i.doc_id, count(DISTINCT i.id) AS expected, count(DISTINCT a.image_id) AS analysed, count(DISTINCT i.id) = count(DISTINCT CASE WHEN status IN ('ready', 'error') THEN a.image_id END) AS done
    FROM images i LEFT JOIN image_analysis a ON a.doc_id = i.doc_id AND a.image_id = i.id GROUP BY 1""")
def analysis_done(spark: SparkSession, d: str) -> DataFrame:
    """Whether all images of a deck are analysed; images are counted once before the join."""
    i = table(spark, d, "images").select("doc_id", F.col("id").alias("image_id")).distinct()
    a = table(spark, d, "image_analysis").groupBy("doc_id", "image_id").agg(F.bool_or(F.col("status").isin("ready", "error")).alias("ok"))
    rows = i.join(a.withColumn("_a", F.lit(1)), ["doc_id", "image_id"], "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("expected"), F.count("_a").alias("analysed"), (F.count("*") == F.count_if(F.coalesce("ok", F.lit(False)))).alias("done"))


# -- loose JSON ----------------------------------------------------------------------------------------------------------

_PARSED = """p AS (SELECT desc_id, CASE WHEN json_valid(j) AND NOT regexp_matches(j, ',\\s*[}\\]]') THEN j END AS j FROM (SELECT desc_id, nullif(regexp_extract(description_json, '(?s)\\{.*\\}'), '') AS j FROM visual_descriptions)),
    f AS (SELECT desc_id, coalesce(nullif(trim(j ->> '$.visualType'), ''), 'mixed') AS visual_type, coalesce(trim(j ->> '$.visualDescription'), '') AS visual_description, coalesce(trim(j ->> '$.teachingExplanation'), '') AS teaching_explanation,
      list_filter(list_transform(coalesce(from_json(j -> '$.importantVisualElements', '["VARCHAR"]'), []), lambda x: trim(x)), lambda x: x <> '') AS elements,
      list_filter(list_transform(coalesce(from_json(j -> '$.visibleTextNotInOcr', '["VARCHAR"]'), []), lambda x: trim(x)), lambda x: x <> '') AS missing_text,
      coalesce(nullif(trim(j ->> '$.confidence'), ''), 'medium') AS confidence FROM p WHERE j IS NOT NULL)"""


@query(f"WITH {_PARSED} SELECT desc_id, visual_type, visual_description, teaching_explanation, array_to_string(elements, '|') AS elements, array_to_string(missing_text, '|') AS missing_text, confidence FROM f")
def normalised_descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "visual_descriptions").select("desc_id", J.description(F.col("description_json")).alias("d")).where("d IS NOT NULL").select("desc_id", "d.*")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("elements", "missing_text")})


@query()
def all_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """As normalised_descriptions, and those that were cut off or wrapped, repaired."""
    rows = J.descriptions(table(spark, d, "visual_descriptions"), "desc_id", "description_json")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("elements", "missing_text")})


@query(f"""WITH {_PARSED} SELECT desc_id, concat_ws(chr(10) || chr(10), '### Visual Explanation', nullif(visual_description, ''), CASE WHEN teaching_explanation <> '' THEN 'Teaching note:' || chr(10) || teaching_explanation END,
      CASE WHEN len(elements) > 0 THEN 'Important visual elements:' || chr(10) || array_to_string(list_transform(elements, lambda x: '- ' || x), chr(10)) END,
      CASE WHEN len(missing_text) > 0 THEN 'Visible text or symbols not captured by OCR:' || chr(10) || array_to_string(list_transform(missing_text, lambda x: '- ' || x), chr(10)) END) AS block FROM f""")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "visual_descriptions").select("desc_id", J.description(F.col("description_json")).alias("d")).where("d IS NOT NULL")
    return rows.select("desc_id", J.markdown_block(F.col("d")).alias("block"))


@query()
def json_status(spark: SparkSession, d: str) -> DataFrame:
    """How each model's answers could be read: as they are, inside other text, repaired, empty or not at all."""
    v = table(spark, d, "visual_descriptions")
    return J.parsed(v, "desc_id", "description_json").join(v.select("desc_id", "model_id"), "desc_id").groupBy("model_id", "status").agg(F.count("*").alias("n"))


@query(rf"""SELECT chunk_id, sha256('v3' || chr(10) || '{D.TEMPLATE.replace("'", "''")}' || chr(10) || chr(10) || 'Slide: ' || coalesce('Page ' || nullif(pageno, 0), 'Unknown page') || chr(10) || 'Existing OCR text from this slide:' || chr(10) ||
    coalesce(nullif(substr({strip_sql(f"regexp_replace(content, '{WS}+', ' ', 'g')")}, 1, 1800), ''), '[No OCR text available]')) AS prompt_hash FROM chunks""")
def prompt_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", D.prompt_hash("v3", D.prompt(F.col("pageno"), F.col("content"))).alias("prompt_hash"))


@query("""SELECT doc_id, idx // 50 AS part, (row_number() OVER (PARTITION BY doc_id, idx // 50 ORDER BY idx, chunk_id) - 1)::INT AS ord, coalesce(nullif(pageno, 0), idx + 1) AS page, sha256(content) AS text_hash,
    CASE WHEN contains(lower(chunk_type), 'table') THEN 'table' WHEN contains(lower(chunk_type), 'figure') OR contains(lower(chunk_type), 'picture') THEN 'figure' ELSE 'text' END AS type FROM chunks WHERE content <> ''""")
def parser_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as parser documents of 50 places of the deck each, and read back in the order of their bodies."""
    page = F.coalesce(F.nullif(F.col("pageno"), F.lit(0)), F.col("idx") + 1)
    rows = table(spark, d, "chunks").where("content <> ''").select("doc_id", F.floor(F.col("idx") / 50).alias("part"), F.struct("idx", "chunk_id", F.col("chunk_type").alias("label"), F.col("content").alias("text"), page.alias("page")).alias("x"))
    documents = rows.groupBy("doc_id", "part").agg(trees.as_document(F.array_sort(F.collect_list("x"))).alias("json"))
    return trees.items(documents, ["doc_id", "part"], "json").select("doc_id", "part", "ord", "page", F.sha2("text", 256).alias("text_hash"), "type")


@query("""WITH i AS (SELECT DISTINCT doc_id, id, '#~1pages~1' || (page_number - 1) AS ref FROM images)
    SELECT i.doc_id, i.id, c.chunk_id, c.idx FROM i JOIN chunks c ON c.doc_id = i.doc_id AND '#/pages/' || c.idx = replace(replace(i.ref, '~1', '/'), '~0', '~')""")
def json_pointer_join(spark: SparkSession, d: str) -> DataFrame:
    """References followed by an equi-join on the decoded pointer: each slide's page."""
    refs = table(spark, d, "images").select("doc_id", "id", F.concat(F.lit("#~1pages~1"), F.col("page_number") - 1).alias("ref")).distinct()
    refs = refs.withColumn("pointer", F.replace(F.replace("ref", F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    items = table(spark, d, "chunks").select("doc_id", F.concat(F.lit("#/pages/"), "idx").alias("pointer"), "chunk_id", "idx")
    return refs.join(items, ["doc_id", "pointer"]).select("doc_id", "id", "chunk_id", "idx")


@query("""WITH body AS (SELECT doc_id, source_path AS ref, min((idx, chunk_id)) AS place FROM chunks WHERE source_path IS NOT NULL GROUP BY ALL),
    rest AS (SELECT DISTINCT doc_id, source_path AS ref FROM images i WHERE source_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM body b WHERE b.doc_id = i.doc_id AND b.ref = i.source_path)),
    both_ AS (SELECT doc_id, ref, 'body' AS origin, place[1] AS a, place[2] AS b FROM body UNION ALL SELECT doc_id, ref, 'rest', NULL, NULL FROM rest)
    SELECT doc_id, ref, origin, row_number() OVER (PARTITION BY doc_id ORDER BY origin, a, b, ref) - 1 AS ord FROM both_""")
def body_order_union(spark: SparkSession, d: str) -> DataFrame:
    """A deck's items in the order of its pages, each once, and behind them those that only its slides name."""
    body = table(spark, d, "chunks").where("source_path IS NOT NULL").groupBy("doc_id", F.col("source_path").alias("ref")).agg(F.min(F.struct("idx", "chunk_id")).alias("at"))
    rest = table(spark, d, "images").where("source_path IS NOT NULL").select("doc_id", F.col("source_path").alias("ref")).distinct().join(body, ["doc_id", "ref"], "left_anti")
    rows = body.select("doc_id", "ref", F.lit("body").alias("origin"), "at").unionByName(rest.withColumn("origin", F.lit("rest")), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("origin", "at.idx", "at.chunk_id", "ref"))
    return rows.select("doc_id", "ref", "origin", (place - 1).alias("ord"))


@query(rf"""WITH l AS (SELECT chunk_id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\|.*\|\s*$') AND NOT regexp_matches(x, '^\|[-:| ]+\|\s*$')) AS ls FROM chunks WHERE content IS NOT NULL),
    c AS (SELECT chunk_id, list_filter(list_transform(ls, lambda x: list_transform(string_split(regexp_replace(x, '^\||\|\s*$', '', 'g'), '|'), lambda v: {strip_sql(f"regexp_replace(v, '{WS}+', ' ', 'g')")})), lambda r: len(list_filter(r, lambda v: v <> '')) > 0) AS rs FROM l),
    w AS (SELECT *, list_max(list_transform(rs, lambda r: len(r))) AS n FROM c WHERE len(rs) > 0),
    f AS (SELECT *, list_transform(rs, lambda r: '| ' || array_to_string(list_resize(r, n, ''), ' | ') || ' |') AS t FROM w)
    SELECT chunk_id, len(rs) AS cell_rows, n AS cell_columns, t[1] || chr(10) || '| ' || array_to_string(list_transform(range(n), lambda x: '---'), ' | ') || ' |' ||
      CASE WHEN len(t) > 1 THEN chr(10) || array_to_string(t[2:], chr(10)) ELSE '' END AS grid FROM f""")
def table_cells_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each page's pipe rows as one grid, written as a table: the first row with any text is the head."""
    rows = table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", T.cells(F.col("content")).alias("cells")).where(F.size("cells") > 0)
    return rows.select("chunk_id", F.size("cells").alias("cell_rows"), F.array_max(F.transform("cells", F.size)).alias("cell_columns"), T.pipe_table(F.col("cells")).alias("grid"))


# -- streams -------------------------------------------------------------------------------------------------------------


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_hourly_events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    stream = ingest.arriving(spark, path, spark.read.parquet(path).schema)
    done = ingest.run_to_table(ingest.windowed_counts(stream, "ts", "event_type", late="3650 days"), "complete")
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def stream_closed_hours(spark: SparkSession, d: str) -> DataFrame:
    """The hours that the watermark, two hours behind the newest event, has closed; each is written once."""
    path = f"{d}/events.parquet"
    stream = ingest.arriving(spark, path, spark.read.parquet(path).schema)
    done = ingest.run_to_table(ingest.windowed_counts(stream, "ts", "event_type"))
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
