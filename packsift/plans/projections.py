"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.findings import (
    is_recoverable_warning,
    normalize_finding,
    rule_id,
    truncate_chars,
    warning_text,
)
from packsift.functions.identity import (
    durable_language,
    identity_key,
    target_id_of,
    target_name,
    with_identity,
)
from packsift.functions.paths import extension, is_safe_path, relative_path
from packsift.functions.urls import inspector_base, inspector_url, is_allowed_origin
from packsift.operators.dedup import within_scan_size
from packsift.operators.reuse import decode, storable
from packsift.plans.catalog import query
from packsift.plans.sources import DOCUMENTS, matcher_documents
from packsift.plans.views import CACHED, FILES, INDEX, JOBS, cached, files, jobs, table
from packsift.sources.documents import parse_documents, raw_findings
from packsift.sources.jobs import split_by_rules, too_many_distributions


@query(
    "flt_rules_hash",
    f"WITH {JOBS} SELECT seq, hash, CASE WHEN hash = 'rules-new' THEN 'ready' ELSE 'deferred' END AS status FROM jobs",
)
def flt_rules_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = spark.createDataFrame([("rules-new",)], "hash string")
    ready, deferred = split_by_rules(jobs(spark, sf_dir).select("seq", "hash"), snapshot)
    return ready.withColumn("status", F.lit("ready")).unionByName(deferred.withColumn("status", F.lit("deferred")))


@query(
    "flt_max_distributions",
    """SELECT conv_id, turn, CASE WHEN len(string_split(text, ' ')) > 32 THEN
  'too-many-distributions: ' || len(string_split(text, ' ')) || ' of 32' END AS failure
FROM conversations""",
)
def flt_max_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.split("text", " ", -1)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", too_many_distributions(names).alias("failure")
    )


@query("flt_scan_size", f"WITH {FILES} SELECT pkg, dist_index, path FROM files WHERE strlen(content) <= 4096")
def flt_scan_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_scan_size(files(spark, sf_dir), 4096).select("pkg", "dist_index", "path")


_PATH_FORMS = ["", ".", "..", "%", "/%", "../%", "./%", "%/..", "a/../%", "a//%", "a/./%", "..%", "%..", "a/.", "..\\%"]


@query(
    "prd_safe_path",
    "WITH f(form) AS (VALUES "
    + ", ".join(f"('{form}')" for form in _PATH_FORMS)
    + r"""), p AS (
  SELECT page_id, form, replace(form, '%', regexp_replace(url, '^[a-z]+://', '')) AS path FROM pages, f)
SELECT page_id, form, path <> '' AND left(path, 1) <> '/' AND NOT list_contains(string_split(path, '/'), '..')
  AND string_split(path, '/')[1] <> '.' AS safe FROM p""",
)
def prd_safe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.explode(F.array(*[F.lit(form) for form in _PATH_FORMS])).alias("form")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", forms)
    path = F.replace("form", F.lit("%"), F.regexp_replace("url", "^[a-z]+://", ""))
    return rows.select("page_id", "form", is_safe_path(path).alias("safe"))


_ROOTED_FORMS = ["%", "/work/target/%", "/work/target//%", "/other/%", "/work/target", "/work/targets/%", "../%", "a\\%", "..\\%"]


@query(
    "prj_relative_path",
    f"""WITH {FILES}, f(form) AS (VALUES """
    + ", ".join(f"('{form}')" for form in _ROOTED_FORMS)
    + r"""), p AS (SELECT doc_id, form, replace(form, '%', path || '/' || content) AS raw FROM files, f),
s AS (SELECT *, CASE WHEN left(raw, 1) <> '/' THEN raw
    WHEN raw LIKE '/work/target/%' THEN ltrim(substr(raw, 14), '/') END AS stripped FROM p),
e AS (SELECT *, replace(stripped, '\', '/') AS slashed,
    CASE WHEN stripped IS NULL THEN 'path-elsewhere: not below the target'
      WHEN list_contains(string_split(replace(stripped, '\', '/'), '/'), '..')
        THEN 'path-not-plain: a step leaves or repeats a folder'
      WHEN strlen(stripped) > 1024 THEN 'path-too-long: more than 1024 bytes' END AS error FROM s)
SELECT doc_id, form, CASE WHEN error IS NULL THEN slashed END AS path, error FROM e""",
)
def prj_relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that end in whole texts, so many pass the byte limit."""
    forms = F.explode(F.array(*[F.lit(form) for form in _ROOTED_FORMS])).alias("form")
    rows = files(spark, sf_dir).select("doc_id", "path", "content", forms)
    raw = F.replace("form", F.lit("%"), F.concat_ws("/", "path", "content"))
    return rows.select("doc_id", "form", relative_path(raw, F.lit("/work/target")).alias("r")).select(
        "doc_id", "form", "r.*"
    )


_NAME_FORMS = ["%", "%/.bashrc", "%/foo.", "%.tar.xz", "%/..name", "%/plain", "%.PY", "%.py/", "%/a.b.c"]


@query(
    "prj_extension",
    f"WITH {INDEX}, f(form) AS (VALUES "
    + ", ".join(f"('{form}')" for form in _NAME_FORMS)
    + """) SELECT path, form, CASE WHEN contains(base[2:], '.') THEN string_split(base, '.')[-1] END AS ext
FROM (SELECT path, form, string_split(rtrim(replace(form, '%', path), '/'), '/')[-1] AS base FROM index, f)""",
)
def prj_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.explode(F.array(*[F.lit(form) for form in _NAME_FORMS])).alias("form")
    rows = files(spark, sf_dir).select("path", forms)
    return rows.select("path", "form", extension(F.replace("form", F.lit("%"), F.col("path"))).alias("ext"))


@query("prj_file_identity", f"WITH {INDEX} SELECT path, sha256, size, ext FROM index")
def prj_file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_identity(files(spark, sf_dir)).select("path", "sha256", "size", "ext")


@query(
    "prj_rule_id",
    r"""WITH c AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS check_id FROM pages
  UNION ALL SELECT page_id, 'plain-' || page_id FROM pages)
SELECT page_id, check_id, string_split(check_id, '.')[-1] AS rule_id FROM c""",
)
def prj_rule_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.concat(F.lit("plain-"), F.col("page_id").cast("string"))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(forms).alias("check_id"))
    return rows.withColumn("rule_id", rule_id(F.col("check_id")))


@query(
    "prj_normalize_finding",
    f"""WITH {DOCUMENTS}, n AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN strlen(text) > 1024 THEN 'message-too-long: more than 1024 bytes' END AS error FROM docs WHERE state = 'ok')
SELECT conv_id, turn, CASE WHEN error IS NULL THEN role END AS rule_id,
  CASE WHEN error IS NULL THEN role || '/' || conv_id || '.py' END AS path,
  CASE WHEN error IS NULL THEN turn + 1 END AS start_line, CASE WHEN error IS NULL THEN turn + 2 END AS end_line,
  CASE WHEN error IS NULL THEN text END AS message, CASE WHEN error IS NULL THEN 'INFO' END AS severity,
  CASE WHEN error IS NULL THEN 'one line' END AS evidence, CASE WHEN error IS NULL THEN 'medium' END AS confidence,
  CASE WHEN error IS NULL THEN 'any' END AS execution_context,
  CASE WHEN error IS NULL THEN 'https://inspector.example/p/' || role || '/' || conv_id || '.py' END AS inspector_url, error
FROM n""",
)
def prj_normalize_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_findings(parse_documents(matcher_documents(spark, sf_dir)), ["conv_id", "turn"])
    normal = normalize_finding(F.col("raw"), F.lit("/work/target"), F.lit("https://inspector.example/p/"))
    return raw.select("conv_id", "turn", normal.alias("n")).select("conv_id", "turn", "n.finding.*", "n.error")


_PAGE_URL = r"""u AS (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#:]*)(:[0-9]+)?/?([^?#]*)(.*)$', ['scheme', 'host', 'port', 'path', 'tail']) AS p
  FROM (SELECT page_id, url FROM pages UNION ALL
    SELECT page_id, regexp_replace(url, '^([a-z]+://[^/]+)', '\1:8080') FROM pages)),
b AS (SELECT page_id, url, p.scheme || '://inspector.pypi.io' || p.port || '/project/' || p.host || '/' || page_id || '/'
  || p.path || '/' || p.tail AS base FROM u)"""


def _based_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL, plain and with a port, with its inspector base."""
    with_port = F.regexp_replace("url", "^([a-z]+://[^/]+)", "$1:8080")
    rows = table(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.array("url", with_port)).alias("url"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)
    return rows.withColumn("base", inspector_base(host, F.col("page_id").cast("string"), F.col("url")))


@query("prj_inspector_base", f"WITH {_PAGE_URL} SELECT page_id, url, base FROM b")
def prj_inspector_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _based_urls(spark, sf_dir).select("page_id", "url", "base")


@query(
    "prj_inspector_url",
    f"""WITH {_PAGE_URL}, j AS (SELECT b.page_id, b.url AS page_url, base || html AS url FROM b JOIN pages USING (page_id))
SELECT page_id, page_url, CASE WHEN strlen(url) <= 2048 THEN url END AS url,
  CASE WHEN strlen(url) > 2048 THEN 'address-too-long: more than 2048 bytes' END AS error FROM j""",
)
def prj_inspector_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _based_urls(spark, sf_dir)
    link = inspector_url(F.col("base"), F.col("html")).alias("l")
    return rows.select("page_id", F.col("url").alias("page_url"), link).select("page_id", "page_url", "l.*")


_ORIGINS = ["https://thther.example.org", "https://blog.tionsh.example.net"]
_ALLOWED = "('" + "', '".join(_ORIGINS) + "')"
_ORIGIN_FORMS = ["%", "%/", "%//", "%:443", "%:444", "%?q", "%#f", "%.evil.example"]


@query(
    "prd_api_origin",
    "WITH f(form) AS (VALUES "
    + ", ".join(f"('{form}')" for form in _ORIGIN_FORMS)
    + r"""), o AS (SELECT page_id, form, url AS page_url, replace(form, '%', regexp_extract(url, '^[a-z]+://[^/]+')) AS form_url FROM pages, f),
plain AS (SELECT page_id, form, [regexp_replace(regexp_replace(u, '/+$', ''), '^(https://.*):443$', '\1') FOR u IN [form_url, page_url]] AS urls FROM o)
SELECT page_id, form, urls[1] IN """ + _ALLOWED + " AS allowed, urls[2] IN " + _ALLOWED + " AS page_allowed FROM plain",
)
def prd_api_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.explode(F.array(*[F.lit(form) for form in _ORIGIN_FORMS])).alias("form")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", forms)
    url = F.replace("form", F.lit("%"), F.regexp_extract("url", "^[a-z]+://[^/]+", 0))
    return rows.select(
        "page_id",
        "form",
        is_allowed_origin(url, _ORIGINS).alias("allowed"),
        is_allowed_origin(F.col("url"), _ORIGINS).alias("page_allowed"),
    )


def _error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records in every form the matcher writes, with whole texts inside."""
    text, turn = F.col("text"), F.col("turn").cast("string")
    record = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    partial = F.array(F.lit("PartialParsing"), F.lit("span"))
    forms = {
        "timeout": record(level=F.lit("warn"), type=F.lit("Timeout")),
        "timeout-rule": record(level=F.lit("warn"), type=F.lit("Timeout"), rule_id=F.concat(F.lit("a.b."), F.translate(text, ".", "_"))),
        "partial": record(level=F.lit("warn"), type=partial, path=F.concat(F.lit("d/"), F.col("role"), F.lit("/"), F.translate(text, "/", "_"))),
        "partial-nopath": record(level=F.lit("warn"), type=partial),
        "error": record(level=F.lit("error"), type=F.lit("Timeout"), rule_id=turn),
        "syntax": record(level=F.lit("warn"), type=F.lit("SyntaxError"), path=text),
        "nolevel": record(type=partial, path=text),
        "text": text,
    }
    rows = F.array(*[F.struct(F.lit(name).alias("form"), value.alias("error")) for name, value in forms.items()])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(rows))


# The same records for DuckDB, and what their fields say.
_ERROR_FORMS = """records AS (
  SELECT conv_id, turn, text, unnest([
    {'form': 'timeout', 'error': to_json({'level': 'warn', 'type': 'Timeout'})::VARCHAR},
    {'form': 'timeout-rule', 'error': to_json({'level': 'warn', 'type': 'Timeout', 'rule_id': 'a.b.' || replace(text, '.', '_')})::VARCHAR},
    {'form': 'partial', 'error': to_json({'level': 'warn', 'type': ['PartialParsing', 'span'], 'path': 'd/' || role || '/' || replace(text, '/', '_')})::VARCHAR},
    {'form': 'partial-nopath', 'error': to_json({'level': 'warn', 'type': ['PartialParsing', 'span']})::VARCHAR},
    {'form': 'error', 'error': to_json({'level': 'error', 'type': 'Timeout', 'rule_id': turn::VARCHAR})::VARCHAR},
    {'form': 'syntax', 'error': to_json({'level': 'warn', 'type': 'SyntaxError', 'path': text})::VARCHAR},
    {'form': 'nolevel', 'error': to_json({'type': ['PartialParsing', 'span'], 'path': text})::VARCHAR},
    {'form': 'text', 'error': text}], recursive := true)
  FROM conversations),
f AS (
  SELECT conv_id, turn, text, form, CASE WHEN json_valid(error) THEN coalesce(error->>'$.level' = 'warn'
    AND (error->>'$.type' = 'Timeout' OR coalesce(error->>'$.type[0]' = 'PartialParsing', FALSE)), FALSE) ELSE FALSE END AS recoverable FROM records)"""


@query("prd_recoverable_warning", f"WITH {_ERROR_FORMS} SELECT conv_id, turn, form, recoverable FROM f")
def prd_recoverable_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _error_records(spark, sf_dir)
    return rows.select("conv_id", "turn", "form", is_recoverable_warning(F.col("error")).alias("recoverable"))


@query(
    "prj_warning_text",
    f"""WITH {_ERROR_FORMS}
SELECT conv_id, turn, form, CASE form WHEN 'timeout' THEN 'timeout: some rule'
  WHEN 'timeout-rule' THEN 'timeout: ' || substr(replace(text, '.', '_'), 1, 200)
  WHEN 'partial' THEN 'partly-parsed: ' || substr(replace(text, '/', '_'), 1, 256)
  ELSE 'partly-parsed: unnamed file' END AS warning
FROM f WHERE recoverable""",
)
def prj_warning_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _error_records(spark, sf_dir).where(is_recoverable_warning(F.col("error")))
    return rows.select("conv_id", "turn", "form", warning_text(F.col("error")).alias("warning"))


@query("prj_truncate", "SELECT doc_id, substr(text, 1, 2048) AS reason FROM documents")
def prj_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate_chars(F.col("text"), 2048).alias("reason"))


@query(
    "prj_target_name",
    f"""WITH {INDEX}, t AS (SELECT doc_id * 1000003 AS target_id, ext FROM index)
SELECT target_id, lpad(lower(to_hex(target_id)), 16, '0') || coalesce('.' || ext, '') AS name, target_id AS parsed_id FROM t""",
)
def prj_target_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select((F.col("doc_id") * 1000003).alias("target_id"), extension(F.col("path")).alias("ext"))
    named = rows.select("target_id", target_name(F.col("target_id"), F.col("ext")).alias("name"))
    return named.withColumn("parsed_id", target_id_of(F.col("name")))


@query(
    "prj_cache_key",
    f"""WITH {INDEX}, k AS (
  SELECT path, sha256, size, e AS ext FROM index, (VALUES (NULL), ('')) v(e) WHERE ext IS NULL
  UNION ALL SELECT path, sha256, size, ext FROM index WHERE ext IS NOT NULL
  UNION ALL SELECT path, sha256, size, repeat('x', 33) FROM index)
SELECT path, ext, sha256 || ':' || size || ':' || coalesce('ext=' || ext, 'none') AS local_key,
  CASE WHEN strlen(coalesce(ext, '')) <= 32 THEN sha256 || '/' || coalesce(ext, '') END AS durable_key FROM k""",
)
def prj_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and shared keys; an empty and an over-long extension are added."""
    rows = with_identity(files(spark, sf_dir)).select(
        "path",
        "sha256",
        "size",
        F.explode(
            F.concat(
                F.array("ext"),
                F.when(F.col("ext").isNull(), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
                F.array(F.lit("x" * 33)),
            )
        ).alias("ext"),
    )
    return rows.select(
        "path",
        "ext",
        identity_key(F.col("sha256"), F.col("size"), F.col("ext")).alias("local_key"),
        F.concat("sha256", F.lit("/"), durable_language(F.col("ext"))).alias("durable_key"),
    )


@query("flt_cache_value_size", "SELECT doc_id, strlen(text) AS size FROM documents WHERE strlen(text) <= 16384")
def flt_cache_value_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("result"))
    return storable(results).select("doc_id", F.octet_length("result").cast("bigint").alias("size"))


@query(
    "prd_cache_decodable",
    f"""WITH {INDEX}, {CACHED}
SELECT path, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 1 THEN NULL WHEN toxic = 0 THEN 0 END AS findings,
  toxic = 1 AS decode_error FROM cached""",
)
def prd_cache_decodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results: one finding, no finding, one with a missing field, raw text."""
    finding = F.struct(
        F.lit("rule").alias("rule_id"),
        F.lit("").alias("path"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.col("content").alias("message"),
        *[F.lit("x").alias(n) for n in ("severity", "evidence", "confidence", "execution_context", "inspector_url")],
    )
    stored = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.to_json(F.array(finding)))
        .when(F.col("quality") == 1, F.lit('[{"rule_id":"rule","path":""}]'))
        .when(F.col("toxic") == 0, F.lit("[]"))
        .otherwise(F.col("content"))
    )
    rows = cached(spark, sf_dir).select("path", decode(stored).alias("_findings"))
    return rows.select(
        "path", F.size("_findings").alias("findings"), F.col("_findings").isNull().alias("decode_error")
    ).withColumn("findings", F.when(~F.col("decode_error"), F.col("findings")))
