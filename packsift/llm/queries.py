"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.binding import let
from packsift.llm import (
    chunked_bpe,
    decontaminate,
    fill_in_middle,
    language,
    lines,
    near_duplicates,
    periodic_runs,
    personal,
    piece_bpe,
    repeated_phrases,
    token_counts,
    toxicity,
    vectors,
)
from packsift.llm.tables import documents, fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MAX_TOKENS = 512


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql.strip()
        return function

    return register


@query("op1_one_bit_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query(
    "op2_line_dedup",
    """
WITH docs AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
places AS (SELECT doc_id, text, site, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM docs),
shared AS (
  SELECT line FROM places WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= 10 AND count(DISTINCT coalesce(text, '')) >= 10),
flagged AS (SELECT p.doc_id, p.text, p.pos, CASE WHEN s.line IS NULL THEN p.line END AS kept FROM places p LEFT JOIN shared s ON p.line = s.line)
SELECT doc_id, count(*) AS n_lines, count(*) - count(kept) AS n_removed,
  CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(kept, chr(10) ORDER BY pos), '') END AS text
FROM flagged GROUP BY doc_id
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_shared_lines(documents(spark, sf_dir, "doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


@query("op3_chunk_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    coded = chunked_bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    counts = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in personal.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


@query("op5_weak_supervision_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{name}": of_kind(kind) for kind, name in enumerate(personal.KINDS)}
    return found.select(
        "doc_id",
        *[column.alias(name) for name, column in counts.items()],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@query("op6_naive_bayes_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = language.identify(docs, lambda doc_id: fold(doc_id, 5) != 0)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op7_cgk_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.flag_contaminated(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"))


@query("op8_compression_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 3) != 1, score_column="score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", toxicity.is_toxic(F.col("score")).cast("int").alias("predicted")
    )


@query("op9_tiled_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_components(documents(spark, sf_dir, "doc_id", "text"), shingle_words=4, percent=85)


@query("op10_repeated_phrases")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_phrases.remove_recurring(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op11_fill_in_middle",
    r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS digest FROM documents),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
    ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
    ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
  FROM docs),
cuts AS (
  SELECT doc_id, text, lines, len(lines) AS n,
    least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
    array_to_string(lines[b + 1:n], '') AS suffix
  FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = fill_in_middle.fill_in_middle(documents(spark, sf_dir, "doc_id", "text"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return examples.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )


def _periodic_tail(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document with its words from the a-th on repeated with
    period p, both drawn from the id; the other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column, n: Column, a: Column, p: Column) -> Column:
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")

    def drawn(words: Column) -> Column:
        n = F.size(words).cast("long")
        found = let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: tail(words, n, a, p)))
        return F.when(n > 0, found).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, let(words, drawn)).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", _periodic_tail(F.col("doc_id"), F.col("text")))
    by_length = lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("at"), r["period"].alias("period"))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs.find_runs(docs).withColumn("longest", F.array_max(F.transform("runs", by_length)))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.at").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_piece_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    coded = piece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), packed=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
