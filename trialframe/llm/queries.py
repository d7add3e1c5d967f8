"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialframe.llm._learning import held_out
from trialframe.llm.chat import canonical_turns, conversation_digests, formatted_turns
from trialframe.llm.collocations import collocations
from trialframe.llm.decontaminate import contamination, judged
from trialframe.llm.fill_middle import fill_in_middle, restored
from trialframe.llm.language import fit_language, predict_language
from trialframe.llm.pieces import encode_and_decode
from trialframe.llm.quality import fit_quality, score_quality
from trialframe.llm.repeats import without_repeats
from trialframe.llm.secret_scan import KINDS, listed, secret_spans
from trialframe.llm.simhash import simhash_components
from trialframe.llm.toxicity import fit_toxicity, score_toxicity
from trialframe.llm.url_rules import judge_urls
from trialframe.llm.winnow import edited_fingerprints
from trialframe.sources import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _query(build):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_parquet(spark, folder, "documents")
    model = fit_toxicity(docs, read_parquet(spark, folder, "labels"))
    return score_toxicity(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    found = encode_and_decode(read_parquet(spark, folder, "documents"), PIECE_MODEL)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@_query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_parquet(spark, folder, "documents")
    return predict_language(docs, fit_language(docs)).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score"
    )


@_query
def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = judge_urls(read_parquet(spark, folder, "pages"), read_parquet(spark, folder, "labels"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "confidence")


@_query
def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(read_parquet(spark, folder, "documents"), length=100)
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@_query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_components(read_parquet(spark, folder, "documents"), words=3, radius=2, seed=42)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@_query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_parquet(spark, folder, "documents")
    model = fit_quality(docs, read_parquet(spark, folder, "labels"))
    return score_quality(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "score_text",
        "score_meta",
    )


@_query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_spans(read_parquet(spark, folder, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "entropy")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


@_query
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = judged(contamination(read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "benchmark")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLES["op9_decontaminate"] = r"""
WITH words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, p.size, s FROM places p JOIN windows USING (win)),
hits AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = edited_fingerprints(read_parquet(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("digest").alias("fingerprint"),
        F.col("edited_digest").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@_query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fill_in_middle(read_parquet(spark, folder, "documents"), unit="line", rate=100, spm_rate=50, seed="7")
    return found.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLES["op11_fill_in_middle"] = r"""
WITH lines AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents),
hashes AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
        CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
    FROM lines),
cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
            WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM hashes),
parts AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


@_query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations(read_parquet(spark, folder, "documents"), least=100, longest=5, top=2000)
    return found.select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^ \t]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM pieces),
grams AS (
    SELECT lang, array_to_string(w[s : s + size - 1], ' ') AS phrase, size, count(*) AS f
    FROM places, (SELECT unnest(range(1, 6)) AS size) WHERE s + size - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, size, f AS a FROM grams WHERE size > 1 AND f >= 100),
covered AS (
    SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates t
    ON s.lang = t.lang AND t.size > s.size AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * t.a >= 100 * s.a),
kept AS (SELECT * FROM candidates ANTI JOIN covered USING (lang, phrase)),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS y
    FROM (SELECT lang, phrase, a, unnest(range(1, size)) AS k FROM kept)),
scored AS (
    SELECT c.lang, c.phrase, a, k, g.f AS l, h.f AS r, n,
        CAST((1000::HUGEINT * a * n) // (g.f::HUGEINT * h.f) AS BIGINT) AS score
    FROM cuts c JOIN grams g ON c.lang = g.lang AND x = g.phrase JOIN grams h ON c.lang = h.lang AND y = h.phrase JOIN totals t ON c.lang = t.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


# The contract's own conversation: two texts of control characters.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@_query
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    text = F.lit(CONTROL_TEXT)
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    rows = read_parquet(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    # Each row is a record of its own, of the layout with one role and one text.
    record = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = canonical_turns(rows.select(F.struct("conv_id", "turn").alias("id"), record.alias("record")))
    pieces = formatted_turns(turns.select("id.*", F.posexplode("turns").alias("place", "said")).select("conv_id", "turn", "place", "said.*"))
    found = conversation_digests(pieces, "conv_id", ["turn", "place"])
    return found.withColumnRenamed("id", "conv_id")


ORACLES["op13_chat_format"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
pieces AS (
    SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:|\n)', '\\\1', 'g') || ': '
        || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS piece
    FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
"""
