"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and works on every row of ``docs``; all
but the last return the columns of ``documents``. The columns of a row travel
through a row-wise operator as its id, so repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialframe.llm.decontaminate import contamination, judged
from trialframe.llm.pieces import encode_and_decode
from trialframe.llm.queries import PIECE_MODEL
from trialframe.llm.secret_scan import redacted, secret_spans
from trialframe.llm.simhash import drop_near_duplicates
from trialframe.llm.toxicity import fit_toxicity, score_toxicity
from trialframe.session import materialize
from trialframe.sources import read_parquet


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one value, beside its text."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = fit_toxicity(docs, read_parquet(spark, sf_dir, "labels"))
    return score_toxicity(_whole(docs), model, "row").where("score < 0.5").select("id.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints of three-word shingles are linked by two or fewer bits."""
    return drop_near_duplicates(docs, words=3, radius=2, seed=42)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark passages."""
    found = judged(contamination(_whole(docs), read_parquet(spark, sf_dir, "benchmark"), "row"))
    return found.where(~F.col("contaminated")).select("id.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark and the length brought up to date."""
    found = secret_spans(_others(docs), "row")
    text, hit = redacted(F.col("text"), F.col("spans")), F.size("spans") > 0

    def value(name: str) -> Column:
        if name == "text":
            return text
        own = F.col("id")[name]
        return F.when(hit, F.length(text).cast(docs.schema[name].dataType)).otherwise(own) if name == "n_chars" else own

    return found.select(*(value(c).alias(c) for c in docs.columns))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its pieces, and whether they spell its text again.

    The columns ``ids``, ``n_tokens`` and ``round_trip`` come behind those of ``docs``; one whose
    name ``docs`` has already gets an underscore more.
    """
    rows = encode_and_decode(_others(docs), PIECE_MODEL, "row")
    added = {
        "ids": F.col("ids"),
        "n_tokens": F.size("ids"),
        "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")),
    }
    own = [(F.col("text") if c == "text" else F.col("id")[c]).alias(c) for c in docs.columns]
    return rows.select(*own, *(value.alias(_free(name, docs.columns)) for name, value in added.items()))


def _others(docs: DataFrame) -> DataFrame:
    """Each row's other columns as one value, beside its text."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (t.lower() for t in taken):
        name += "_"
    return name


STAGES = [
    ("toxicity", keep_harmless),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secrets", mask_secrets),
    ("pieces", to_pieces),
]

# Trained scores, XXH64 and Viterbi paths have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder for the next."""
    docs = read_parquet(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
