import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from text_fixtures import CLASHES, ODD, table
from test_simhash import fingerprint, kept_by_brute

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of each stage at the smallest size, written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], after.columns)
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(steps):
    for name, (_, _, columns) in steps.items():
        assert columns == COLUMNS or name == "pieces" and set(COLUMNS) <= set(columns)


def test_stages_only_drop_rows(steps):
    for name in ("toxicity", "near_duplicates", "decontamination"):
        before, after, _ = steps[name]
        known = [tuple(r.values()) for r in before]
        assert 0.5 * len(before) < len(after) <= len(before)
        assert all(tuple(r.values()) in known for r in after)


def test_toxic_words_are_gone_and_clean_documents_stay(steps):
    before, after, _ = steps["toxicity"]
    toxic = re.compile(r"\b(idiot|moron|scum|trash)\b", re.I)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    said = [r["doc_id"] for r in before if toxic.search(r["text"] or "")]
    assert said and sum(d in gone for d in said) >= 0.8 * len(said)
    assert len(gone) <= 0.25 * len(before)


def test_near_duplicates_against_all_pairs(steps):
    before, after, _ = steps["near_duplicates"]
    assert sorted((r["doc_id"] for r in after), key=str) == kept_by_brute([(r["doc_id"], r["text"]) for r in before])
    prints = [fingerprint(r["text"]) for r in after]
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])


def test_contaminated_documents_are_gone(spark, steps):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = lower(r["text"])
        windows |= {tuple(w[s : s + min(13, len(w))]) for s in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}

    def contaminated(text):
        w, hit = lower(text), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit.update(range(p, p + size))
        return bool(hit) and 20 * len(hit) >= len(w)

    before, after, _ = steps["decontamination"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not contaminated(r["text"])}


def test_secrets_are_masked_and_nothing_else_changes(steps):
    before, after, _ = steps["secrets"]
    new = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r in before:
        own = new[r["doc_id"]]
        if own["text"] == r["text"]:
            assert own == r
        else:
            assert "[SECRET]" in own["text"] and own["n_chars"] == len(own["text"])
        assert not re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", own["text"] or "")


def test_pieces_spell_every_text(steps):
    before, after, _ = steps["pieces"]
    assert len(after) == len(before) and all(r["round_trip"] for r in after)
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_gives_the_rows_of_the_stages(spark, steps):
    rows = corpus_pipeline.run(spark, FOLDER).select("doc_id", "text", "n_tokens").collect()
    assert sorted(map(tuple, rows)) == sorted((r["doc_id"], r["text"], r["n_tokens"]) for r in steps["pieces"][1])


def test_odd_rows_pass_every_stage(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, odd, FOLDER)
        if name != "pieces":
            assert kept.columns == odd.columns
        n = kept.count()
        assert n == len(ODD) or name in ("toxicity", "near_duplicates", "decontamination") and 0 < n <= len(ODD)
        assert stage(spark, empty, FOLDER).count() == 0


def test_entry_registers_every_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(re.match(rf"op{k}_", q) for q in names) for k in range(1, 14))
    assert {"op9_decontaminate", "op11_fill_in_middle", "op12_collocations", "op13_chat_format"} <= set(__spark_entry__.oracle_sql())


def test_entry_works_where_the_text_operators_cannot_be_imported(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("trialframe.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    names = __spark_entry__.queries()
    assert "cell_stats" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_clashing_columns_come_back_unchanged(spark):
    docs = table(spark, [(1, "some words here"), (2, "other words there, token = abcdef123456")])
    for name in ("n_tokens", "round_trip", "ids_", "_hit", "hit", "_near_duplicate_uid", "uid", "decoded", "text_", "given", "reach", "items", "n_words"):
        docs = docs.withColumn(name, F.lit("other"))
    for name, stage in STAGES.items():
        rows = stage(spark, docs, FOLDER)
        assert rows.columns[: len(docs.columns)] == docs.columns and rows.count() == 2
        own = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert sorted(map(tuple, rows.select(own).collect())) == sorted(map(tuple, docs.select(own).collect()))
    assert rows.columns[len(docs.columns) :] == ["ids__", "n_tokens_", "round_trip_"]
    assert rows.where("round_trip_").count() == 2
