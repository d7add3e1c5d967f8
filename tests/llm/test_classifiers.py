import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from text_fixtures import ODD, table
from trialframe.llm import language, quality, toxicity
from trialframe.llm._learning import bounded_sample, held_out
from trialframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def read(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_held_out_follows_the_checksum(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
    assert spark.createDataFrame([(None,)], "id long").select(held_out("id")).first()[0] is True


def test_bounded_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    a = {tuple(r) for r in bounded_sample(rows.repartition(3), "id", "g", 100).select("id", "g").collect()}
    b = {tuple(r) for r in bounded_sample(rows.repartition(11), "id", "g", 100).select("id", "g").collect()}
    assert a == b and sum(g for _, g in a) == 100 and len(a) == 200


def test_toxicity_of_held_out_documents(spark):
    rows = QUERIES["op1_toxicity"](spark, FOLDER).join(read(spark, "labels"), "doc_id").where("held_out").toPandas()
    hit = (rows.predicted == 1) & (rows.toxic == 1)
    assert hit.sum() / (rows.predicted == 1).sum() > 0.9
    assert hit.sum() / (rows.toxic == 1).sum() > 0.8
    assert ((rows.score >= 0) & (rows.score <= 1)).all()


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op3_language"](spark, FOLDER).join(read(spark, "documents"), "doc_id").where("held_out").toPandas()
    right = rows.lang == rows.lang_pred
    assert right.mean() > 0.99
    assert abs(rows.score.mean() - right.mean()) < 0.02  # calibrated


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op7_quality"](spark, FOLDER).join(read(spark, "labels"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert rows[rows.quality == 0].score.mean() < 0.3


def labelled(spark, n=60):
    rows = [(k, f"{'awful nasty' if k % 2 else 'kind calm'} words {k}", "en" if k % 3 else "de") for k in range(n)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_odd_rows_get_scores(spark, odd, empty):
    docs, labels = labelled(spark)
    ids = sorted((d for d, _ in ODD), key=str)
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert sorted((r["id"] for r in rows), key=str) == ids and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["id"] in (1, 2, 3)}) == 1  # null, empty and blank alike
    assert toxicity.score_toxicity(empty, model).collect() == []
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(odd, model).collect()
    assert sorted((r["id"] for r in rows), key=str) == ids and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(empty, model).collect() == []
    model = language.fit_language(docs)
    rows = language.predict_language(odd, model).collect()
    assert sorted((r["id"] for r in rows), key=str) == ids
    assert {r["id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3}
    assert language.predict_language(empty, model).collect() == []


def test_nothing_to_learn_from(spark, odd, empty):
    docs, labels = labelled(spark)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit_toxicity(docs, some)
        assert {r["score"] < 0.5 for r in toxicity.score_toxicity(odd, model).collect()} == {True}
        quality.score_quality(odd, quality.fit_quality(docs, some)).collect()
    assert {r["lang_pred"] for r in language.predict_language(odd, language.fit_language(empty)).collect()} == {"und"}


def test_scores_do_not_depend_on_the_other_columns(spark):
    docs, labels = labelled(spark)
    model, names = toxicity.fit_toxicity(docs, labels), language.fit_language(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    for scored in (lambda d: toxicity.score_toxicity(d, model), lambda d: language.predict_language(d, names)):
        assert sorted(map(tuple, scored(docs).collect())) == sorted(map(tuple, scored(other).collect()))


def test_convolution_against_loops():
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 1, 5])
    x = rng.normal(size=(9, toxicity.DIMENSIONS)).astype(np.float32)
    filters = {w: rng.normal(size=(w, toxicity.DIMENSIONS, 2)).astype(np.float32) for w in toxicity.WIDTHS}
    wide, first = toxicity.padded(x, counts)
    got = toxicity.convolve(wide, filters)
    at = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        own = np.concatenate([x[at[d] : at[d] + n], np.zeros((toxicity.PAD + 1, toxicity.DIMENSIONS))])
        for t in range(n + 1):
            expected = np.concatenate([sum(own[t + k] @ f[k] for k in range(w)) for w, f in filters.items()])
            assert np.allclose(got[first[d] + t], expected, atol=1e-4)


def test_language_odds_against_shares(spark):
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b"], rng.normal(size=(language.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]), 1.0)
    model.table[language.BLANK] = 0
    texts = ["some words", "", "été 12 東京", "x"]
    expected = [sum((s * model.table[b] for b, s in zip(*pair)), np.zeros(2)) + model.bias for pair in language.shares(texts)]
    assert np.allclose(language.log_odds(model, texts), expected, atol=1e-4)


def test_penalty_leaves_weights_at_zero():
    rng = np.random.default_rng(5)
    rows = [(np.array([int(k % 2), 2 + int(rng.integers(500))]), np.array([1.0, 0.02])) for k in range(400)]
    weights, _ = language.fit_ftrl(rows, np.arange(400) % 2, 2)
    assert weights[0].argmax() == 0 and weights[1].argmax() == 1
    assert (weights[2:502] == 0).mean() > 0.5


@pytest.mark.parametrize("true", [0.5, 3.0])
def test_temperature_is_recovered(true):
    rng = np.random.default_rng(2)
    odds = rng.normal(size=(20_000, 3)) * 2
    p = np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)
    classes = (p.cumsum(axis=1) > rng.random((20_000, 1))).argmax(axis=1)
    assert abs(language.fit_temperature(odds * true, classes) / true - 1) < 0.05


def brute_hand(views, pool, good, odds):
    """What two views label in a whole pool, sorted in memory."""
    def hand(fitted, share):
        out = []
        for pupil, teacher in ((0, 1), (1, 0)):
            scores = odds(fitted[teacher], views[teacher][pool])
            low, high = quality.bounds(share, good)
            order = np.sort(scores)
            lo, hi = (order[max(int(np.ceil(q * len(order))) - 1, 0)] for q in (low, high))
            label = np.where(scores >= hi, 1, np.where(scores <= lo, 0, -1)) if lo < hi else np.full(len(scores), -1)
            own = label >= 0
            out.append((views[pupil][pool][own], label[own]))
        return out

    return hand


def test_co_training_learns_from_the_pool():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 2, 800)
    views = [np.column_stack([truth * 2 - 1 + rng.normal(0, s, 800) for s in (0.5, 3.0)] + [rng.normal(size=(800, 20))]).astype(np.float32) for _ in range(2)]
    known = np.arange(800) < 12
    hand = brute_hand(views, ~known, truth[known].mean(), lambda view, x: view.odds(x))
    fitted = quality.co_train(views[0][known], views[1][known], truth[known], hand)
    for view, x in zip(fitted, views):
        alone = quality.fit_logistic(x[known], truth[known])
        assert ((view.odds(x) > 0) == truth).mean() >= ((alone.odds(x) > 0) == truth).mean()


def test_handed_over_documents_against_sorting(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(500, 2)))]
    scored = spark.createDataFrame(rows, "id long, text_odds double, meta_odds double")
    found = {(r["pupil"], r["id"]): r["label"] for r in quality.handed_over(scored, 0.2, 0.75, 10_000).collect()}
    expected = {}
    for pupil, column in (("meta", 1), ("text", 2)):
        order = sorted(rows, key=lambda r: r[column])
        expected |= {(pupil, r[0]): 0 for r in order[:25]} | {(pupil, r[0]): 1 for r in order[-76:]}
    assert found.keys() <= expected.keys() and len(found) >= len(expected) - 2
    assert all(expected[k] == v for k, v in found.items())
    some = quality.handed_over(scored, 0.2, 0.75, 7).groupBy("pupil", "label").count().collect()
    assert [r["count"] for r in some] == [7] * 4
    flat = scored.withColumn("text_odds", F.lit(1.0)).withColumn("meta_odds", F.lit(0.0))
    assert quality.handed_over(flat, 0.2, 0.5, 10).count() == 0


def test_quality_against_a_version_in_memory(spark):
    """The whole fit, with the pool scored and sorted in one process."""
    rng = np.random.default_rng(9)
    kinds = (["kind", "calm", "good", "fine", "clear"], ["awful", "nasty", "bad", "poor", "junk"])
    rows = []
    for k in range(400):
        poor = int(rng.random() < 0.5)
        text = " ".join(rng.choice(kinds[poor if rng.random() < 0.8 else 1 - poor], 12))
        rows.append((k, text, "en", ("web", "book")[poor if rng.random() < 0.8 else 1 - poor], len(text), 1 - poor))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:120]], "doc_id long, quality int")
    learn = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5}
    model = quality.fit_quality(docs, labels, most_handed=10_000)

    text = quality.text_view(pa.array([r[1] for r in rows], pa.large_string()))
    meta = quality.meta_view([r[3] for r in rows], [r[2] for r in rows], np.array([float(r[4]) for r in rows]))
    truth = np.array([r[5] for r in rows])
    labelled = np.array([k for k in range(120) if k in learn])
    pool = np.array([k for k in range(120, 400) if k in learn])
    aside = np.zeros(len(labelled), bool)
    for k in (0, 1):
        aside[np.flatnonzero(truth[labelled] == k)[3::4]] = True
    own = labelled[~aside]
    hand = brute_hand((text, meta), pool, truth[labelled].mean(), lambda view, x: np.clip(view.odds(x), -30, 30))
    views = quality.co_train(text[own], meta[own], truth[own], hand)
    assert np.corrcoef(views[0].weights, model.text.weights)[0, 1] > 0.99
    assert np.corrcoef(views[1].weights, model.meta.weights)[0, 1] > 0.99
    scored = quality.score_quality(docs, model).toPandas().set_index("id").score_text
    a, b = model.text.scale
    expected = 1 / (1 + np.exp(-(a * (text @ views[0].weights + views[0].bias) + b)))
    assert np.abs(scored.sort_index().to_numpy() - expected).max() < 0.05


def test_letters_only_make_a_language(spark):
    docs, _ = labelled(spark)
    rows = [(1, "½ ² ① 10²"), (2, "٣٤٥ १२३"), (3, "½ a"), (4, "東"), (5, "_ - !"), (6, "ª")]
    found = {r["id"]: r["lang_pred"] for r in language.predict_language(table(spark, rows), language.fit_language(docs)).collect()}
    assert {k for k, v in found.items() if v == "und"} == {1, 2, 5}


def test_a_rare_language_has_the_shared_threshold():
    rng = np.random.default_rng(3)
    ids, langs, label = [], [], []
    for k in range(400):  # two common languages and seventy rare ones
        lang = "ab"[k % 2] if k < 260 else f"rare{k % 70}"
        ids.append(rng.integers(0, 50, (20, toxicity.FEATURES)).astype(np.int32) + (0 if lang == "a" else 50 if lang == "b" else 100))
        langs.append(lang)
        label.append(k // 2 % 2)
    model = toxicity.Model(*[None] * 4, 0.0)
    toxicity.learn_languages(model, ids, langs, np.array(label))
    assert model.languages == ["a", "b", None]
    guess = toxicity.guesses(model, np.concatenate(ids), np.full(400, 20))
    assert guess.tolist() == [{"a": 0, "b": 1}.get(x, 2) for x in langs]
    toxicity.calibrate(model, rng.normal(size=400) + np.array(label) * (1 + guess), guess, np.array(label), np.ones(400))
    assert model.threshold[2] == model.threshold[3] and len(set(model.threshold[:3].tolist())) == 3


def test_folds_are_trained_in_tasks(spark):
    rng = np.random.default_rng(5)
    label = np.arange(40) % 2
    ids = [rng.integers(0, 30, (15, toxicity.FEATURES)).astype(np.int32) + 40 * y for y in label]
    model, raw = toxicity.train_folds(spark, ids, label)
    alone = toxicity.train(ids, label)
    assert np.allclose(model.out, alone.out) and np.allclose(model.embedding, alone.embedding)
    fold = np.arange(40) // 2 % toxicity.FOLDS
    own = toxicity.train([x for x, f in zip(ids, fold) if f != 1], label[fold != 1])
    some = np.flatnonzero(fold == 1)
    assert np.allclose(raw[some], toxicity.raw_scores(own, np.concatenate([ids[k] for k in some]), np.full(len(some), 15)), atol=1e-5)
