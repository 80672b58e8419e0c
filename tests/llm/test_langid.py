import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid

VOWELS = {"en": ["th", "he", "in", "er", "an", "on"], "de": ["sch", "ein", "ich", "ü", "ß", "ung"], "fr": ["eau", "ou", "é", "que", "ç", "tion"]}


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(VOWELS))
        words = [" ".join("".join(rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60)))]
        out.append((k, words[0], lang if k % 10 else None, "s", 1, lang))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string, n_chars bigint, truth string").repartition(3)


def test_held_out_accuracy(labelled):
    found = langid.identify(labelled).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == r.truth for r in held) / len(held) > 0.97


def test_only_text_is_an_input(labelled):
    was = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(labelled).collect()}
    hidden = labelled.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    now = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(hidden).collect()}
    assert {k: v[0] for k, v in now.items()} == {k: v[0] for k, v in was.items()} and "xx" not in {v[0] for v in now.values()}
    assert all(abs(now[k][1] - was[k][1]) < 1e-6 for k in was)


def test_kernel_is_blended_presence():
    a, b = "The river, 12 stones!", "river of STONE é"
    assert len(langid.slots(a)) == len(grams(a)) and len(np.intersect1d(langid.slots(a), langid.slots(b))) == len(grams(a) & grams(b))
    assert len(langid.slots("")) == len(grams(""))


def grams(text):
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in t:
        t = t.replace("  ", " ")
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


@pytest.mark.parametrize("landmarks", [100, 7])
def test_responses_equal_kernel_evaluations(landmarks):
    """Folded weights give what the kernel between texts and landmarks gives, evaluated on sets of strings."""
    rows, others = corpus(60, 4), corpus(30, 11)
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append(r[1])
    languages = sorted(by)
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    fitted, truth = [t for x in languages for t in by[x]], np.array([k for k, x in enumerate(languages) for _ in by[x]])
    marks = [t for x in languages for t in by[x][:landmarks]]
    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(between)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    design = lambda texts: np.c_[np.array([[kernel(t, b) for b in marks] for t in texts]) @ root, np.ones(len(texts))]
    z, y = design(fitted), np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    w = (len(fitted) / len(languages) / np.bincount(truth))[truth][:, None]
    ridge = langid.RIDGE * len(z) * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ (w * z) + ridge, z.T @ (w * y))
    model = langid.fit({x: [langid.slots(t).astype(np.int32).tobytes() for t in by[x]] for x in languages}, landmarks=landmarks)
    texts = [r[1] for r in (*rows, *others)]
    found, sizes = langid.responses(texts, model)
    assert sizes.tolist() == [len(grams(t)) for t in texts]  # no two n-grams of these texts share a slot
    assert np.abs(found - design(texts) @ beta).max() < 1e-5
    names, scores, _ = langid.predict(texts, model)
    assert names == [languages[k] for k in (design(texts) @ beta).argmax(1)] and all(0.5 <= s <= 1 for s in scores)


def test_texts_in_no_learned_language_go(spark):
    rng = random.Random(3)
    rows = [r[:5] for r in corpus(600)]
    letters = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(80))
    strange = [(9000 + k, letters("bdfgjkmpvwxyz" if k % 2 else "\u0430\u0431\u0432\u0433\u0434\u0435\u0436"), None, "s", 1) for k in range(20)]
    short = [(9500, "xk", None, "s", 1), (9501, "\u0436", "en", "s", 1), (9502, "123", None, "s", 1)]
    kept = langid.keep_identified(spark.createDataFrame([*rows, *strange, *short], "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    assert sorted(r.doc_id for r in kept) == [r[0] for r in rows] + [9500, 9501]
    truth = {r[0]: r[5] for r in corpus(600)}
    filled = [r for r in kept if r.doc_id in truth and r.doc_id % 10 == 0]
    assert sum(r.lang == truth[r.doc_id] for r in filled) > 0.95 * len(filled) and all(r.lang == truth[r.doc_id] for r in kept if r.doc_id in truth and r.doc_id % 10)


def test_more_labels_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(k, r[1], r[5]) for k, r in enumerate(corpus(500))] + [(1000 + k, "some dirty label", f"x{k}") for k in range(40)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {r.lang_pred for r in found} == set(VOWELS)


def test_one_key_in_many_rows_is_learned_from_once(spark):
    df = spark.range(3000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    assert {k: len(x) for k, x in langid._training(df, "text", "doc_id", "lang", F.lit(False), 400).items()} == {"en": 1}


def test_odd_rows_and_names(odd):
    out = langid.identify(odd)
    found = out.collect()
    assert len(found) == odd.count() and set(odd.columns) <= set(out.columns)
    for r in found:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr", "de")
        if r.doc_id is None:
            assert r.held_out is False
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.known for r in found) and all(r.lang_pred != "und" for r in found if r.known)


def test_nothing_to_learn_from(docs, nothing):
    out = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in out.collect()} == {("und", 0.0)}
    unlabelled = langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.doc_id for r in unlabelled} == {r.doc_id for r in docs.collect() if langid.lettered(r.text)} and {r.lang for r in unlabelled} == {None}
    assert langid.identify(nothing).count() == 0 and langid.keep_identified(nothing).count() == 0


def test_many_languages_share_the_training_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 30)
    monkeypatch.setattr(langid, "LANDMARKS", 6)
    rows = [(k, r[1], r[5]) for k, r in enumerate(corpus(400, 8))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    by = langid._training(df, "text", "doc_id", "lang", F.lit(False), 400)
    assert {len(x) for x in by.values()} == {10}
    truth = dict((k, lang) for k, _, lang in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in langid.identify(df).collect()) > 380
