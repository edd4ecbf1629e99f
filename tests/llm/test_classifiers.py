import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import language_id, quality_classifier
from tracewright.llm.common import id_remainder

WORDS = {"en": "the of and this that with from house water night", "de": "der die und nicht mit eine haus wasser nacht schön", "fr": "le les des une est dans maison eau nuit été", "es": "el los una por con casa agua noche año niño"}


def text_in(lang, seed, n=30):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS[lang].split()) for _ in range(n))


def test_remainder_is_crc32(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", id_remainder("doc_id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)


def test_language_of_held_out_texts(make_docs, odd_rows):
    rows = [(1000 + i, text_in(lang, i), lang) for i, lang in enumerate([*WORDS] * 40)]
    docs = make_docs(rows + odd_rows)
    found = language_id.identify_language(docs, learn_from=id_remainder("doc_id", 4) != 2).collect()
    assert len(found) == len(rows) + len(odd_rows)
    by_id = {r.doc_id: r for r in found}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum(by_id[i].lang_pred == lang for i, lang in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    assert [by_id[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and by_id[1].score == 0


def made_up(n, draw):
    """Languages of their own letters and words, as related as chance has it."""
    langs = {}
    for i in range(n):
        letters = draw.sample("abcdefghijklmnopqrstuvwxyzäöüñçéøłšđжщюя", 9)
        langs[f"x{i:03d}"] = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(30)]
    return langs


def test_three_hundred_languages_in_one_part_and_in_several(make_docs, monkeypatch):
    draw = random.Random(4)
    langs = made_up(300, draw)
    rows = [(i, " ".join(draw.choice(langs[lang]) for _ in range(40)), lang) for i, lang in enumerate([*langs] * 6)]
    docs = make_docs(rows).repartition(4)
    learn = F.col("doc_id") < 1500
    found = {r.doc_id: r for r in language_id.identify_language(docs, learn_from=learn).collect()}
    held = [(found[i].lang_pred, lang) for i, _, lang in rows if i >= 1500]
    assert {p for p, _ in held} == {*langs}
    assert np.mean([a == b for a, b in held]) > 0.95
    monkeypatch.setattr(language_id, "MODEL_BYTES", 8 << 20)
    parts = language_id.train(docs.where(learn))
    assert len(parts) > 2 and set().union(*[p for _, p in parts]) == set(range(len(parts[0][0].families)))
    assert all(len(f) <= language_id.FAMILY_LANGUAGES for f in parts[0][0].families)
    again = language_id.identify_language(docs, learn_from=learn).collect()
    assert len(again) == len(rows) and all(found[r.doc_id] == r for r in again)


def test_votes_match_pairs_taken_one_by_one():
    draw = np.random.default_rng(3)
    langs = ["a", "b", "c", "d"]
    model = language_id.Model([langs], np.zeros((3, 0)), {0: draw.normal(size=(3, 6))})
    for _ in range(200):
        x = draw.normal(size=2)
        wins, total = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (i, j), w in zip([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], model.within[0].T, strict=True):
            m = x[0] * w[0] + x[1] * w[1] + w[2]
            wins[langs[i] if m >= 0 else langs[j]] += 1
            total[langs[i]] += m
            total[langs[j]] -= m
        assert model.language(x, 0)[0] == max(langs, key=lambda c: (wins[c], total[c]))


def test_listed_and_unlisted_codes_meet_in_families():
    means = {c: np.full(language_id.FOLDED, float(i)) for i, c in enumerate(["en", "de", "en-US", "pt_BR", "fr", "qx", "qy", *[f"z{i}" for i in range(40)]])}
    found = language_id.families_of(means)
    assert ["de", "en", "en-US"] in found and ["fr", "pt_BR"] in found
    assert sorted(c for f in found for c in f) == sorted(means) and max(map(len, found)) <= language_id.FAMILY_LANGUAGES


def test_language_without_lessons(make_docs):
    docs = make_docs([(1, "some words here"), (2, None)])
    assert {r.lang_pred for r in language_id.identify_language(docs, learn_from=F.lit(False)).collect()} == {"und"}
    assert language_id.identify_language(docs.limit(0), learn_from=F.lit(True)).count() == 0


def test_language_features_dont_depend_on_slices(monkeypatch):
    text = text_in("fr", 3, 500)
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "SLICE", 97)
    assert np.allclose(language_id.features(text), whole)


def test_quality_of_held_out_texts(spark, make_docs, odd_rows):
    good = [(i, text_in("en", i), "en") for i in range(1000, 1150)]
    bad = [(i, " ".join(w + "###" for w in text_in("en", i).split()), "en") for i in range(2000, 2150)]
    docs = make_docs(good + bad + odd_rows)
    marks = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(None, 1, 0), (9, None, 0), (10, 7, 0), (999_999, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = quality_classifier.score_quality(docs, labels, learn_from=id_remainder("doc_id", 3) != 1).collect()
    assert len(found) == len(good) + len(bad) + len(odd_rows)
    held = [(r.predicted, int(r.doc_id < 2000)) for r in found if r.doc_id and r.doc_id >= 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_labels_both_ways_and_repeated_ids(spark, make_docs):
    """Labels that disagree don't teach, and rows that repeat an id teach once."""
    docs = make_docs([(1, "good words here")] * 500 + [(1, "other words")] * 3 + [(2, "### ###"), (3, "mixed"), (4, "good words"), (5, "### $$$")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (5, 0)], "doc_id long, quality int")
    taught = []
    learned = quality_classifier.train(docs, labels)
    once = docs.dropDuplicates(["doc_id", "text"]).where("text != 'mixed'")
    for text in ("good words here", "other words"):
        taught.append(quality_classifier.train(once.where(f"doc_id != 1 or text = '{text}'"), labels.where("doc_id != 3")))
    assert any(np.array_equal(learned[0], t[0]) and learned[1] == t[1] for t in taught)


def slow_leader(examples):
    """The same updates with one dictionary per number and plain loops."""
    c = quality_classifier
    z, n = {}, {}

    def weight(i):
        l1, l2 = (0, 0) if i == 1 << c.BITS else (c.L1, c.L2)
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((c.BETA + np.sqrt(n.get(i, 0.0))) / c.ALPHA + l2)

    order = np.random.default_rng(11)
    for _ in range(c.EPOCHS):
        for k in order.permutation(len(examples)):
            ids, values, label = examples[k]
            w = [weight(i) for i in ids]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, values, strict=True))))
            for i, x, wi in zip(ids, values, w, strict=True):
                g, was = (p - label) * x, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (np.sqrt(was + g * g) - np.sqrt(was)) / c.ALPHA * wi
                n[i] = was + g * g
    return weight


def test_leader_matches_plain_updates():
    draw = np.random.default_rng(5)
    bias = 1 << quality_classifier.BITS
    examples = []
    for _ in range(40):
        ids = np.append(np.sort(draw.choice(50, 8, replace=False)), bias).astype(np.int32)
        examples.append((ids, np.append(draw.random(8), 1.0).astype(np.float32), int(draw.integers(2))))
    weights, at_bias = quality_classifier.follow_the_leader(examples)
    want = slow_leader([(i.tolist(), v.astype(float).tolist(), y) for i, v, y in examples])
    assert np.allclose(weights[:50], [want(i) for i in range(50)], atol=1e-4) and abs(at_bias - want(bias)) < 1e-4
    assert not weights[50:].any()


def test_quality_without_labels(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, "a b"), (2, None)])
    assert {r.score for r in quality_classifier.score_quality(docs, labels, learn_from=F.lit(True)).collect()} == {0.5}
    assert quality_classifier.score_quality(docs.limit(0), labels, learn_from=F.lit(True)).count() == 0


def test_quality_features_dont_depend_on_slices(monkeypatch):
    text = text_in("en", 5, 700)
    whole = np.bincount(quality_classifier.feature_ids(text))
    monkeypatch.setattr(quality_classifier, "WORDS", 13)
    assert (np.bincount(quality_classifier.feature_ids(text), minlength=len(whole)) == whole).all()
