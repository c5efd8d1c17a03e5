"""Classifiers: exact parts against plain versions, accuracy on held-out documents, no use of held-out labels."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalkit.llm import common, language, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def ranks_well(scores, truth):
    """Share of pairs of unlike labels in the right order."""
    scores, truth = np.array(scores), np.array(truth)
    high, low = scores[truth == 1], scores[truth == 0]
    return np.mean([(h > low).mean() + (h == low).mean() / 2 for h in high])


@pytest.fixture(scope="module")
def tables(spark):
    return common.table(spark, FOLDER, "documents"), common.table(spark, FOLDER, "labels")


def test_folds_are_crc32_of_the_id(docs):
    for buckets, remainder in ((3, 1), (4, 2), (5, 0)):
        df = docs([(i, "x") for i in [*range(40), -7, None]])
        for r in df.select("doc_id", common.in_fold(buckets, remainder).alias("out"),
                           common.learnable(buckets, remainder).alias("learn")).collect():
            if r.doc_id is None:
                assert not r.out and not r.learn
            else:
                assert r.out == (zlib.crc32(str(r.doc_id).encode()) % buckets == remainder) == (not r.learn)


def test_sample_does_not_depend_on_order_and_leaves_out_contradictions(labels):
    rows = [(i, i % 2, None) for i in range(60)] + [(1, 0, None), (None, 1, None), (70, None, None), (4, 0, None)]
    one = common.labelled_sample(labels(rows), "quality", 5, 0, 10).collect()
    two = common.labelled_sample(labels(rows[::-1]), "quality", 5, 0, 10).collect()
    assert sorted(one) == sorted(two) and len(one) == 20
    assert not {1, None, 70} & {r.doc_id for r in one}


# Language


def test_presence_is_that_of_the_ngrams():
    assert language.presence(None) is None and language.presence("") is None and language.presence("12 .. 3") is None
    assert np.array_equal(language.presence("Ab, c"), language.presence("aB12c".replace("12", " ;")))
    assert language.presence("😀 🚀!") is None and language.presence("😀𐌰") is not None
    # Padded "a" holds " ", "a", " a", "a ", " a ".
    assert language.presence("a").sum() == 5
    assert language.presence("é𐌰ab").sum() > language.presence("ab").sum()


def test_kernel_against_plain_sets():
    texts = ["the cat and the dog", "der hund und die katze", "le chien et le chat", "a dog", "ein hund", "un chien"]
    grams = np.array([language.presence(t) for t in texts])
    model = language.Classifier(grams, ["de", "en", "fr"], np.array([1, 0, 2, 1, 0, 2]), landmarks=6)
    sets = [set(np.flatnonzero(g)) for g in grams]
    kernel = model._kernel(grams[:, model.active].astype(np.float32), grams.sum(axis=1))
    plain = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    order = [[round(float(v), 4) for v in row] for row in sorted(np.array(plain).tolist())]
    assert sorted([sorted(round(float(v), 4) for v in row) for row in kernel]) == sorted(sorted(r) for r in order)


def test_language_accuracy_and_leaks(spark, tables):
    docs, _ = tables
    found = language.language_id(docs).cache()
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in joined]) > 0.97
    assert all(0 <= r.score <= 1 for r in joined)
    spoiled = docs.withColumn("lang", F.when(common.in_fold(3, 1), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert language.language_id(spoiled).exceptAll(found).count() == 0
    found.unpersist()


def test_language_edges(docs):
    rows = [(1, None), (2, ""), (3, "12 !"), (None, "the words"), (4, "the words"), (4, "the words")]
    out = language.language_id(docs(rows)).collect()
    answer = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == 6 and answer[1] == answer[2] == answer[3] == ("und", 0.0) and answer[None] == answer[4]
    assert language.language_id(docs([])).collect() == []
    assert [r.lang_pred for r in language.language_id(docs([(1, "words", None)])).collect()] == ["und"]


def test_documents_without_language_go(docs):
    rows = [(i, "some english words here", "en") for i in range(9)] + [(20, "77 !!"), (21, None)]
    kept = language.with_known_language(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(r.doc_id for r in kept.collect()) == list(range(9))


# Quality


def test_quality_on_held_out_documents(spark):
    docs, labels = common.table(spark, LARGE, "documents"), common.table(spark, LARGE, "labels")
    found = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert ranks_well([r.score for r in found], [r.quality for r in found]) > 0.98
    assert np.mean([r.predicted == r.quality for r in found]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_quality_does_not_use_held_out_labels(tables):
    docs, labels = tables
    spoiled = labels.withColumn("quality", F.when(common.in_fold(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.quality_scores(docs, labels), quality.quality_scores(docs, spoiled)
    assert one.exceptAll(two).count() == 0


def test_quality_edges(docs, labels):
    rows = [(i, "Good words in a line. " * 20 if i % 2 else "### $$$ | |") for i in range(40)] + [(50, None), (51, ""), (None, "x")]
    out = quality.quality_scores(docs(rows), labels([(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (3, None, None)])).collect()
    score = {r.doc_id: r.score for r in out}
    assert len(out) == 43 and score[1] > score[0] and score[50] == score[51] and 0 <= score[50] <= 1
    assert {r.score for r in quality.quality_scores(docs(rows), labels([])).collect()} == {0.5}
    assert quality.quality_scores(docs([]), labels([])).collect() == []


def test_quality_threshold_is_that_of_all_documents(docs, labels, monkeypatch):
    monkeypatch.setattr(quality, "FETCHED", 8)
    rows = [(i, "Good words in a line. " * 20 if i % 2 else "### $$$ | |") for i in range(40)]
    rows += [(100 + i, "Other good words stand here. " * (10 + i)) for i in range(360)]
    known = [(i, i % 2, None) for i in range(40)]
    out = quality.quality_scores(docs(rows), labels(known)).collect()
    share = np.mean([y == 0 for i, y, _ in known if zlib.crc32(str(i).encode()) % 5 != 0])
    assert sum(r.predicted == 0 for r in out) == int(share * 400)


@pytest.mark.parametrize("values", [[3.0], [2.0] * 50, [float(i % 7) for i in range(90)], [10.0 ** (i % 40 - 20) for i in range(99)]])
def test_quantile_is_exact(make, monkeypatch, values):
    monkeypatch.setattr(quality, "FETCHED", 3)
    monkeypatch.setattr(quality, "BINS", 5)
    df = make([(v,) for v in values], "v double")
    for share in (0.001, 0.3, 0.5, 0.999):
        assert quality.quantile(df, "v", share) == sorted(values)[int(share * len(values))]


def test_weights_are_at_the_minimum_of_the_loss():
    draw = np.random.default_rng(0)
    rows, labels = draw.normal(size=(200, 4)), np.r_[np.ones(100, int), np.zeros(100, int)]
    rows[:100, 0] += 1
    model = quality.Ranker(rows, labels, 0.5, pairs=3000)
    scaled = (rows - model.mean) / model.scale
    again = np.random.default_rng(7)
    better = scaled[again.choice(np.flatnonzero(labels == 1), 3000)] - scaled[again.choice(np.flatnonzero(labels == 0), 3000)]

    def loss(w):
        return np.log1p(np.exp(-better @ w)).mean() + quality.PENALTY * (w @ w) / 2

    for k in range(4):
        for step in (-1e-2, 1e-2):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved) > loss(model.weights)
    # Half of the sample lies below the threshold.
    assert abs((model.score(rows) < quality.THRESHOLD).mean() - 0.5) < 0.02


# Toxicity


def test_index_against_all_cosines():
    draw = np.random.default_rng(4)
    vectors = []
    for _ in range(1000):
        terms = np.sort(draw.choice(50, draw.integers(0, 5), replace=False))
        weights = draw.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, weights / (np.sqrt(weights @ weights) or 1)))
    index = toxicity.Index(vectors, 50)
    dense = np.zeros((1000, 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 1000, 7):
        for out in (-1, q):
            cosines = np.round(dense @ dense[q], 9)
            if out >= 0:
                cosines[out] = 0
            order = np.lexsort((np.arange(1000), -cosines))
            want = [i for i in order[:20] if cosines[i] > 0]
            # Alone and among other queries.
            near, scores = index.nearest([vectors[q]], 20, [out])[0]
            again = index.nearest([vectors[(q + 5) % 1000], vectors[q], vectors[0]], 20, [-1, out, -1])[1]
            assert near.tolist() == again[0].tolist() and np.allclose(scores, again[1])
            assert near.tolist() == want and np.allclose(scores, cosines[want])


def test_toxicity_on_held_out_documents(spark):
    docs, labels = common.table(spark, LARGE, "documents"), common.table(spark, LARGE, "labels")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert ranks_well([r.score for r in found], [r.toxic for r in found]) > 0.94
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.96
    held_out = {r.doc_id for r in found}
    assert not held_out & {e.doc_id for r in found for e in r.evidence}
    assert all(e.similarity > 0 for r in found for e in r.evidence)


def test_toxicity_does_not_use_held_out_labels(tables):
    docs, labels = tables
    spoiled = labels.withColumn("toxic", F.when(common.in_fold(4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.toxicity(docs, labels), toxicity.toxicity(docs, spoiled)
    assert one.drop("evidence").exceptAll(two.drop("evidence")).count() == 0


def test_document_frequencies_cover_all_documents(docs):
    rows = [(1, "A b a"), (2, "b"), (3, None), (3, "b longer"), (4, "LONG")]
    wanted = docs([]).sparkSession.sparkContext.broadcast(toxicity._Wanted([b"a", b"b", b"z", b"long"]))
    n, found = toxicity._document_frequencies(docs(rows), wanted, 4)
    assert n == 5 and found.tolist() == [1, 3, 0, 2]


def test_stems_are_whole_characters():
    assert [toxicity.stem(w.encode()).decode() for w in ("a", "word", "words", "ñandúes", "été", "étés1")] == ["a", "word", "word", "ñand", "été", "étés"]
    terms, counts = toxicity._Wanted([b"long", b"b"]).count(b"b longer LONGEST c b b")
    assert terms.tolist() == [0, 1] and counts.tolist() == [2, 3]


def test_cosines_are_over_all_words(docs, labels):
    draw = np.random.default_rng(3)
    words = [f"{a}{b}{c}rds" for a in "abc" for b in "xyz" for c in "12345"]
    rows = [(i, " ".join(draw.choice(words, 8))) for i in range(60)]
    out = toxicity.toxicity(docs(rows), labels([(i, None, i % 2) for i in range(60)])).collect()
    held = {i: Counter(w[:4] for w in x.split()) for i, x in rows}
    found = Counter(t for c in held.values() for t in set(c))
    unit = {}
    for i, c in held.items():
        v = {t: n * np.log(61 / (1 + found[t])) ** 2 for t, n in c.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        unit[i] = {t: x / norm for t, x in v.items()}
    known = [i for i in held if zlib.crc32(str(i).encode()) % 4 != 2]
    for r in (r for r in out if r.doc_id not in known):
        # Words that only unlearned documents hold are no dimensions.
        seen = {t for i in known for t in held[i]}
        part = {t: x for t, x in unit[r.doc_id].items() if t in seen}
        norm = np.sqrt(sum(x * x for x in part.values()))
        want = sorted((sum(x * unit[i].get(t, 0) for t, x in part.items()) / norm for i in known), reverse=True)[:3]
        assert np.allclose([e.similarity for e in r.evidence], want)


def test_copies_take_one_place_among_the_examples(docs, labels):
    rows = [(i, "the same words") for i in range(50)] + [(100 + i, f"other words {i}") for i in range(12)]
    found = toxicity._examples(docs(rows), labels([(i, None, int(i > 105)) for i, _ in rows]), 4).collect()
    assert len(found) == 8 and len({r.text for r in found}) == 8


def test_toxicity_edges(docs, labels):
    rows = [(i, f"you idiot {i}" if i % 2 else f"kind people {i}") for i in range(80)] + [(90, None), (91, ""), (None, "idiot")]
    known = labels([(i, None, i % 2) for i in range(80)] + [(None, 0, 1), (2, None, None)])
    out = toxicity.toxicity(docs(rows), known).collect()
    score = {r.doc_id: r.score for r in out}
    assert len(out) == 83 and score[1] > 0.9 and score[0] < 0.1 and score[90] == score[91] and score[None] > 0.9
    assert {r.score for r in toxicity.toxicity(docs(rows), labels([])).collect()} == {0.0}
    assert toxicity.toxicity(docs([]), labels([])).collect() == []
