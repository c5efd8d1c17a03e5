"""The registered classifier queries on the smallest tables against plain loops over the same sample."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalkit.llm import common, language, quality, toxicity
from shoalkit.llm.registry import queries
from tests.conftest import SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())


def known(column, folds, held_out):
    rows = duckdb.sql(f"SELECT doc_id, {column} FROM '{SMALL}/labels.parquet'").fetchall()
    return {d: y for d, y in rows if y is not None and zlib.crc32(str(d).encode()) % folds != held_out}


def isotonic(votes, labels, weights):
    """Least squares without descent, by the formula of means: vote -> value."""
    points = sorted(set(votes))
    total = {p: [0.0, 0.0] for p in points}
    for v, y, w in zip(votes, labels, weights):
        total[v][0] += w * y
        total[v][1] += w

    def mean(a, b):
        return sum(total[p][0] for p in points[a:b + 1]) / sum(total[p][1] for p in points[a:b + 1])

    return {p: max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i, p in enumerate(points)}


def test_toxicity_by_plain_loops(spark, texts):
    truth = known("toxic", 4, 2)
    examples = {}
    for d in sorted(truth):
        if d in texts:
            examples.setdefault((texts[d], truth[d]), d)
    ids = sorted(examples.values())
    stems = {d: Counter(w[:4] for w in brute.normal(t)) for d, t in texts.items()}
    terms = {s for d in ids for s in stems[d]}
    df = Counter(s for c in stems.values() for s in c if s in terms)
    idf = {s: math.log((1 + len(texts)) / (1 + df[s])) ** 2 for s in terms}

    def vector(d):
        v = {s: n * idf[s] for s, n in stems[d].items() if s in terms}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {s: x / norm for s, x in v.items()}

    unit = {d: vector(d) for d in texts}
    share = sum(truth.values()) / len(truth)
    n = Counter(truth[i] for i in ids)
    weight = {0: (1 - share) / n[0], 1: share / n[1]}

    def vote(d, leave_out=None):
        cosines = sorted(((round(sum(x * unit[i].get(s, 0.0) for s, x in unit[d].items()), 9), i) for i in ids if i != leave_out), reverse=True)
        near = [(c, i) for c, i in cosines[:40] if c > 0]
        # Ties at the edge of the neighbourhood may go either way; these tables have none.
        assert len(cosines) <= 40 or cosines[39][0] != cosines[40][0] or not cosines[39][0]
        parts = [(c / (1.001 - c) * weight[truth[i]], truth[i]) for c, i in near]
        return round(sum(w * y for w, y in parts) / sum(w for w, _ in parts), 6) if parts else None

    own = [vote(i, i) for i in ids]
    assert None not in own
    fitted = isotonic(own, [truth[i] for i in ids], [weight[truth[i]] for i in ids])
    points = sorted(fitted)
    # Between two values of the map the score is interpolated from the first vote of each.
    firsts = [p for k, p in enumerate(points) if not k or abs(fitted[p] - fitted[points[k - 1]]) > 1e-12]
    for r in queries()["op2_toxicity"](spark, SMALL).collect():
        v = vote(r.doc_id)
        want = np.interp(v, firsts, [fitted[p] for p in firsts])
        assert abs(r.score - want) < 1e-4, (r.doc_id, v)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_by_plain_loops(spark, texts):
    rows = duckdb.sql(f"SELECT doc_id, lang FROM '{SMALL}/documents.parquet'").fetchall()
    learn = {}
    for d, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            learn.setdefault(lang, []).append(d)
    order = dict(spark.createDataFrame([(d,) for d, _ in rows], "d long").select("d", F.xxhash64("d")).collect())
    names = sorted(learn)
    sample = sorted(
        ((order[d], d, lang) for lang, ds in learn.items() for d in sorted(ds, key=lambda d: (order[d], d))[:1200 // len(names)]))
    grams = {d: None if (b := language.presence(t)) is None else frozenset(np.flatnonzero(b).tolist()) for d, t in texts.items()}
    sample = [(d, lang) for _, d, lang in sample if grams[d]]
    rank, seen = [], Counter()
    for d, lang in sample:
        rank.append((seen[lang], names.index(lang), d))
        seen[lang] += 1
    marks = [d for _, _, d in sorted(rank, key=lambda r: r[:2])[:128]]
    kernel = lambda a, b: len(grams[a] & grams[b]) / math.sqrt(len(grams[a]) * len(grams[b]))
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    use = values > 1e-6 * values.max()
    features = lambda d: np.r_[np.array([kernel(d, m) for m in marks]) @ (vectors[:, use] / np.sqrt(values[use])), 1.0]
    x = np.array([features(d) for d, _ in sample])
    count = Counter(lang for _, lang in sample)
    w = np.array([1 / count[lang] for _, lang in sample])
    w *= len(w) / w.sum()
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for _, lang in sample])
    ridge = 1e-2 * len(w) * np.eye(x.shape[1])
    ridge[-1, -1] = 0
    solved = np.linalg.solve(x.T @ (x * w[:, None]) + ridge, x.T @ (y * w[:, None]))
    for r in queries()["op4_language"](spark, SMALL).collect():
        if grams[r.doc_id] is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        margins = features(r.doc_id) @ solved
        share = np.exp(3 * (margins - margins.max()))
        share /= share.sum()
        best = int(share.argmax())
        assert abs(r.score - share[best]) < 2e-3 and (r.lang_pred == names[best] or np.sort(share)[-2] > share[best] - 2e-3)


def test_quality_by_plain_loops(spark, texts):
    truth = {d: y for d, y in known("quality", 5, 0).items() if d in texts}
    order = dict(spark.createDataFrame([(d,) for d in texts], "d long").select("d", F.xxhash64("d")).collect())
    ids = sorted(truth, key=lambda d: (order[d], d))
    rows = np.array([quality.features(texts[d].encode()) for d in ids])
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    scaled, y = (rows - mean) / scale, np.array([truth[d] for d in ids])
    draw = np.random.default_rng(7)
    better = scaled[draw.choice(np.flatnonzero(y == 1), quality.PAIRS)]
    better = better - scaled[draw.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    weights = np.zeros(rows.shape[1])
    # Plain accelerated gradient steps to the same minimum of the logistic loss of the differences.
    step, ahead, t = 4 / (np.linalg.norm(better.T @ better / len(better), 2) + 4 * quality.PENALTY), weights, 1.0
    for _ in range(6000):
        slope = -better.T @ (1 / (1 + np.exp(better @ ahead))) / len(better) + quality.PENALTY * ahead
        if np.abs(slope).max() < 1e-7:
            break
        now, s = ahead - step * slope, (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, weights, t = now + (t - 1) / s * (now - weights), now, s
    raw = {d: float((np.array(quality.features(x.encode())) - mean) / scale @ ahead) for d, x in texts.items()}
    everything = known("quality", 5, 0)
    share = sum(v == 0 for v in everything.values()) / len(everything)
    cut = sorted(raw.values())[int(share * len(raw))]
    for r in queries()["op7_quality"](spark, SMALL).collect():
        want = 1 / (1 + math.exp(-max(-30, min(30, raw[r.doc_id] - cut + math.log(0.3 / 0.7)))))
        assert abs(r.score - want) < 2e-2
        assert r.predicted == (raw[r.doc_id] >= cut) or abs(raw[r.doc_id] - cut) < 1e-2


# Language: no cuts


def test_three_hundred_languages_are_learned(docs):
    rows = []
    for k in range(300):
        letters = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        rows += [(1000 * k + i, "".join(letters[(i + j) % 20] for j in range(12)), f"l{k:03d}") for i in range(12)]
    found = language.language_id(docs(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    model = language.fit(docs(rows))
    assert len(model.names) == 300 and model.landmarks.shape[1] >= 600
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in found if r.held_out]) > 0.95


def test_nothing_to_learn_keeps_lettered_texts(docs):
    rows = [(1, "some words", None), (2, "77 !!", None), (3, None, None), (4, "é", None), (None, "слова", None), (None, "слова", None)]
    assert sorted(str(r.doc_id) for r in language.with_known_language(docs(rows)).collect()) == ["1", "4", "None", "None"]
    assert language.with_known_language(docs([])).collect() == []


def test_language_stage_rejects_what_is_no_better_than_a_guess(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    kept = {r.doc_id for r in language.with_known_language(docs).select("doc_id").collect()}
    scores = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(docs).collect()}
    assert kept == {d for d, (lang, s) in scores.items() if lang != "und" and s >= 1.05 / 4}
    # All documents labelled good stay.
    good = duckdb.sql("SELECT doc_id FROM '/root/testdata/sf0.01/labels.parquet' WHERE quality = 1").fetchall()
    assert {d for d, in good} <= kept
    assert toxicity.STEM_CHARS == 4
