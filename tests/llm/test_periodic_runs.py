"""Periodic runs against plain comparison of all places and periods."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from shoalkit.llm import periodic_runs
from shoalkit.llm.registry import queries
from tests.conftest import SMALL
from tests.llm import brute


def plain_runs(words, least=24, repeats=3):
    out, seen = [], set()
    for period in range(1, len(words) // repeats + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            # Periods are tried by size, so the first one of a stretch is its smallest.
            if j > i and j + period - i >= max(least, repeats * period) and (i, j) not in {(s, e - period) for s, e in seen}:
                seen.add((i, j + period))
                out.append((i, j + period - i, period))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(rows):
    out = []
    for doc, text in rows:
        words = re.findall(brute.BLANK, text or "")
        n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        out.append((
            doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            brute.sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


@pytest.mark.parametrize("least,repeats", [(24, 3), (2, 2), (5, 2), (6, 3)])
def test_runs_against_all_places(least, repeats):
    draw = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 4)):
            words = draw.choices("abcde"[:draw.choice([1, 2, 3, 5])], k=draw.randint(0, 45))
            if words and draw.random() < 0.6:
                a, p = draw.randrange(len(words)), draw.randint(1, 9)
                words = [w if i < a else words[a + (i - a) % min(p, len(words) - a)] for i, w in enumerate(words)]
            texts.append(words)
        assert periodic_runs.runs_of(texts, least, repeats) == [plain_runs(t, least, repeats) for t in texts]


def test_squares_branch_to_the_right():
    """Each branching square is one, and cannot be moved; every run of two periods ends with one."""
    words = [random.Random(7).choice("ab") for _ in range(200)]
    values = [ord(w) for w in words] + [1000]
    index = periodic_runs.SuffixArray(periodic_runs.np.array(values))
    found = set(zip(*(x.tolist() for x in periodic_runs.branching_tandems(index))))
    for i, p in found:
        assert values[i:i + p] == values[i + p:i + 2 * p] and values[i + p] != values[i + 2 * p]
    assert {(s + n - 2 * p, p) for s, n, p in plain_runs(words, 2, 2)} <= found


def test_all_repeats_of_one_word_and_nested_runs():
    assert periodic_runs.runs_of([["a"] * 5000]) == [[(0, 5000, 1)]]
    block = ["a"] * 30 + ["b"]
    runs = periodic_runs.runs_of([block * 4])[0]
    assert (0, 124, 31) in runs and (0, 30, 1) in runs and len(runs) == 5
    assert periodic_runs.collapsed(block * 4, runs) == ["a", "b"]


def test_long_texts_take_less_than_quadratic_time():
    def seconds(words):
        start = time.process_time()
        periodic_runs.runs_of([words])
        return time.process_time() - start

    a, b = "a", "ab"
    while len(b) < 60_000:
        a, b = b, b + a
    for words in (["x"] * 120_000, list(b), (["y"] * 59 + ["z"]) * 2000):
        half = seconds(words[:len(words) // 2])
        assert seconds(words) < 3 * half + 0.5


def test_query_on_planted_rows(docs):
    cycle = "one two three four five six seven eight nine ten eleven twelve "
    rows = [(i, f"Start {cycle * 4}end " + " ".join(f"w{i}{k}" for k in range(60))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \t\n\x0b\x0c\r"), (None, cycle * 9), (None, None), (73, cycle * 3), (73, cycle * 3)]
    rows += [(74, "a " * 20_000), (75, "é\x85ñ " * 30), (76, "x" * 100_000), (2 ** 62, cycle * 5), (-1, "q\x1cq " * 24)]
    found = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_cycle(docs(rows))))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(plain_digest(rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60))


def test_operator_keeps_columns_and_takes_nothing(docs):
    out = periodic_runs.periodic_runs(docs([(1, "b a b a")]).withColumn("runs", F.lit(3)), min_words=4, min_repeats=2)
    assert out.columns == [*docs([]).columns, "runs", "collapsed"]
    row = out.first()
    assert [tuple(r) for r in row.runs] == [(0, 4, 2)] and row.collapsed == "b a" and row.score == 0.5
    assert periodic_runs.periodic_runs(docs([])).collect() == []


def test_query_on_the_test_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries()["op12_periodic_runs"](spark, SMALL).collect())
    assert got == sorted(plain_digest(rows)) and sum(r[1] > 0 for r in got) > 10
    assert got[0][7] != hashlib.sha256(b"").hexdigest()
