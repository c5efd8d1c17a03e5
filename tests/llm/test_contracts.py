"""Operators with an exact contract against the plain version, on planted rows and on the test tables."""

import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from shoalkit import scaling
from shoalkit.llm import common, decontamination, licenses, near_duplicates, packing, personal_data, rules, substrings
from shoalkit.llm.components import components
from shoalkit.llm.registry import queries
from tests.conftest import SMALL
from tests.llm import brute

SYLLABLES = ["an", "er", "the", "of", "stra", "ße", "ñ", "Mit", "LICENSE", "cc", "by", "42", "x#y", "|", "été"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(n))


def planted():
    """Copies, near copies, shared passages, hostile texts, nulls and repeated rows."""
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split(" ")
    rows = [(i, base) for i in range(8)]
    rows += [(10 + i, " ".join(words[:i * 9] + ["changed"] + words[i * 9 + 1:])) for i in range(10)]
    rows += [(30 + i, f"{prose(30 + i, 40)} {passage}\n{prose(60 + i, 20)}") for i in range(6)]
    rows += [(40, passage + " " + passage), (41, prose(41, 34)), (42, prose(41, 34)), (43, prose(43, 35)), (43, prose(43, 35))]
    rows += [(50, None), (51, ""), (52, " \t\n\x0b\x0c\r"), (53, "one"), (54, "\x1c \x85 \xa0   two"), (None, base), (None, None)]
    rows += [(60, "a " * 5000), (61, "same line\nsame line\n\n x \nsame line"), (62, "\x1c".join("abcd" * 30))]
    rows += [(70, prose(70, 30_000)), (-1, "A B c D"), (2 ** 62, "a b C d")]
    return rows


def taken(df, n):
    got = [tuple(r)[:n] for r in df.collect()]
    return sorted(got, key=repr)


def expected(rows):
    return sorted(map(tuple, rows), key=repr)


ITEMS = [
    (1, prose(2, 60)), (2, "short Item here"), (2, "short Item here"), (3, None), (4, ""), (5, "!!!"), (6, prose(6, 13)),
    (None, prose(7, 20)), (10, "one"),
]


def with_items(rows):
    inside = prose(6, 13)
    return rows + [
        (80, f"{prose(80, 400)} short item HERE {prose(81, 20)}"), (81, f"{inside}"), (82, prose(7, 20) + " x"),
        (83, "-".join(inside.split(" "))), (84, " ".join(inside.split(" ")[1:])),
    ]


CASES = [
    ("near", lambda d, b: near_duplicates.near_duplicates(d), lambda r, i: brute.near_duplicates(r), 3),
    ("passages", lambda d, b: substrings.repeated_passages(d), lambda r, i: brute.repeated_passages(r), 4),
    ("contamination", decontamination.contamination, brute.contamination, 6),
    ("licenses", lambda d, b: licenses.license_scan(d), lambda r, i: brute.licenses(r), 6),
    ("rules", lambda d, b: rules.quality_rules(d), lambda r, i: brute.rules(r), 7),
    ("personal", lambda d, b: personal_data.personal_data(d), lambda r, i: brute.personal(r), 6),
]


@pytest.mark.parametrize("name,run,plain,columns", CASES, ids=[c[0] for c in CASES])
def test_planted_rows(docs, benchmark, name, run, plain, columns):
    rows = with_items(planted())
    assert taken(run(docs(rows), benchmark(ITEMS)), columns) == expected(plain(rows, ITEMS))


@pytest.mark.parametrize("name,run,plain,columns", CASES, ids=[c[0] for c in CASES])
def test_empty_tables(docs, benchmark, name, run, plain, columns):
    assert run(docs([]), benchmark([])).collect() == []
    rows = [(1, "some words"), (1, "some words")]
    assert taken(run(docs(rows), benchmark([])), columns) == expected(plain(rows, []))


QUERIES = {
    "op1_simhash": (lambda r, i: brute.near_duplicates(r), 3), "op5_substrings": (lambda r, i: brute.repeated_passages(r), 4),
    "op6_decontamination": (brute.contamination, 6), "op8_personal_data": (lambda r, i: brute.personal(r), 6),
    "op9_rules": (lambda r, i: brute.rules(r), 7), "op10_licenses": (lambda r, i: brute.licenses(r), 6),
}


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_the_test_tables(spark, name):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    plain, columns = QUERIES[name]
    assert taken(queries()[name](spark, SMALL), columns) == expected(plain(rows, items))


# Near copies


def test_fingerprints_against_plain_words():
    for _, text in planted()[:40]:
        assert near_duplicates.fingerprint(None if text is None else text.encode()) % 2 ** 64 == brute.simhash(text)


@pytest.mark.parametrize("key_bytes", [3, 4, 5])
def test_links_lose_no_pair_in_hot_lists(spark, key_bytes):
    draw = np.random.default_rng(5)
    # A ball around one print, denser than a short list, and unrelated prints.
    ball = [int(draw.integers(2 ** 63)) ^ 0 for _ in range(1)]
    prints = set(ball)
    for _ in range(1500):
        bits = draw.choice(64, 2, replace=False)
        prints.add(ball[0] ^ (1 << int(bits[0])) ^ (1 << int(bits[1])))
    prints |= {int(x) for x in draw.integers(2 ** 63, size=300)}
    values = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(v.astype(np.int64)),) for v in values], "fp long")
    found = near_duplicates.links(df, key_bytes=key_bytes).collect()
    assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= 3 for r in found) or len(found) < 40 * len(values)
    parent = {int(v.astype(np.int64)): int(v.astype(np.int64)) for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r.a)] = root(r.b)
    for i, v in enumerate(values):
        for w in values[i + 1:][np.bitwise_count(values[i + 1:] ^ v) <= 3]:
            assert root(int(v.astype(np.int64))) == root(int(w.astype(np.int64)))


def test_links_are_a_forest_per_list():
    prints = np.arange(5000, dtype=np.uint64)
    a, b = near_duplicates._links(np.zeros(5000, int), prints, 3)
    assert len(a) < 5000 and len(set(a.tolist())) == len(a)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7000, 7000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_one_document_of_each_group_stays(docs):
    rows = planted()
    kept = near_duplicates.without_near_duplicates(docs(rows))
    assert kept.columns == docs(rows).columns
    classes = {}
    for doc, _, component in brute.near_duplicates(rows):
        classes.setdefault(component, []).append(doc)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(list(classes))
    assert near_duplicates.without_near_duplicates(docs([(None, "a b c"), (None, "a b c")])).count() == 1


# Repeated passages


@pytest.mark.parametrize("window", [21, 22, 35, 50])
def test_every_alignment_of_a_passage(docs, window):
    passage = prose(5, window)
    rows = [(i, f"{prose(100 + i, i)} {passage} {prose(200 + i, 3)}".strip()) for i in range(45)]
    assert taken(substrings.repeated_passages(docs(rows), window), 4) == expected(brute.repeated_passages(rows, window))


def test_texts_longer_than_a_piece(docs, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 50)
    words = prose(9, 400).split(" ")
    assert substrings._Rolling(35).pieces(words) is not None
    pieces = list(substrings._Rolling(35).pieces(words))
    monkeypatch.undo()
    whole = next(substrings._Rolling(35).pieces(words))
    assert np.array_equal(np.concatenate([p[1] for p in pieces]), whole[1])
    assert np.array_equal(np.concatenate([p[2] for p in pieces]), whole[2])


# Decontamination


def test_search_in_several_passes(docs, benchmark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_BYTES", 40)
    rows = with_items(planted())
    assert taken(decontamination.contamination(docs(rows), benchmark(ITEMS)), 6) == expected(brute.contamination(rows, ITEMS))


def test_one_block_of_the_benchmark_at_a_time(spark, docs, benchmark, monkeypatch):
    """Blocks together are the benchmark; none is much larger than a pass, and all are released."""
    items = [(i, prose(1000 + i, 40)) for i in range(200)]
    size = sum(len(t.encode()) for _, t in items)
    monkeypatch.setattr(decontamination, "PASS_BYTES", size // 4)
    held = []
    monkeypatch.setattr(decontamination, "_rows", lambda blocks, k, own=decontamination._rows: held.append(own(blocks, k)) or held[-1])
    rows = [(i, f"{prose(1000 + i, 40)} end" if i % 3 else prose(5000 + i, 40)) for i in range(120)]
    got = taken(decontamination.contamination(docs(rows), benchmark(items)), 6)
    assert got == expected(brute.contamination(rows, items)) and len(held) in (4, 5)
    assert sorted(r[0] for h in held for r in h) == sorted(str(i) for i, _ in items)
    assert max(sum(len(r[1]) for r in h) for h in held) < size // 2


def test_clean_documents_stay_with_their_columns(docs, benchmark):
    rows = with_items(planted())
    kept = decontamination.without_contaminated(docs(rows), benchmark(ITEMS))
    assert kept.columns == docs(rows).columns
    clean = Counter(r[0] for r in brute.contamination(rows, ITEMS) if not r[5])
    assert Counter(r.doc_id for r in kept.collect()) == clean


def test_workers_keep_nothing_of_another_benchmark(docs, benchmark):
    rows = [(i, f"alpha beta {i}") for i in range(20)]
    for n in range(12):
        items = [(n, f"beta {n}")]
        assert taken(decontamination.contamination(docs(rows), benchmark(items)), 6) == expected(brute.contamination(rows, items))


def test_shift_table_against_all_places():
    draw = random.Random(3)
    for size in (1, 2, 3, 13):
        items = [(i, " ".join(draw.choices("abcde", k=size))) for i in range(6)]
        texts = [" ".join(draw.choices("abcdef", k=n)).encode() for n in (0, 1, 5, 500, 20_000)]
        found = decontamination.Searcher([(i, t.encode()) for i, t in items]).search(texts)
        for (_, hit, named), (_, _, n_hit, _, _, _), text in zip(
                found, brute.contamination([(0, t.decode()) for t in texts], items), texts):
            assert int(hit.sum()) == n_hit


# Rules


def test_rules_stay_inside_the_engine(spark):
    plan = queries()["op9_rules"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_no_text_is_too_long_and_no_language_too_rare(docs):
    draw = random.Random(8)
    ending = ["ssa", "lla", "sta", "n", "t"]
    finnish = " ".join(draw.choice(["ja", "on", "ei", "se"]) if k % 4 == 0 else "".join(
        draw.choices(["ta", "lo", "ki", "sau", "na", "ve", "hi"], k=3)) + draw.choice(ending) for k in range(200))
    words = [f"w{k % 7000}" if k % 5 else "the" for k in range(150_000)]
    draw.shuffle(words)
    noise = " ".join(f"{draw.getrandbits(48):012x}" for _ in range(200))
    rows = [(1, " ".join(words)), (2, finnish), (3, noise)]
    assert {r.doc_id: r.kept for r in rules.quality_rules(docs(rows)).collect()} == {1: True, 2: True, 3: False}


def test_thresholds_are_a_table(docs):
    rows = [(1, prose(1, 80)), (2, "word " * 80), (3, None)]
    kept = {r.doc_id: r.kept for r in rules.apply_rules(docs(rows), [("n_words", 10, 79)]).collect()}
    assert kept == {1: False, 2: False, 3: False}
    kept = {r.doc_id: r.kept for r in rules.apply_rules(docs(rows), []).collect()}
    assert kept == {1: True, 2: False, 3: False}


# Licences


@pytest.mark.parametrize("text,postfix", [
    ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
    ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["mit", "apache-2.0", "or", "bsd-3-clause", "and"]),
    ("GPL-2.0 WITH Classpath-exception-2.0 or MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]),
    ("MIT and", ["mit"]), ("and MIT", []), ("((MIT)", []), ("MIT) x", ["mit"]), ("", []), ("MIT Apache", ["mit"]),
])
def test_expressions(text, postfix):
    assert licenses.parse_expression(text) == postfix


def test_long_expressions_are_read_whole():
    names = [f"x{i}" for i in range(3000)]
    for text in (" AND ".join(names + ["GPL-3.0"]), "(" + " AND ".join(names + ["GPL-3.0"]) + ")"):
        labels, score = licenses.evaluate(licenses.parse_expression(text))
        assert labels == {*names, "gpl-3.0"} and score == 0.4
    assert licenses.parse_expression("MIT with (A or B)") == ["mit"]


def seconds(run):
    start = time.process_time()
    run()
    return time.process_time() - start


@pytest.mark.parametrize("unit", [
    "spdx-license-identifier: mit or ", "mit license ", "license-expression: (", "spdx-license-identifier: (mit and ( ",
    "cc by nc cc by ", "license-expression: a or b and c with d "])
def test_licences_take_linear_time(unit):
    scanner, text = licenses.Scanner(), (unit * (500_000 // len(unit))).encode()
    scanner.scan(text[:1000])
    half = seconds(lambda: scanner.scan(text))
    assert seconds(lambda: scanner.scan(text * 2)) < 3 * half + 0.3


@pytest.mark.parametrize("unit", ["a@b.co 1.2.3.4 +12 345 678 901 ", "(02) 5551 2345 x ", "4111 1111 1111 1111 9 "])
def test_personal_spans_take_linear_time(unit, field):
    text = unit * (60_000 // len(unit))
    personal_data.all_spans(text[:1000], field)
    half = seconds(lambda: personal_data.all_spans(text, field))
    assert seconds(lambda: personal_data.all_spans(text * 2, field)) < 3 * half + 0.3


def plain_licences(text):
    """Labels and score by searching every phrase and tag for itself, and Python's own operators."""
    words = " " + " ".join(brute.normal(text)) + " "
    phrases = {**licenses.BASE_PHRASES, **licenses.NOTICE_PHRASES}
    labels = {label for phrase, label in phrases.items() if f" {phrase} " in words}
    scores = [licenses.freedom(label) for label in labels]
    for tag in re.finditer("spdx-license-identifier:|licen[sc]e-expression:", brute.lower(text)):
        tokens = re.match(r"(?:[ \t]*(?:[()]|[a-z0-9.+:-]+))*", brute.lower(text)[tag.end():])[0]
        tokens = re.findall(r"[()]|[a-z0-9.+:-]+", tokens)
        for n in range(len(tokens), 0, -1):
            if (value := plain_expression(tokens[:n])) is not None:
                labels |= value[0]
                scores.append(value[1])
                break
    return ",".join(sorted(labels)), min(scores) if scores else 0.5


def plain_expression(tokens):
    """Recursive descent: (labels, freedom), or None if the tokens are not one expression."""
    def operand(at):
        if at < len(tokens) and tokens[at] == "(":
            inner = level(at + 1, "or")
            return (inner[0], inner[1] + 1) if inner and inner[1] < len(tokens) and tokens[inner[1]] == ")" else None
        if at >= len(tokens) or tokens[at] in ("(", ")", "and", "or", "with"):
            return None
        name = tokens[at].rstrip(".:+") or tokens[at]
        return ({name}, licenses.freedom(name)), at + 1

    def level(at, word):
        below = {"or": "and", "and": "with"}.get(word)
        found = level(at, below) if below else operand(at)
        while found and found[1] < len(tokens) and tokens[found[1]] == word:
            other = level(found[1] + 1, below) if below else operand(found[1] + 1)
            if not other or word == "with" and tokens[found[1] + 1] == "(":
                return None
            (a, x), (b, y) = found[0], other[0]
            both = ({f"{p}-with-{q}" for p in a for q in b}, x) if word == "with" else (a | b, max(x, y) if word == "or" else min(x, y))
            found = both, other[1]
        return found

    found = level(0, "or")
    return found[0] if found and found[1] == len(tokens) else None


def test_labels_and_score_against_a_plain_parser(spark):
    draw = random.Random(12)
    pieces = ["mit", "GPL-2.0+", "(", ")", "and", "OR", "with", "Classpath-exception", "cc0", ",", "\n", "spdx-license-identifier:",
              "license-expression:", "CC BY", "mit license", "all rights reserved", "x."]
    scanner = licenses.Scanner()
    for _ in range(1500):
        text = " ".join(draw.choices(pieces, k=draw.randint(1, 14)))
        _, _, _, labels, score = scanner.scan(text.encode())
        assert (",".join(sorted(labels)), score) == plain_licences(text), text
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    for r in queries()["op10_licenses"](spark, SMALL).collect():
        assert (r.labels, r.score) == plain_licences(rows[r.doc_id])


def test_expressions_are_evaluated():
    assert licenses.evaluate(["gpl-3.0", "mit", "or"]) == ({"gpl-3.0", "mit"}, 1.0)
    assert licenses.evaluate(["gpl-3.0", "mit", "and"])[1] == 0.4
    n, starts, base, labels, score = licenses.Scanner().scan(b"// SPDX-License-Identifier: (MIT OR GPL-2.0+)\ncode. CC BY, CC-BY")
    assert base == {"cc-by"} and labels == {"mit", "gpl-2.0", "cc-by"} and len(starts) == 2 and score == 0.9


# Personal data

HOSTILE = [
    "a@b.c@d.e.f x@y z@@w.q %+@a-.-.b", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (017) 555-7713 +1 +12 ++49 30 1234567-", "é@é.de ü.x@y.z 　4111111111111111", "1" * 3000, "1 " * 3000, "." * 3000, "a" * 5000 + "@",
    "+1" * 500, "1.1." * 700, "a@b" * 900,
]


@pytest.mark.parametrize("text", HOSTILE)
def test_base_spans_against_plain_patterns(text):
    spans = personal_data.base_spans(text)
    assert brute.sha(personal_data._joined(spans)) == brute.personal([(0, text)])[0][5]


@pytest.fixture(scope="module")
def field(spark):
    return personal_data.fit(common.table(spark, SMALL, "documents").select("text"))


def test_field_finds_what_patterns_miss(field):
    spans = lambda text: [(k, text[s:e]) for s, e, k in personal_data.all_spans(text, field)[1]]
    assert spans("mail a.b@c.example.com or +1 (377) 555-0271.") == [("email", "a.b@c.example.com"), ("phone", "+1 (377) 555-0271")]
    assert spans("no personal data in version 2.0, chapter 3 of 1999") == []
    assert personal_data.redact("x a@b.cd y", [(2, 8, "email")]) == "x [EMAIL] y"


def test_decoding_is_the_best_cut(field):
    """Against all ways to cut short zones."""
    for text in ("+1 (2) 5", "a@b.c", "1.2.3.4", "12-3"):
        lattice = personal_data.Lattice(text, 0, len(text))

        def best(i, kind):
            if i == lattice.n:
                return 0.0, []
            options = []
            value, rest = best(i + 1, 0)
            options.append((field.steps[kind, 0] + field.outside[0] + value, rest))
            for j in range(i + 1, lattice.n + 1):
                firsts, rows = lattice.candidates(j)
                if i in firsts:
                    scores = np.array(rows[firsts.index(i)], float) @ field.spans
                    for k in range(1, 5):
                        value, rest = best(j, k)
                        options.append((field.steps[kind, k] + scores[k - 1] + value, [(i, j, k), *rest]))
            return max(options, key=lambda o: o[0])

        assert field.decode(lattice) == best(0, 0)[1]


def test_gradient_is_that_of_the_likelihood(spark):
    """Against differences of the log-likelihood summed over all cuts."""
    field = personal_data.Field()
    draw = np.random.default_rng(1)
    field.spans += draw.normal(size=field.spans.shape)
    field.steps += draw.normal(size=field.steps.shape)
    lattice = personal_data.Lattice("+1 (2)", 0, 6).filled()
    truth = [(0, 2, 4)]

    def likelihood():
        scores = lattice.rows @ field.spans
        total = personal_data._logsum(field._forward(lattice, scores)[0][lattice.n][None, :], 1)[0]
        row = {(i, j): r for j, ends in enumerate(lattice.ends) for i, r in ends}[0, 2]
        path = field.steps[0, 4] + scores[row, 3] + field.steps[4, 0] + (lattice.n - 3) * field.steps[0, 0]
        return path + (lattice.n - 2) * field.outside[0] - total

    with np.errstate(divide="ignore"):
        _, spans, steps = field.gradient(lattice, truth)
        for weights, slopes in ((field.spans, spans), (field.steps, steps)):
            for at in [(0, 3), (1, 2), (4, 0)]:
                before = likelihood()
                weights[at] += 1e-5
                assert abs((likelihood() - before) / 1e-5 - slopes[at]) < 1e-3
                weights[at] -= 1e-5


def test_redaction_keeps_columns(docs):
    rows = [(1, "write a@b.cd now"), (2, None), (3, "")]
    out = {r.doc_id: r for r in personal_data.without_personal_data(docs(rows)).collect()}
    assert out[1].text == "write [EMAIL] now" and out[1].n_chars == 17 and out[2].text is None and out[3].text == ""
    assert personal_data.without_personal_data(docs(rows)).columns == docs(rows).columns


# Packing


def test_bounds_against_all_choices():
    from itertools import combinations

    draw = random.Random(2)
    for _ in range(20):
        lengths = sorted(draw.sample(range(1, 60), draw.randint(1, 9)))
        counts = [draw.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 20):
            def padding(bounds):
                return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))

            plain = min(padding([*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
            found = packing.bucket_bounds(lengths, counts, k)
            assert len(found) <= k and found[-1] == lengths[-1] and padding(found) == plain
    assert packing.bucket_bounds([], []) == []


def test_no_token_is_lost_and_batches_keep_the_budget(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 10)
    rows = planted()
    out = [r for r in packing.pack(docs(rows), max_tokens=64, buckets=4, batch_tokens=256).collect()]
    encode = packing.encoder(packing.read_ranks(packing.TOKENIZER)).encode
    want, got = Counter(), Counter()
    for doc, text in rows:
        want[doc] += len(encode(text or ""))
    for r in out:
        got[r.doc_id] += r.n_tokens
    assert got == want
    batches, slots = Counter(), set()
    for r in out:
        assert (r.batch is None) == (r.n_tokens == 0) and r.start_token == 64 * r.piece
        if r.batch:
            assert r.n_tokens <= r.width <= 64
            batches[r.batch, r.width] += 1
            assert (r.batch, r.slot) not in slots
            slots.add((r.batch, r.slot))
    assert all(n * width <= max(256, width) for (_, width), n in batches.items())
    assert sum(n for n in batches.values()) == sum(r.n_tokens > 0 for r in out)


@pytest.mark.parametrize("unit", [" ", "\n", "a", "#", "\t ", "é"])
def test_long_runs_are_encoded(unit):
    own = packing.encoder(packing.read_ranks(packing.TOKENIZER))
    for n in (999, 1000, 1001, 20_000):
        for text in (unit * n, "x" + unit * n, unit * n + "x", f"a {unit * n}\n{unit * n} b"):
            whole = own.split.encode_ordinary(text)
            assert own.encode(text) == whole and own.count(text) == len(whole) and own.decode(whole).decode() == text
    start = time.process_time()
    assert own.decode(own.encode(unit * (5_000_000 // len(unit)))) == unit.encode() * (5_000_000 // len(unit))
    assert time.process_time() - start < 60


def test_packing_query_against_a_plain_version(spark):
    """Pieces of the whole encoding, the cheapest bounds, and batches that fit."""
    own = packing.encoder(packing.read_ranks(packing.TOKENIZER))
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    want = []
    for doc, text in rows:
        n = len(own.split.encode_ordinary(text or ""))
        want += [(doc, k, k * 2048, min(2048, n - k * 2048)) for k in range(max(1, -(-n // 2048)))]
    found = queries()["op3_packing"](spark, SMALL).collect()
    assert sorted(tuple(r)[:4] for r in found) == sorted(want)
    bounds = sorted({r.width for r in found if r.n_tokens})
    lengths = Counter(w[3] for w in want if w[3])
    assert bounds == packing.bucket_bounds(list(lengths), list(lengths.values())) and len(bounds) == 8
    batches = {}
    for r in found:
        if r.n_tokens:
            assert r.width == min(b for b in bounds if b >= r.n_tokens) and r.bucket == bounds.index(r.width)
            batches.setdefault(r.batch, []).append((r.slot, r.width))
    for slots in batches.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots))) and len(slots) * slots[0][1] <= max(16_384, slots[0][1])


def test_tables_go_when_they_have_been_read(spark, docs):
    folder = scaling.shared_folder(spark).removeprefix("file:")
    left = lambda: {f for f in os.listdir(folder) if os.path.isdir(os.path.join(folder, f))}
    before = left()
    with common.scratch(spark) as made:
        out = common.stored(near_duplicates.without_near_duplicates(docs(planted())), "kept")
        made.remove(out.stored_in)
    assert len(left() - before) == 1 and out.count() > 10
    common.dropped(out)
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert components(chain).count() == 51 and len({f for f in left() - before if f.startswith("edges")}) == 1


def test_packing_of_nothing(docs):
    assert packing.pack(docs([])).collect() == []
    assert [(r.n_tokens, r.batch) for r in packing.pack(docs([(1, None), (2, "")])).collect()] == [(0, None), (0, None)]
