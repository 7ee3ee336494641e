import math
from collections import Counter

import numpy as np
import pytest

from revmine.llm import classlm, common, queries

from .fixtures import awkward, crc, empty, lower, words


def base_scores(rows):
    train = Counter()
    for r in rows:
        if crc(str(r["doc_id"]) if r["doc_id"] is not None else "") % 10:
            train.update([*words(lower(r["text"])), ""])
    n, v = sum(train.values()), len(train)
    out = []
    for r in rows:
        tokens = [*words(lower(r["text"])), ""]
        out.append((r["doc_id"], len(tokens), sum(t in train for t in tokens), n, sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return sorted(out, key=repr)


def check(rows, got):
    want = base_scores(rows)
    got_ = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
    assert [x[:4] for x in got_] == [x[:4] for x in want]
    assert [x[4] for x in got_] == pytest.approx([x[4] for x in want], rel=1e-9)
    assert all(r["held_out"] == (crc(str(r["doc_id"]) if r["doc_id"] is not None else "") % 10 == 0) for r in got)


def test_awkward_table(spark):
    docs = awkward(spark)
    got = classlm.score(docs, batch_chars=300_000).collect()
    check(docs.collect(), got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[10]) == 1 and by[4] == by[5] == by[6] and all(s <= 0 for x in by.values() for s in x)
    assert classlm.score(empty(spark)).collect() == []


def test_query_contract_and_gain_over_the_base(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_class_lm(spark, sf).collect()
    check(common.table(spark, sf, "documents").collect(), got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_equal_texts_get_equal_scores_and_batches_do_not_matter(spark, sf):
    docs = common.table(spark, sf, "documents")
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    a = {(r["doc_id"]): r["score"] for r in classlm.score(twice).collect()}
    b = {(r["doc_id"]): r["score"] for r in classlm.score(twice.repartition(7), batch_chars=50_000).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
    assert all(a[k] == pytest.approx(a[k + 100000], rel=1e-12) for k in a if k < 100000)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    counts = np.array([5, *rng.integers(1, 9, 40)])
    unit = np.array([i if i < 20 else classlm.WORD_UNITS + 1 + i % 3 for i in range(41)])
    pairs, once = np.zeros((classlm.UNITS, classlm.UNITS)), np.zeros((classlm.UNITS, classlm.UNITS))
    stream = rng.permutation(np.repeat(np.arange(41), counts))
    for a, b in zip(np.concatenate(([0], stream[:-1])), stream):
        pairs[unit[a], unit[b]] += 1
        once[unit[a], unit[b]] += counts[b] == 1
    model = classlm.model_of(pairs, once, int(counts.sum()), 41)
    base = model.base(np.append(counts, 0))
    assert base.sum() == pytest.approx(1)
    class_, emit = model.of[unit], (counts - 0.5 * (counts == 1)) / model.mass[model.of[unit]]
    for before in range(classlm.CLASSES):
        p = classlm.KNOWN * np.append(model.follows[before, class_] * emit, model.follows[before, -1]) + (1 - classlm.KNOWN) * base
        assert p.sum() == pytest.approx(1)


def likelihood(pairs, of, classes):
    table = np.zeros((classes, classes))
    for u in range(len(pairs)):
        for v in range(len(pairs)):
            table[of[u], of[v]] += pairs[u, v]
    return classlm._xlogx(table).sum() - classlm._xlogx(table.sum(0)).sum() - classlm._xlogx(table.sum(1)).sum()


def test_exchange_ends_where_no_single_move_improves():
    rng = np.random.default_rng(4)
    kind = np.array([0, *([1] * 8), *([2] * 8), *([3] * 8)])
    follow = {0: [1], 1: [2], 2: [3], 3: [0, 1]}
    pairs = np.zeros((25, 25))
    now = 0
    for _ in range(6000):
        nxt = rng.choice(np.flatnonzero(np.isin(kind, rng.choice(follow[kind[now]], 1))))
        pairs[now, nxt] += 1
        now = nxt
    of = classlm.exchange(pairs, classes=4)
    best = likelihood(pairs, of, 4)
    assert of[0] == 0 and 0 not in of[1:]
    assert best > likelihood(pairs, np.array([0, *(1 + np.arange(24) % 3)]), 4)
    for u in range(1, 25):
        for c in range(1, 4):
            moved = of.copy()
            moved[u] = c
            assert likelihood(pairs, moved, 4) <= best + 1e-6
