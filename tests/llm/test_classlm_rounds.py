"""Every training word is clustered by its own bigrams, not only the most frequent ones."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from revmine.llm import classlm, common

from .fixtures import crc, lower, words


def test_rare_words_with_one_ending_go_to_classes_by_their_own_bigrams(spark, monkeypatch):
    """More frequent words take all units of words, and the rare ones share one unit by their ending."""
    monkeypatch.setattr(classlm, "WORD_UNITS", 6)
    rare = {k: [f"{k}{i:02d}" + "-" * 64 + "xyz" for i in range(30)] for k in "ab"}
    ids = iter([i for i in range(10_000) if crc(str(i)) % 10])
    rows = [(next(ids), f"{k}before {w} {k}after") for k in "ab" for w in [*rare[k], *[f"{k}often"] * 30] for _ in range(4)]
    out = [i for i in range(10_000) if crc(str(i)) % 10 == 0]
    asked = [f"{k}before {rare[j][0]} {k}after" for k in "ab" for j in "ab"]
    docs = spark.createDataFrame(rows + list(zip(out, asked)), "doc_id long, text string")
    for chars in (1_500, 24_000_000):
        got = {r["doc_id"]: r["score"] for r in classlm.score(docs, batch_chars=chars).collect()}
        aa, ab, ba, bb = (got[i] for i in out[:4])
        assert min(aa, bb) > max(ab, ba) + 0.5


def test_the_number_of_classes_grows_with_the_vocabulary():
    assert [classlm.class_count(v) for v in (0, 1000, 10**6, 10**8)] == [64, 64, 100, 464]


def test_chosen_is_the_class_of_most_likelihood():
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 50, (7, 7)).astype(float)
    pairs[:, 5] = pairs[5] = 0
    vote = classlm.votes(pairs)
    sizes = rng.integers(1, 9, 40)
    context, n = rng.integers(0, 14, sizes.sum()), rng.integers(1, 5, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    want = [int(sum(n[i] * vote[context[i]] for i in range(a, a + s)).argmax()) for a, s in zip(starts, sizes)]
    for most in (1 << 22, 20, 7):
        for many in (0, 3, 24):
            assert classlm.chosen(starts, context, n, vote, most, many).tolist() == want
    often = n * (1 << 30)  # beyond what doubles hold
    assert classlm.chosen(starts, context, often, vote, many=0).tolist() == want
    assert not {0, 5} & set(want)
    left, right = pairs.sum(1), pairs.sum(0)
    follows = (pairs + classlm.PRIOR * right / right.sum()) / (left[:, None] + classlm.PRIOR)
    assert np.allclose(vote[2, 3] / classlm.SCALE, np.log(follows[2, 3] / right[3]), atol=1e-5)
    assert np.allclose(vote[7 + 2, 3] / classlm.SCALE, np.log(follows[3, 2]), atol=1e-5)


def brute_scores(rows):
    """The model by dictionaries over words: seeds, rounds and formula as the module's docstring states them."""
    train, tokens = Counter(), [[*words(lower(r["text"])), ""] for r in rows]
    learn = [crc(str(r["doc_id"])) % 10 != 0 for r in rows]
    for t, yes in zip(tokens, learn):
        train.update(t if yes else [])
    n, v = sum(train.values()), len(train)
    classes, known = classlm.class_count(v), classlm.KNOWN
    ranked = sorted((w for w in train if w), key=lambda w: (-train[w], w.encode()))[: classlm.WORD_UNITS]
    frequent = {"": 0} | {w: k for k, w in enumerate(ranked, 1)}
    unit = {w: frequent.get(w, 1 + classlm.WORD_UNITS + zlib.crc32(w.encode()[-classlm.TAIL :]) % classlm.TAIL_UNITS) for t in tokens for w in t}
    bigrams = Counter(p for t, yes in zip(tokens, learn) if yes for p in zip(["", *t], t))
    pairs = np.zeros((classlm.UNITS, classlm.UNITS))
    for (a, b), k in bigrams.items():
        pairs[unit[a], unit[b]] += k
    of = classlm.exchange(pairs, classes)

    def joint(class_):
        all_, once = np.zeros((classes, classes)), np.zeros((classes, classes))
        for (a, b), k in bigrams.items():
            all_[class_[a], class_[b]] += k
            once[class_[a], class_[b]] += k * (train[b] == 1)
        return all_, once

    seeds = {w: int(of[u]) for w, u in unit.items()}
    now, (now_all, best) = seeds, (joint(seeds)[0], None)
    for _ in range(classlm.ROUNDS):
        vote = classlm.votes(now_all)
        total = defaultdict(lambda: np.zeros(classes, np.int64))
        for (a, b), k in bigrams.items():
            total[b] += k * vote[now[a]]
            if a:
                total[a] += k * vote[classes + now[b]]
        new = {w: int(total[w].argmax()) if unit[w] > classlm.WORD_UNITS and train[w] else seeds[w] for w in unit}
        all_, once = joint(new)
        if best is not None and classlm.likelihood(all_) <= classlm.likelihood(now_all):
            break
        now, now_all, best = new, all_, (new, all_, once)
    class_, all_, once = best
    mass = (all_ - 0.5 * once).sum(0)
    lent = 0.5 * once.sum(1)
    overall = np.append(mass, lent.sum()) / (mass.sum() + lent.sum())
    out = {}
    for r, t in zip(rows, tokens):
        score = 0.0
        for a, b in zip(["", *t], t):
            row, total_ = all_[class_[a]].sum(), classlm.PRIOR
            base = (train[b] + 0.1) / (n + 0.1 * (v + 1))
            if train[b]:
                c = class_[b]
                p = (all_[class_[a], c] - 0.5 * once[class_[a], c] + total_ * overall[c]) / (row + total_) * (train[b] - 0.5 * (train[b] == 1)) / max(mass[c], 0.5)
            else:
                p = (lent[class_[a]] + total_ * overall[-1]) / (row + total_)
            score += math.log10(known * p + (1 - known) * base)
        out[r["doc_id"]] = score
    return out


def test_scores_match_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = docs.collect()
    want = brute_scores(rows)
    assert len({w for r in rows for w in words(r["text"])}) > 3 * classlm.WORD_UNITS
    for chars in (24_000_000, 60_000):
        got = {r["doc_id"]: r["score"] for r in classlm.score(docs, batch_chars=chars).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-7 * abs(want[k]) for k in want)
