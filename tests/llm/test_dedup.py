from collections import Counter, defaultdict

import duckdb
import numpy as np
import xxhash

from revmine.llm import common, components, exact, queries, simhash

from .fixtures import awkward, by_id, empty, lower, sha, words


def exact_rows(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    out = []
    for r in rows:
        t = lower(r["text"])
        known = [i for i in groups[t] if i is not None]
        keep = max(known) if known else None
        out.append((r["doc_id"], keep, len(groups[t]), r["doc_id"] == keep, sha(t)))
    return sorted(out, key=repr)


def test_exact_matches_brute_force(spark):
    docs = awkward(spark)
    assert by_id(exact.label(docs).collect()) == exact_rows(docs.collect())


def test_exact_with_a_full_filter_is_the_same(spark):
    docs = awkward(spark)
    assert by_id(exact.label(docs, max_slots=64).collect()) == exact_rows(docs.collect())


def test_exact_dedup_keeps_columns_and_one_row_of_a_group(spark):
    docs = awkward(spark)
    kept = exact.dedup(docs)
    assert kept.columns == docs.columns
    want = Counter(keep for _, keep, _, _, _ in {(sha_, keep, 0, 0, 0) for _, keep, _, _, sha_ in exact_rows(docs.collect())})
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert exact.dedup(empty(spark)).collect() == [] and exact.label(empty(spark)).collect() == []


def test_exact_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert by_id(queries.op6_exact_dedup(spark, sf).collect()) == sorted(con.execute(exact.ORACLE).fetchall(), key=repr)


def test_exact_main_path_is_native(spark):
    plan = exact.label(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows(rows, radius=4):
    fps = [fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            ids[find(i)].append(r["doc_id"])
    return sorted(((r["doc_id"], f"{fps[i]:016x}", min(ids[find(i)], default=None)) for i, r in enumerate(rows)), key=repr)


def near_copies(spark):
    """A chain of near copies: each differs a little from the one before."""
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in rng.integers(0, 500, 400)]
    texts = []
    for i in range(40):
        base = list(base)
        base[int(rng.integers(0, 400))] = f"new{i}"
        texts.append((100 + i, " ".join(base), "s"))
    return texts


def test_simhash_matches_brute_force(spark):
    from .fixtures import TEXTS

    docs = awkward(spark, TEXTS + near_copies(spark))
    rows = docs.collect()
    got = by_id(simhash.label(docs).collect())
    assert got == near_rows(rows)
    assert len({x[2] for x in got if x[0] and x[0] >= 100}) < 40


def test_simhash_query_matches_brute_force(spark, sf):
    rows = common.table(spark, sf, "documents").collect()
    assert by_id(queries.op3_simhash_near_dedup(spark, sf).collect()) == near_rows(rows)


def test_near_dedup_keeps_the_least_of_each_component(spark):
    docs = awkward(spark)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    classes = {c for _, _, c in near_rows(docs.collect())}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(c for c in classes if c is not None)
    assert simhash.near_dedup(empty(spark)).collect() == [] and simhash.label(empty(spark)).collect() == []


def test_meeting_in_small_steps_finds_the_same_links(monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(4)]))
    want = {(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 4}

    def linked():
        return {tuple(map(int, p)) for found in simhash.meet(fps, np.full(len(fps), 2), 64, 4) for p in found}

    direct = linked()
    monkeypatch.setattr(simhash, "TASK_VARIANTS", 3000)
    assert simhash.forest(np.array(sorted(direct), np.uint64)).tolist() == simhash.forest(np.array(sorted(linked()), np.uint64)).tolist() == simhash.forest(np.array(sorted(want), np.uint64)).tolist()


def test_links_over_prefixes_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PREFIX_VARIANTS", 64)
    docs = awkward(spark, near_copies(spark))
    assert by_id(simhash.label(docs).collect()) == near_rows(docs.collect())


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    folder = common.shared_folder(spark, "test")
    got = dict((r["node"], r["root"]) for r in components.connected(spark.createDataFrame(pairs, "u long, v long"), folder).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
