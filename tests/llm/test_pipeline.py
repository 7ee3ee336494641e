from collections import Counter

import corpus_pipeline
from revmine.llm import common, mixing, quality

from .fixtures import awkward, empty, lower, sha
from .test_bpe import expected
from .test_dedup import near_rows


def test_every_stage_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents")
    folder, seen = common.shared_folder(spark, "pipeline-test"), [docs.collect()]
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(common.written(stage(spark, frames[-1], sf), folder, f"s{k}"))
        seen.append(frames[-1].collect())
    for frame in frames[:-1]:
        assert frame.columns == docs.columns
    good = {r["doc_id"] for r in quality.classify(docs, common.table(spark, sf, "labels")).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in seen[1]} == good
    last = {}
    for r in seen[1]:
        last[lower(r["text"])] = max(r["doc_id"], last.get(lower(r["text"]), -1))
    assert {r["doc_id"] for r in seen[2]} == set(last.values()) and len(seen[2]) == len(last)
    assert sorted(r["doc_id"] for r in seen[3]) == sorted({c for _, _, c in near_rows(seen[2])})
    taken = {r["doc_id"]: r["epochs"] + (r["taken"] > r["epochs"] * r["size"]) for r in mixing.mix_table(frames[3]).collect()}
    assert Counter(r["doc_id"] for r in seen[4]) == Counter({i: n for i, n in taken.items() if n})
    assert sorted(map(tuple, seen[5])) == sorted((r["doc_id"], *expected(r["text"])) for r in seen[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, seen[5]))


def test_stages_take_awkward_and_empty_tables(spark, sf):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert name.startswith("bpe") or out.columns == docs.columns
            assert bool(rows) == bool(docs.count()) or name.startswith(("quality", "source"))
    assert len(corpus_pipeline.STAGES) == 5 and sha("") == sha("")
