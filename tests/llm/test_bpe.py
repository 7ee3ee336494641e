import hashlib
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revmine.llm import bpe, common, idfile, queries, unigram

from .fixtures import awkward, by_id, empty, sha


@cache
def library():
    return bpe.tokenizer(bpe.vocabulary_text(None))


def expected(text):
    ids = library().encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library().decode(ids, skip_special_tokens=False))


def test_awkward_texts_match_the_library(spark):
    docs = awkward(spark)
    got = by_id(bpe.digests(bpe.encode_decode(docs, batch_chars=150_000)).collect())
    want = sorted(((r["doc_id"], *expected(r["text"])) for r in docs.collect()), key=repr)
    assert got == want


def test_query_matches_the_library(spark, sf):
    docs = common.table(spark, sf, "documents")
    assert by_id(queries.op4_bpe_round_trip(spark, sf).collect()) == sorted(((r["doc_id"], *expected(r["text"])) for r in docs.collect()), key=repr)


def test_decode_goes_through_the_table(spark):
    docs = awkward(spark)
    coded = bpe.encode_decode(docs)
    assert by_id(bpe.decode(coded).collect()) == by_id(coded.select("doc_id", "decoded").collect())


def test_unknown_and_null_ids(spark):
    df = spark.createDataFrame([(1, [464, 999_999, 0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = dict(by_id(bpe.decode(df).collect()))
    assert got == {1: library().decode([464, 0], skip_special_tokens=False), 2: "", 3: ""}


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_splitter_is_the_library_pre_tokenizer(text):
    from tokenizers.pre_tokenizers import ByteLevel

    cut = bpe.splitter(["<|endoftext|>"])
    assert "".join(cut(text)) == text
    if "<|endoftext|>" not in text:
        assert cut(text) == [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


def test_empty_tables(spark):
    for df in (bpe.encode_decode(empty(spark)), unigram.count_tokens(empty(spark)), idfile.round_trip(empty(spark))):
        assert df.collect() == []


def segment(word, scores):
    """Best score and fewest tokens by plain dynamic programming."""
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
    for d in range(1, len(word) + 1):
        for a in range(d):
            piece = scores.get(word[a:d])
            if piece is not None:
                s, n = best[a][0] + piece, best[a][1] + 1
                if s > best[d][0] + 1e-9 or (s > best[d][0] - 1e-9 and n < best[d][1]):
                    best[d] = (s, n)
    return best[-1]


def test_token_counts_match_brute_force(spark, sf):
    vocabulary = bpe.vocabulary_text(None)
    scores, cut, known = unigram.scores(vocabulary), bpe.splitter(bpe.added_tokens(vocabulary)), {"<|endoftext|>": (unigram.scores(vocabulary)[b"<|endoftext|>"], 1)}
    docs = awkward(spark).select("doc_id", "text").unionByName(common.table(spark, sf, "documents").select("doc_id", "text"))
    got = by_id(unigram.count_tokens(docs).collect())
    want = []
    for r in docs.collect():
        found = [known[w] if w in known else known.setdefault(w, segment(w.encode(), scores)) for w in cut(r["text"] or "")]
        want.append((r["doc_id"], len(found), sum(n for _, n in found), sum(s for s, _ in found)))
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want, key=repr)]
    assert sorted(round(x[3], 4) for x in got) == pytest.approx(sorted(round(x[3], 4) for x in want), abs=1e-3)


def test_trie_starts_anew_without_changing_results(monkeypatch):
    scores = unigram.scores(bpe.vocabulary_text(None))
    a, words_ = unigram.Trie(scores, []), [b"interest", b"interesting", b"internal", b"zebra"]
    want = [a.add(w) for w in words_]
    monkeypatch.setattr(unigram, "TRIE_NODES", 5)
    b = unigram.Trie(scores, [])
    assert [b.add(w) for w in words_] == want


@pytest.mark.parametrize("bits", [False, True])
def test_files_match_brute_force(spark, bits):
    docs = awkward(spark)
    got = by_id(idfile.round_trip(docs, bits=bits).drop("first_ids").collect())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for i, text in rows:
        ids = np.array([*library().encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want, key=repr)


def test_shards_blocks_and_indexes(tmp_path):
    documents = [(3, np.arange(70_000, dtype="<u4").tobytes()), (None, b""), (5, np.array([2**32 - 1, 0, 7], "<u4").tobytes())]
    for bits in (False, True):
        uri = f"file://{tmp_path}/x-{bits}.ids"
        n, ids, size = idfile.write_shard(uri, iter(documents), bits, block_ids=4096)
        assert (n, ids) == (3, 70_003)
        shard = idfile.Shard(uri)
        assert [(name, count, b"".join(parts)) for name, count, parts in shard.documents()] == [(i, len(x) // 4, x) for i, x in documents]
        assert np.frombuffer(shard.block(2), "<u4")[0] == 2 * 4096
        raw = bytearray((tmp_path / f"x-{bits}.ids").read_bytes())
        raw[len(idfile.MAGIC) + 40] ^= 255
        (tmp_path / "broken.ids").write_bytes(raw)
        with pytest.raises(Exception):
            list(idfile.Shard(f"file://{tmp_path}/broken.ids").documents())


def test_token_file_query_matches_the_library(spark, sf):
    docs, start = common.table(spark, sf, "documents"), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_token_file(spark, sf).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library().encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert hashlib.sha256(b"").hexdigest() == sha("")
