import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from genoweave.llm.packing import fullest, op1_min_bin_slack_packing, pack, plan_bins
from genoweave.llm.tokens import WordEncoder, tokenizer_path
from genoweave.llm.wavelet import Shard, build_shard, op5_wavelet_matrix

EDGES = [None, "", " ", "\n\n", "a", " a  b\t\nc ", "x  y", "x \n y  ", "<|endoftext|> x<|endoftext|>", "é" * 3000, "w" * 9000,
         "it's  they'll\r\n\r\n 12 345 ... !?", "\x1c a\x1f b", "日本語 text ", "á ́b", "\x00\x01 \x7f", "same", "same", "word " * 9000]


def plain(name, specials_as_text=False):
    tok = Tokenizer.from_file(tokenizer_path(name))
    if specials_as_text:
        tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, all_docs):
    enc, want = WordEncoder(tokenizer_path(name)), plain(name)
    texts = [t for _, t in all_docs] + EDGES
    for _ in range(2):
        for t, got in zip(texts, enc.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == want(t), t


@pytest.mark.parametrize("name, end", [("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)])
def test_added_tokens_in_a_text(name, end):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a <|ENDOFTEXT|> b", "a<|endoftext|>b c d"]
    for as_text in (False, True):
        enc, want = WordEncoder(tokenizer_path(name), as_text), plain(name, as_text)
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
        assert got == [want(t) for t in texts]
        assert (end in got[0]) != as_text


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check5(spark, sf, rows):
    want, start = {}, 0
    enc = plain("byte_bpe_50k.json")
    for doc, text in sorted(rows):
        ids = enc(text) + [2]
        want[doc] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op5_wavelet_matrix(spark, sf).collect()}
    assert got == want


def check1(spark, sf, rows):
    enc, want = plain("word_bpe_49k.json"), set()
    for doc, text in rows:
        ids = enc(text) + [1]
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096]
            want.add((doc, k // 4096, k, len(piece), crc(piece)))
    got = op1_min_bin_slack_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), sum(r.length for r in got)


def test_supplied_documents(spark, sf_dir, all_docs):
    check5(spark, sf_dir, all_docs)
    n, total = check1(spark, sf_dir, all_docs)
    assert n <= -(-total // 4096) + 1


def test_edges(spark, make_docs):
    rows = list(enumerate(EDGES))
    sf = make_docs(rows)
    check5(spark, sf, rows)
    check1(spark, sf, rows)


def test_empty_table(spark, make_docs):
    sf = make_docs([])
    assert op5_wavelet_matrix(spark, sf).count() == 0
    assert op1_min_bin_slack_packing(spark, sf).count() == 0


def test_wavelet_queries():
    rng = np.random.default_rng(3)
    for top, n in ((1, 5), (7, 1000), (50000, 3000), (1 << 20, 600)):
        ids = rng.integers(0, top, n).astype("<u4")
        ends = np.array([n // 3, n // 3, n])
        shard = Shard(build_shard(ids, [4, None, 9], ends))
        assert (shard.decode() == ids).all() and shard.doc_ids == [4, None, 9] and shard.ends.tolist() == ends.tolist()
        for i in rng.integers(0, n, 20).tolist():
            assert shard.access(i) == ids[i]
            places = np.flatnonzero(ids == ids[i])
            k = int(np.searchsorted(places, i))
            assert shard.locate(int(ids[i]), k) == i
            assert shard.count(int(ids[i]), 0, i) == k and shard.count(int(ids[i])) == places.size
        assert shard.count(top + 5) == 0


def test_fullest_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        cap = int(rng.integers(5, 40))
        items = rng.integers(1, cap + 1, int(rng.integers(1, 9))).tolist()
        counts = {x: items.count(x) for x in items}
        chosen = fullest(counts, cap)
        assert all(n <= counts[x] for x, n in chosen.items())
        first = max(items)
        sums = {first}
        rest = list(items)
        rest.remove(first)
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= cap)
        plan = plan_bins(counts, cap)
        used = {}
        for _, times, pattern in plan:
            for x, n in pattern.items():
                used[x] = used.get(x, 0) + n * times
        assert used == counts


def test_pack_keeps_clashing_columns(spark):
    rows = [(i % 3, 1 + i % 5, "h", 7, 8) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, n int, hash_bucket string, offset int, place int")
    got = pack(df, "n", ["k"], 10)
    assert got.columns == ["k", "n", "hash_bucket", "place", "sequence_id", "offset"]
    assert got.count() == 40 and len({(r.sequence_id, r.offset) for r in got.collect()}) == 40
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 11)], "k int, n int"), "n", ["k"], 10)


def test_other_columns(spark):
    from genoweave.llm.wavelet import read_documents, write_shards

    docs = spark.createDataFrame([(1, "a b", "x", 5), (2, None, "y", 6)], "doc_id long, text string, payload string, seq int")
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in read_documents(write_shards(docs, tokenizer_path("byte_bpe_50k.json"), 2)).collect())
    assert got == [(1, 0, 3), (2, 3, 1)]
