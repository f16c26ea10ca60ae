import zlib

from genoweave.llm.sharding import balanced_shards, op9_prefix_sum_shards


def check(spark, sf, rows):
    got = op9_prefix_sum_shards(spark, sf).collect()
    assert len(got) == len(rows)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in ordered] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    texts = {d: (t or "").encode() for d, t in rows}
    total, at, slot, last = sum(len(x) + 1 for x in texts.values()), 0, 0, -1
    for r in ordered:
        raw = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slot = slot + 1 if r.shard == last else 0
        assert r.slot == slot and r.shard == min(7, at * 8 // total)
        last, at = r.shard, at + r.size
    return ordered


def test_supplied_documents(spark, sf_dir, all_docs):
    ordered = check(spark, sf_dir, all_docs)
    sizes = [sum(r.size for r in ordered if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in ordered)


def test_edges(spark, make_docs):
    rows = [(3, None), (1, ""), (2, "é" * 70000), (9, "x"), (8, "same"), (7, "same")]
    check(spark, make_docs(rows), rows)
    assert op9_prefix_sum_shards(spark, make_docs([])).count() == 0
    got = op9_prefix_sum_shards(spark, make_docs([(1, "a"), (1, "a"), (None, "b"), (1, "c")])).collect()
    assert sorted((r.doc_id or 0, r.text_crc32) for r in got) == sorted((d, zlib.crc32(t)) for d, t in ((1, b"a"), (1, b"a"), (0, b"b"), (1, b"c")))
    assert len({(r.shard, r.slot) for r in got}) == 4


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, i % 5 + 1, 7, 8, "z") for i in range(50)], "k long, part_no long, shard int, bytes_before int, first_row string")
    got = balanced_shards(df, "k", "part_no", 3)
    assert got.columns == ["k", "part_no", "bytes_before", "first_row", "shard", "slot"] and got.count() == 50
    assert {r.bytes_before for r in got.collect()} == {8}
