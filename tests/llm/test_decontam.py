import re

import numpy as np

from genoweave.llm.decontam import ItemMatcher, _masks, find_items, normal, op6_pigeonhole_decontamination, prefix_distance


def table_of(p, t, anchored):
    """Last row of the edit table of p against t."""
    row = list(range(len(t) + 1)) if anchored else [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return row


def test_prefix_distance():
    rng = np.random.default_rng(0)
    for _ in range(400):
        p = "".join(rng.choice(list("abc"), int(rng.integers(0, 90))))
        t = "".join(rng.choice(list("abc"), int(rng.integers(0, 90))))
        want = min(table_of(p, t, True))
        assert prefix_distance(_masks(p), len(p), t, 200)[0] == want
        assert prefix_distance(_masks(p), len(p), t, 10)[0] == min(want, 11)


def brute(text, item, rate=0.1):
    t, p = normal(text), normal(item)
    if len(p) < 20:  # unchanged and as whole words
        return 0 if p and re.search(r"(?<![^\W_])" * p[0].isalnum() + re.escape(p) + r"(?![^\W_])" * p[-1].isalnum(), t) else None
    d = min(table_of(p, t, False))
    return d if d <= int(rate * len(p)) else None


def test_matches_equal_full_tables():
    rng = np.random.default_rng(1)
    words = ["ab", "bca", "cab", "a", "bbbb", "Cc"]
    for _ in range(60):
        item = " ".join(rng.choice(words, 14))
        text = " ".join(rng.choice(words, 30)) + " " + item + " " + " ".join(rng.choice(words, 10))
        chars = list(text)
        for p in rng.integers(0, len(chars), int(rng.integers(0, 12))):
            chars[p] = str(rng.choice(["", "x", "ab", chars[p]]))
        text = "".join(chars)
        got = ItemMatcher([(5, item)]).match(text)
        want = brute(text, item)
        assert (got[0][0] if got else None) == want
        if got:
            _, a, b = got[0]
            assert min(table_of(normal(item), normal(text)[a:b], True)[-1:]) == want


def test_supplied_documents(spark, sf_dir, all_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r for r in op6_pigeonhole_decontamination(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in all_docs for i, p in items if normal(p) in normal(t)}
    assert exact and exact == {k for k, r in got.items() if r.distance == 0}
    for (d, i), r in got.items():
        assert r.distance <= r.budget


def test_query_against_full_tables(spark, make_docs):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "of", "17", "+", "is", "What", "é1"]
    items = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate([1, 2, 3, 4, 6, 8, 10, 12])] + [(90, "What is 17 + 25?"), (91, "abcde"), (92, "q")]
    docs = []
    for d in range(120):
        chars = list(items[d % len(items)][1])
        for p in rng.integers(0, len(chars), int(rng.integers(0, 6))):
            chars[p] = str(rng.choice(["", "x", "ab", chars[p]]))
        docs.append((d, " ".join(rng.choice(words, 8)) + " " + "".join(chars) + str(rng.choice([" ", "", ".", "s"])) + " ".join(rng.choice(words, 5))))
    docs += [(200, "(abcde)"), (201, "xabcde"), (202, "abcdef abcde"), (203, "so: WHAT is\n17 + 25? yes"), (204, "q"), (205, None)]
    got = {(r.doc_id, r.item_id): r.distance for r in op6_pigeonhole_decontamination(spark, make_docs(docs, benchmark=(items, "item_id long, text string"))).collect()}
    want = {(d, i): n for d, t in docs for i, p in items if (n := brute(t, p)) is not None}
    assert got == want
    assert {(200, 91), (202, 91), (203, 90), (204, 92)} <= set(got) and (201, 91) not in got


def test_blocks_and_edges(spark, make_docs, monkeypatch):
    import genoweave.llm.decontam as dc

    monkeypatch.setattr(dc, "BLOCK_CHARS", 60)
    a, b = "the quick brown fox jumps over it", "pack my box with five dozen jugs"
    items = [(1, a), (2, a.upper()), (3, b), (4, None), (5, ""), (6, "short"), (None, b), (7, " \n")]
    docs = [(1, a), (2, "x " + a.replace("quick", "quack") + " y"), (3, None), (4, ""), (5, b[:-12]), (6, "z" * 50000 + b), (6, b), (None, b)]
    sf = make_docs(docs, benchmark=(items, "item_id long, text string"))
    got = sorted((r.doc_id or -1, r.item_id, r.distance) for r in op6_pigeonhole_decontamination(spark, sf).collect())
    assert got == [(-1, 3, 0), (1, 1, 0), (1, 2, 0), (2, 1, 1), (2, 2, 1), (6, 3, 0), (6, 3, 0)]
    empty = make_docs([], benchmark=([], "item_id long, text string"))
    assert op6_pigeonhole_decontamination(spark, empty).count() == 0
    renamed = spark.createDataFrame([(1, a, 9, "q")], "doc_id long, text string, item_id long, item_text string")
    assert find_items(renamed, spark.createDataFrame(items, "item_id long, text string")).count() == 2
