import re

import numpy as np

from genoweave.llm.components import components
from genoweave.llm.neardup import bands_for, link_groups, one_of_each, op8_superminhash_neardup, superminhash
from genoweave.llm.shingles import Windows, shingle_set, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def sets_of(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        smallest[r] = min(smallest.get(r, d), d)
    return {d: (len(sets[i]), smallest[find(i)], smallest[find(i)] == d) for i, (d, _) in enumerate(rows)}


def check(spark, sf, rows):
    got = op8_superminhash_neardup(spark, sf).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_supplied_documents(spark, sf_dir, all_docs):
    check(spark, sf_dir, all_docs)


def test_chains_and_edges(spark, make_docs):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    rows, text = [], [words[i] for i in rng.integers(0, 400, 150)]
    for i in range(120):  # a chain of copies, each with one more word changed
        rows.append((1000 - i, " ".join(text)))
        text = list(text)
        text[int(rng.integers(0, 150))] = f"x{i}"
    for i, t in enumerate([None, "", " \n\t", "one", "One", "a b c d", "A  b\nc d", "a b c d e", "É b c d e", "é b c d e", "long " * 30000, "\xa0 x y"]):
        rows.append((i, t))
    rows += [(20 + i, rows[0][1]) for i in range(50)]
    check(spark, make_docs(rows), rows)


def test_empty_table_and_null_keys(spark, make_docs):
    assert op8_superminhash_neardup(spark, make_docs([])).count() == 0
    got = op8_superminhash_neardup(spark, make_docs([(None, "a b"), (None, "a b"), (3, "a b"), (4, "c")])).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {3, 4}


def test_many_blocks(spark, make_docs, monkeypatch):
    import genoweave.llm.neardup as nd

    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 400)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 500, 100)]
    rows = []
    for i in range(60):
        t = list(base)
        for p in rng.integers(0, 100, int(rng.integers(0, 5))):
            t[p] = f"y{i}"
        rows.append((i, " ".join(t)))
    check(spark, make_docs(rows), rows)


def test_buckets_of_several_components(spark, make_docs, monkeypatch):
    """A common passage puts all texts into common buckets; few of them are near copies, of many sizes."""
    import genoweave.llm.neardup as nd

    rng = np.random.default_rng(8)
    shared = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(70):
        own = [f"o{i // 2 if i % 4 < 2 else i}x{j}" for j in range(int(rng.integers(20, 160)) if i % 2 == 0 else 40)]
        if i % 4 == 1:
            own = [f"o{i // 2}x{j}" for j in range(int(rng.integers(20, 160)))]
        rows.append((i, " ".join(shared + own)))
    for blocks in (200_000, 1500, 300):
        monkeypatch.setattr(nd, "BLOCK_SHINGLES", blocks)
        check(spark, make_docs(rows), rows)


def test_window_hashes_follow_words():
    words = words_of("a bb a bb a bb c", True)
    h = Windows(words).hashes(2)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert shingle_set("x  Y\tz") == shingle_set("X y z")


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for n in (1, 3, 40, 300, 3000):
        a, b = pool[:n], np.concatenate([pool[: n - n // 5], pool[3500 : 3500 + n // 5]])
        s = superminhash([np.unique(a), np.unique(b)], 288)
        true = (n - n // 5) / (n + n // 5)
        assert abs((s[0] == s[1]).mean() - true) < 0.12
        assert (superminhash([np.unique(a)], 288)[0] == s[0]).all()


def test_union_find_equals_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 12, int(rng.integers(1, 12)))).astype(np.uint64) for _ in range(80)]
    roots = link_groups(sets, 85)
    parent = list(range(80))
    for _ in range(80):
        for i in range(80):
            for j in range(80):
                n = np.intersect1d(sets[i], sets[j]).size
                if 100 * n >= 85 * (sets[i].size + sets[j].size - n):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert parent == roots.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (None, 4), (5000, 4999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}, 5000: 4999, 4999: 4999}


def test_bands_follow_the_threshold(spark, make_docs):
    assert bands_for(85) == (36, 8) and bands_for(80) == (48, 6)
    rows = []
    for i in range(60):  # 200 words have 196 shingles; a run of changed words takes that many and four more
        words = [f"w{i}x{j}" for j in range(200)]
        changed = 14 + i % 3  # similarity 178/214, 177/215, 176/216: 0.832, 0.823, 0.815
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[:50] + [f"v{i}y{j}" for j in range(changed)] + words[50 + changed :])))
    rows += [(1000, " ".join(f"u{j}" for j in range(200))), (1001, " ".join([f"u{j}" for j in range(170)] + [f"t{j}" for j in range(30)]))]  # 166/226
    sf = make_docs(rows)
    got = one_of_each(spark.read.parquet(f"{sf}/documents.parquet"), percent=80)
    assert sorted(r.doc_id for r in got.collect()) == [*range(0, 120, 2), 1000, 1001]
    assert all(r.kept for r in op8_superminhash_neardup(spark, sf).collect())
