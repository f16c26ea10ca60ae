import hashlib
import re

import numpy as np

from genoweave.llm import substrings
from genoweave.llm.substrings import op4_de_bruijn_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(spark, sf, rows):
    got = sorted(tuple(r) for r in op4_de_bruijn_substrings(spark, sf).collect())
    want = brute(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w


def test_supplied_documents(spark, sf_dir, all_docs):
    check(spark, sf_dir, all_docs)


def mixed(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [list(rng.choice(vocabulary, int(rng.integers(5, 60)))) for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(int(rng.integers(0, 7))):
            w += list(rng.choice(vocabulary, int(rng.integers(0, 20))))
            p = list(passages[int(rng.integers(0, 12))])
            if p and rng.random() < 0.5:
                p[int(rng.integers(0, len(p)))] = "changed"
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist())
            w += p[a:b] if rng.random() < 0.3 else p
        rows.append((int(i), " ".join(w)))
    return rows


def test_shared_passages(spark, make_docs):
    rows = mixed(120, 3)
    check(spark, make_docs(rows), rows)


def test_frequent_anchors(spark, make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLE_TEXTS", 1)
    monkeypatch.setattr(substrings, "FREQUENT", 1 << 40)
    rows = mixed(100, 5) + [(1000 + i, "a b c d e f g h i j k l m n o p q r s t " * 2) for i in range(40)]
    check(spark, make_docs(rows), rows)


def test_edges(spark, make_docs):
    long = " ".join(f"x{i % 997}" for i in range(30000))
    line = " ".join("abcdefghijklm")
    rows = [(1, None), (2, ""), (3, line), (4, line), (5, line.replace(" ", " \n\t")), (6, " ".join("abcdefghijkl")), (7, "z " * 100), (8, "z " * 13),
            (9, long), (10, long[5000:90000]), (11, line + " " + line), (12, "A" + line[1:]), (13, "é\xa0ü " * 20), (14, "é\xa0ü " * 20)]
    check(spark, make_docs(rows), rows)
    assert op4_de_bruijn_substrings(spark, make_docs([])).count() == 0
    twice = make_docs([(1, line), (1, line), (1, "q " * 20), (2, line + " y"), (None, line), (None, line)])
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in op4_de_bruijn_substrings(spark, twice).collect())
    assert got == [(-1, 13, 0), (-1, 13, 0), (1, 13, 0), (1, 13, 0), (1, 20, 0), (2, 14, 13)]


def test_other_columns(spark):
    from genoweave.llm.substrings import remove_repeats

    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, "a", 1, 2), (2, text, "b", 3, None), (3, None, None, None, None)], "id long, text string, doc string, places int, path long")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, key="id").collect()}
    assert got == {1: (20, 0, text), 2: (20, 20, ""), 3: (0, 0, "")}
