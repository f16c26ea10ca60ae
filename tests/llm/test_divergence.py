import re
from collections import Counter, defaultdict

from genoweave.llm import divergence
from genoweave.llm.divergence import audit, op13_source_divergence, shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least=30, top=50):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for w, n in seen[lang].items() if n >= least), key=lambda w: w.encode())
        scale = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for w in kept}
        p = {s: scale(counts[lang, s]) for s in sources}
        q = scale(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, values in (("pair", pairs), ("term", terms)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, w, v, i + 1) for i, (v, w) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_supplied_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()]
    assert plain(op13_source_divergence(spark, sf_dir)) == brute(docs)


def test_small_chunks_and_blocks(spark, monkeypatch):
    for name, value in (("CHUNK", 3), ("SOURCE_BLOCK", 2), ("TABLE_ROWS", 4)):
        monkeypatch.setattr(divergence, name, value)
    docs = [(f"l{i % 2}", f"s{i % 7}", " ".join(f"w{chr(97 + (i * j) % 11)}é" for j in range(i % 9))) for i in range(120)]
    docs += [("l0", "s0", "hot " * 500)] * 5 + [("l2", "a", "rare"), ("l2", "b", None), (None, None, "x X x"), ("l0", "zß", ""), ("l0", "z漢", "Wa" * 50000), ("", "a", "X")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, source string, text string, term int, block int").repartition(3)
    assert plain(audit(df, least_docs=2, top=4)) == brute(docs, 2, 4)


def test_one_language_and_empty(spark, make_docs):
    assert op13_source_divergence(spark, make_docs([])).count() == 0
    assert plain(op13_source_divergence(spark, make_docs([(1, "a", "en", "x"), (2, "b", "en", "y")]))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_large_counts_are_exact():
    import numpy as np
    big = 2**48 - 7
    assert shares(np.array([big, 3]), big + 3, 2).tolist() == [1 + 10**9 * (big + 5) // (big + 13), 1 + 10**9 * 8 // (big + 13)]
