import hashlib
import math
import re
import zlib
from collections import Counter

from genoweave.llm import resampling
from genoweave.llm.resampling import drawn_documents, op11_importance_resampling, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    of = lambda w: zlib.crc32(w.encode()) % buckets
    own = [(d, *features(t, longest)) for d, t in docs]
    s, t = Counter(of(w) for _, _, f in own for w in f), Counter(of(w) for x in target for w in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, n_words, f in own:
        weight = sum(gain(of(w)) for w in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_supplied_tables(spark, sf_dir, all_docs, monkeypatch):
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(all_docs, target)
    assert plain(op11_importance_resampling(spark, sf_dir)) == want
    monkeypatch.setattr(resampling, "HEAVY", 20)  # nearly all strings by the join
    assert plain(op11_importance_resampling(spark, sf_dir)) == want


def test_longer_runs_edges_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(resampling, "TABLE_ROWS", 5)
    long = "Wort É ß 漢字 x " * 3000
    docs = [(1, None), (2, ""), (3, "- . !"), (4, long), (5, "a b c d e"), (5, "a b c d e"), (5, "other words here"), (None, "q r s t u"), (7, "A B c1d2"), (8, "b" * 70000)]
    target = ["a b c", None, "漢字 x"]
    df = spark.createDataFrame([(d, t, "x", 1, 2.0) for d, t in docs], "doc_id long, text string, weight string, rank int, mark double").repartition(3)
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=50, least_words=3, longest=2, buckets=64)
    assert plain(got) == brute(docs, target, 2, 64, 50, 3)
    drawn = drawn_documents(df, got)
    assert drawn.columns == df.columns and sorted(r.text for r in drawn.collect()) == ["a b c d e", "q r s t u"]


def test_empty_tables(spark, make_docs):
    kinds = "item_id long, text string"
    assert op11_importance_resampling(spark, make_docs([], benchmark=([], kinds))).count() == 0
    rows = [(i, f"w{i} " * 25) for i in range(30)]
    assert plain(op11_importance_resampling(spark, make_docs(rows, benchmark=([], kinds)))) == brute(rows, [])
