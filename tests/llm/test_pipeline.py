from tokenizers import Tokenizer

import corpus_pipeline
from genoweave.llm.tokens import tokenizer_path

from .test_neardup import brute as classes
from .test_pii import KINDS
import re


def redacted(text):
    spans = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(KINDS) for m in re.finditer(p, text) if ok(m.group()))
    out, at = [], 0
    for a, _, b, name in spans:
        if a >= at:
            out += [text[at:a], f"<{name.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language"](spark, docs, sf_dir).collect()
    assert set(kept) <= set(rows.values()) and len(kept) >= 0.97 * len(rows)

    got = stages["near_duplicates"](spark, docs, sf_dir).collect()
    want = classes([(d, r.text) for d, r in rows.items()], 80)
    assert sorted(r.doc_id for r in got) == sorted(d for d, (_, _, k) in want.items() if k)
    assert all(rows[r.doc_id] == r for r in got)

    got = stages["decontaminate"](spark, docs, sf_dir).collect()
    from genoweave.llm.decontam import ItemMatcher
    matcher = ItemMatcher(list(enumerate(items)))
    assert sorted(r.doc_id for r in got) == sorted(d for d, r in rows.items() if not matcher.match(r.text))

    got = stages["personal_data"](spark, docs, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        old = rows[r.doc_id]
        assert r.text == redacted(old.text or "") and (r.lang, r.source) == (old.lang, old.source)
        assert r.n_chars == (old.n_chars if r.text == old.text else len(r.text))


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    sizes = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes
    assert len({r.sequence_id for r in got}) <= -(-sum(sizes.values()) // 4096) + 1


def test_edges(spark, make_docs):
    text = " ".join(f"the of and word{i}" for i in range(30))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, "en", "r", 5), (3, None, None, None, None), (4, "", "en", "s", 0),
            (4, "", "en", "s", 0), (None, "the and of x@y.zz", "en", "s", 3), (5, "the of and " * 20000, "en", "s", 1)]
    sf = make_docs(rows, benchmark=([], "item_id long, text string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id or -1 for r in stages["near_duplicates"](spark, docs, sf).collect()) == [-1, 1, 3, 4, 4, 5]
    assert stages["decontaminate"](spark, docs, sf).count() == 8
    assert sorted(r.doc_id or -1 for r in stages["language"](spark, docs, sf).collect()) == [-1, 1, 1, 2, 5]
    assert {r.text for r in stages["personal_data"](spark, docs, sf).collect()} >= {"the and of <EMAIL>", None, ""}
    extra = docs.selectExpr("*", "1 as score", "'x' as pii_", "2 as text_hash_", "map('a', 1) as keep_key")
    for name in ("language", "near_duplicates", "decontaminate", "personal_data"):
        assert stages[name](spark, extra, sf).columns == extra.columns
        assert stages[name](spark, extra, sf).count() > 0
    empty = make_docs([], benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0
