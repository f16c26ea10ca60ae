import itertools
import math
import zlib
from collections import Counter

import numpy as np

from genoweave.llm.language import OTHER, SCRIPTS, SWITCH, Labeller, LanguageModel, grams, identify, op7_script_viterbi_language, script_of, train


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_script_viterbi_language(spark, sf_dir).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def script_by_list(c):
    return next((name for name, a, b in SCRIPTS if a <= ord(c) <= b), "other")


def brute(rows):
    """The whole query over (doc_id, text, lang), word by word, without the library's model or labeller."""
    held_out = {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows}
    seen, alphabets = {}, {}
    for key, text, lang in rows:
        if not held_out[key] and text is not None and lang is not None:
            seen.setdefault(lang, Counter()), alphabets.setdefault(lang, Counter())
            for word in text.split():
                letters = "".join(c for c in word.lower() if c.isalpha())
                seen[lang].update(("^" + letters + "$")[i : i + 3] for i in range(len(letters)))
                alphabets[lang].update(map(script_by_list, letters))
    langs = sorted(seen)
    kinds = len(set().union(*seen.values()))
    total = {x: sum(seen[x].values()) for x in langs}
    uses = {x: {s for s, n in alphabets[x].items() if n > 0.01 * sum(alphabets[x].values())} for x in langs}
    memo = {}

    def emission(letters):
        if letters not in memo:
            fit = [set(map(script_by_list, letters)) <= uses[x] for x in langs]
            memo[letters] = [sum(math.log((seen[x][("^" + letters + "$")[i : i + 3]] + 0.5) / (total[x] + 0.5 * (kinds + 1))) for i in range(len(letters)))
                             + (OTHER if any(fit) and not ok else 0.0) for x, ok in zip(langs, fit)]
        return memo[letters]

    out = {}
    for key, text, _ in rows:
        words = [w for w in ("".join(c for c in word.lower() if c.isalpha()) for word in (text or "").split()) if w]
        if not words or not langs:
            out[key] = (held_out[key], "und", 0.0)
            continue
        best, back = [0.0] * len(langs), []
        for w in words:
            top = max(range(len(langs)), key=best.__getitem__)
            back.append([i if best[i] >= best[top] - SWITCH else top for i in range(len(langs))])
            best = [max(best[i], best[top] - SWITCH) + e for i, e in enumerate(emission(w))]
        at, share = max(range(len(langs)), key=best.__getitem__), Counter()
        for w, origin in zip(reversed(words), reversed(back)):
            share[at] += len(w)
            at = origin[at]
        lang = min(share, key=lambda i: (-share[i], i))
        out[key] = (held_out[key], langs[lang], share[lang] / sum(share.values()))
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        held, lang, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang), r.doc_id
        assert abs(r.score - score) < 2e-3, r.doc_id  # sums of the library are single precision


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(op7_script_viterbi_language(spark, sf_dir).collect(), brute(rows))


def test_scripts_narrow_as_brute_force(spark, make_docs):
    rng = np.random.default_rng(5)
    words = {"de": ["und", "die", "straße", "über"], "ru": ["привет", "мир", "дом"], "el": ["και", "το", "λόγος"], "ja": ["日本", "これ", "カナ語"]}
    rows = []
    for i in range(120):
        a, b = rng.choice(list(words), 2)
        text = " ".join([*rng.choice(words[a], int(rng.integers(0, 9))), *rng.choice(words[b], int(rng.integers(0, 5))), *rng.choice(["12", "ok", "שלום", "миp", "--"], 2)])
        rows.append((i, text, str(a) if i % 7 else None))
    same(op7_script_viterbi_language(spark, make_docs(rows)).collect(), brute(rows))


def small_model():
    rows = []
    for lang, words in (("a", ["aba", "bab", "abba"]), ("b", ["cdc", "dcd", "cddc"])):
        for w in words:
            rows += [(lang, "gram", g, 3) for g in grams(w)] + [(lang, "script", "latin", len(w))]
    return LanguageModel.from_counts([(k[0], k[1], k[2], sum(r[3] for r in rows if r[:3] == k)) for k in {r[:3] for r in rows}])


def test_viterbi_equals_all_paths():
    model, rng = small_model(), np.random.default_rng(2)
    lab = Labeller(model, 1.5)
    texts = [" ".join(rng.choice(["aba", "cdc", "ab", "dc", "ac", "12", "bd"], int(rng.integers(1, 8)))) for _ in range(60)]
    langs, scores, spans = lab.label(texts, spans=True)
    for text, lang, score, got in zip(texts, langs, scores, spans):
        rows = [lab.ids[w] for w in text.split()]
        if not lab.letters[rows].sum():
            assert lang == "und"
            continue
        cost = lambda p: sum(lab.scores[r, x] for r, x in zip(rows, p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(cost(p) for p in itertools.product(range(2), repeat=len(rows)))
        path = [model.languages.index(s["lang"]) for s in got for _ in range(s["end"] - s["start"])]
        assert len(path) == len(rows) and abs(cost(path) - best) < 1e-3
        weights = np.bincount(path, lab.letters[rows], 2)
        assert model.languages[int(weights.argmax())] == lang and abs(weights.max() / weights.sum() - score) < 1e-6


def test_spans_of_mixed_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    en = next(r.text for r in docs.filter("lang = 'en'").collect() if len(r.text or "") > 400)[:300]
    de = next(r.text for r in docs.filter("lang = 'de'").collect() if len(r.text or "") > 400)[:300]
    row = identify(spark.createDataFrame([(en + " " + de, 1.0)], "text string, score double"), model, spans=True).first()
    assert [s.lang for s in row.lang_spans][0] == "en" and [s.lang for s in row.lang_spans][-1] == "de" and len(row.lang_spans) <= 4


def test_edges(spark, make_docs):
    long = "der die und " * 40000
    rows = [(1, None, "en"), (2, "", "de"), (3, "123 !!!", "en"), (4, "the of and", "en"), (5, "the of and", "en"), (6, long, "de"),
            (7, "日本語 текст", "ru"), (8, "Привет мир", "ru"), (9, "the of", None), (10, "\x00 \U0010ffff", "en")]
    got = {r.doc_id: r for r in op7_script_viterbi_language(spark, make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 10):
        assert got[i].lang_pred == "und" and got[i].score == 0.0
    assert got[6].lang_pred == "de" or got[6].lang_pred in {"en", "ru"}
    assert got[4].lang_pred == got[5].lang_pred
    assert op7_script_viterbi_language(spark, make_docs([])).count() == 0
    only_null = op7_script_viterbi_language(spark, make_docs([(1, "abc", None), (None, "abc", "en")])).collect()
    assert len(only_null) == 2


def test_scripts():
    assert [script_of(c) for c in "aéñЖ日あ한א☃"] == ["latin", "latin", "latin", "cyrillic", "han", "kana", "hangul", "hebrew", "other"]
