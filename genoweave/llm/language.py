"""Language labels by script ranges and a Viterbi path over per-word scores.

A model holds, per language, smoothed log frequencies of letter trigrams (with
word borders) and the scripts its training text uses. A word's scripts narrow
the candidate languages; the candidates' trigram scores are its emissions. The
Viterbi path over a text's words, with a penalty for switching, labels spans.
The language with most letters on the path is the prediction and its share of
the letters the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, free_name, table

#: Documents per language used for training, about (chosen by hash over all labelled rows).
TRAIN_DOCS = 2000
SWITCH = 8.0  # cost of a change of language, in nats
CACHE_WORDS = 300_000
TEXTS = 1000  # texts labelled together; bounds what a worker holds besides a batch
OTHER = -30.0  # emission of a language whose scripts a word doesn't fit

#: First and last code points of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("han", 0x3400, 0x4DBF),
)
_STARTS = np.array(sorted(s[1] for s in SCRIPTS))
_BY_START = {a: (name, b) for name, a, b in SCRIPTS}


def script_of(char: str) -> str:
    at = int(np.searchsorted(_STARTS, ord(char), side="right")) - 1
    name, last = _BY_START[int(_STARTS[at])] if at >= 0 else ("other", -1)
    return name if ord(char) <= last else "other"


def letters_of(word: str) -> str:
    """The word's letters, lower case."""
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def grams(letters: str) -> list[str]:
    bordered = f"^{letters}$"
    return [bordered[i : i + 3] for i in range(len(bordered) - 2)]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # row per trigram, last row for unseen ones
    index: dict[str, int]
    scripts: dict[str, np.ndarray]  # script -> True for languages that use it

    @classmethod
    def from_counts(cls, rows: list[tuple[str, str, str, int]]) -> "LanguageModel":
        """From rows (lang, 'gram' or 'script', value, count)."""
        languages = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(languages)}
        kinds = sorted({r[2] for r in rows if r[1] == "gram"})
        index = {g: i for i, g in enumerate(kinds)}
        counts = np.zeros((len(kinds) + 1, len(languages)))
        used: dict[str, np.ndarray] = {}
        for lang, kind, value, n in rows:
            if kind == "gram":
                counts[index[value], at[lang]] += n
            else:
                used.setdefault(value, np.zeros(len(languages)))[at[lang]] += n
        total = counts.sum(0)
        logs = np.log((counts + 0.5) / (total + 0.5 * (len(kinds) + 1)))
        letters = sum(used.values(), np.zeros(len(languages)))
        scripts = {s: n > 0.01 * letters for s, n in used.items()}
        return cls(languages, logs.astype(np.float32), index, scripts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_DOCS) -> LanguageModel:
    """A model from about ``per_language`` whole texts of each language.

    Rows with null text or language teach nothing. The counts that reach the
    driver are those of the bounded sample.
    """
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((1, 0), np.float32), {}, {})
    one_in = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // per_language))))
    sample = labelled.filter(F.pmod(F.xxhash64(key), one_in[F.col(lang)]) == 0).select(lang, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(label, Counter()).update(t.split())
        out: list[list] = [[], [], [], []]
        for label, counter in words.items():
            found: Counter = Counter()
            for w, n in counter.items():
                if letters := letters_of(w):
                    for g in grams(letters):
                        found["gram", g] += n
                    for c in letters:
                        found["script", script_of(c)] += n
            for (kind, value), n in found.items():
                for col, v in zip(out, (label, kind, value, n)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.int64())], names=["lang", "kind", "value", "n"])

    counted = sample.mapInArrow(count, "lang string, kind string, value string, n long")
    rows = counted.groupBy("lang", "kind", "value").agg(F.sum("n").alias("n")).collect()
    return LanguageModel.from_counts([tuple(r) for r in rows])


class Labeller:
    """Applies a model to texts; keeps the scores of recent words."""

    def __init__(self, model: LanguageModel, switch: float = SWITCH) -> None:
        self.model, self.switch = model, switch
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def _learn(self, words: list[str]) -> None:
        first, need = len(self.ids), len(self.ids) + len(words)
        if need > len(self.letters):
            size = max(need, 2 * len(self.letters))
            self.scores, self.letters = np.resize(self.scores, (size, self.scores.shape[1])), np.resize(self.letters, size)
        index, unseen = self.model.index, len(self.model.index)
        pure = [letters_of(w) for w in words]
        flat = [index.get(g, unseen) for p in pure if p for g in grams(p)]
        lengths = np.array([len(p) for p in pure])
        has = lengths > 0
        rows = np.zeros((len(words), self.scores.shape[1]), np.float32)
        if flat:
            starts = np.concatenate([[0], np.cumsum(lengths[has])[:-1]])  # a word of n letters has n trigrams
            rows[has] = np.add.reduceat(self.model.table[np.array(flat)], starts, axis=0)
        for i, p in enumerate(pure):
            if p and not p.isascii():
                rows[i] += self._narrowed(p)
            elif p and not self.model.scripts.get("latin", np.ones(1)).all():
                rows[i] += np.where(self.model.scripts["latin"], 0, OTHER)
        self.scores[first:need], self.letters[first:need] = rows, lengths
        self.ids |= zip(words, range(first, need))

    def _narrowed(self, letters: str) -> np.ndarray:
        """OTHER for languages that lack a script of the word, if some language has them all."""
        allowed = np.ones(len(self.model.languages), bool)
        for script in {script_of(c) for c in letters}:
            allowed &= self.model.scripts.get(script, np.zeros(1, bool))
        return np.where(allowed, 0, OTHER) if allowed.any() else np.zeros(len(allowed))

    def label(self, texts: list[str | None], spans: bool = False) -> tuple[list[str], list[float], list[list[dict]]]:
        if len(self.ids) > CACHE_WORDS:
            self._clear()
        words_of = []
        for at in range(0, len(texts), 32):
            some = [(t or "").split() for t in texts[at : at + 32]]
            if new := list(set().union(*some).difference(self.ids)):
                self._learn(new)
            words_of += [np.fromiter(map(self.ids.__getitem__, w), np.int32, len(w)) for w in some]
        # words without letters carry no evidence
        kept = [w if spans else w[self.letters[w] > 0] for w in words_of]
        sizes = np.array([len(w) for w in kept])
        names = self.model.languages
        weights, paths = self._viterbi(kept, sizes, spans) if names else (np.zeros((len(texts), 0)), [])
        langs, scores, found = [], [], []
        for d in range(len(texts)):
            total = float(weights[d].sum())
            best = int(weights[d].argmax()) if total else 0
            langs.append(names[best] if total else "und")
            scores.append(float(weights[d, best]) / total if total else 0.0)
            if spans:
                path = paths[d] if names else np.zeros(0, int)
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if total else [0]
                found.append([{"start": a, "end": b, "lang": names[path[a]]} for a, b in zip(cuts, cuts[1:])])
        return langs, scores, found

    def _viterbi(self, words: list[np.ndarray], sizes: np.ndarray, spans: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Letters per document and language on the best paths; all documents advance together."""
        n, k = len(words), len(self.model.languages)
        by_size = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([words[d] for d in by_size]) if n else np.zeros(0, np.int32)
        length = sizes[by_size]
        offset = np.concatenate([[0], np.cumsum(length)[:-1]]) if n else np.zeros(0, int)
        steps = int(length[0]) if n else 0
        active = np.searchsorted(-length, -np.arange(steps), side="left")  # documents with more than t words
        v = np.zeros((n, k), np.float32)
        stay, before = [], []
        for t in range(steps):
            a = active[t]
            prev = v[:a]
            best = prev.argmax(1)
            floor = prev.max(1, keepdims=True) - self.switch
            stay.append(prev >= floor)
            before.append(best.astype(np.int16))
            v[:a] = np.maximum(prev, floor) + self.scores[flat[offset[:a] + t]]
        weights = np.zeros((n, k))
        path = np.zeros(len(flat), np.int16) if spans else None
        now = v.argmax(1) if n else np.zeros(0, int)
        every = np.arange(n)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            cur, rows = now[:a], every[:a]
            at = offset[:a] + t
            weights[rows, cur] += self.letters[flat[at]]
            if spans:
                path[at] = cur
            now[:a] = np.where(stay[t][rows, cur], cur, before[t])
        out = np.empty_like(weights)
        out[by_size] = weights
        paths: list = [None] * n
        if spans:
            for i, d in enumerate(by_size):
                paths[d] = path[offset[i] : offset[i] + length[i]]
        return out, paths


def identify(df: DataFrame, model: LanguageModel, text: str = "text", spans: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (and ``lang_spans``: places of white-space-separated words, end exclusive).

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything if the model knows no language. Existing columns with these
    names are replaced; others pass through.
    """
    added = "lang_pred string, score double" + ", lang_spans array<struct<start:int,end:int,lang:string>>" * spans
    df = df.drop("lang_pred", "score", *["lang_spans"] * spans)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))]

    @F.arrow_udf(added)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        for batch in batches:
            parts = [labeller.label(batch.slice(at, TEXTS).to_pylist(), spans) for at in range(0, len(batch), TEXTS)]
            columns = [pa.array([x for part in parts for x in part[k]], kinds[k]) for k in range(2 + spans)]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "lang_spans"][: 2 + spans])

    got = free_name(df.columns, "language_result")
    names = ["lang_pred", "score", *["lang_spans"] * spans]
    return df.withColumn(got, predict(F.col(text))).select(*df.columns, *(f"{got}.{x}" for x in names))


def op7_script_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 3 is not 1.

    One row per row, repeated ones too; equal texts get equal results. Null
    texts and texts without a letter are ``und``. Of languages with equally many
    letters the first by name is taken. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
