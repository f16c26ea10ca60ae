"""Language-model scores by prediction by partial matching over bytes.

A text is its words (A-Z in lower case) with one space between them and an end.
The model predicts it byte by byte: contexts are the ``DEPTH`` bytes before,
across words, from ``DEPTH`` start bytes on, and a trie holds how often each
symbol followed each context and each of its endings. Of d symbols seen n times
after a context, one seen c times has the share (c - 1/2) / n and the escape
d / 2n; it leads to the context one shorter, in which the symbols that the
longer context has seen are excluded. As these sets nest, what exclusion leaves
at the next level is two numbers per context, computed once.

All pairs of context and symbol are kept and none is broadcast but those of two
bytes and less (at most 256 ** 3, by the alphabet). Pairs and words travel as
sorted packed arrays, one row per task and shard; a shard holds all contexts that
end with certain three bytes, so orders 3 to ``DEPTH`` are complete in it.

Scoring deals texts into chunks (what one task reads). A chunk's distinct grams
and words are its questions, dealt to the model's shards; a shard answers a gram
by its log probability and a word by its count; the answers meet the chunk's
texts again, where each is weighted by how often a document holds it. Cost and
memory of a task depend on the chunk and the shard, not on the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, materialize, shuffle_partitions, table
from .shingles import GAMMA, _BYTES, _power_tables, mix

DEPTH = 6
LOW = 2  # orders up to this one are the same in every shard
SLICE_BYTES = 1 << 21  # of text worked on at a time
CHUNK_KEYS = 1 << 23  # distinct grams (before merging slices) after which a chunk ends
MODEL_KEYS = 1 << 22  # pairs of a shard held before they are summed

#: Bytes that no word holds, standing for a text's start, a word's end and the text's end.
START, WORD_END, TEXT_END = 0x0D, 0x20, 0x0A
SYMBOLS = 256
GRAM, WORD = 0, 1  # kinds of keys
LEAD = bytes([START]) * DEPTH


# --- packed arrays ---

def pack(values: np.ndarray, ordered: bool = True) -> bytes:
    """Unsigned 64-bit values, or the differences of ordered ones, as compressed byte planes."""
    values = values.astype(np.uint64)
    planes = (np.diff(values, prepend=np.uint64(0)) if ordered else values).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(raw: bytes, ordered: bool = True) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if ordered else values


def pack_values(values: np.ndarray, kind: int) -> bytes:
    """Logarithms of grams (all of one sign, so their sums keep 32 bits' precision) or counts of words."""
    return zstandard.compress(values.astype("<f4").tobytes(), 1) if kind == GRAM else pack(values, False)


def unpack_values(raw: bytes, kind: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<f4").astype(np.float64) if kind == GRAM else unpack(raw, False)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if keys.size else counts


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ordered array and where each begins."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if ordered.size else np.zeros(0, np.int64)
    return ordered[first], first


# --- texts as grams and words ---

def plain(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def pieces(texts: list[bytes], most: int = 256) -> Iterator[tuple[list[bytes], list[int]]]:
    """Slices of at most ``most`` pieces and about ``SLICE_BYTES``: the pieces with their lead, and whose they are.

    A piece is a text with its end, or a part of a long one, cut after a space;
    its lead are the ``DEPTH`` bytes before it.
    """
    out, owner, size = [], [], 0
    for i, t in enumerate(texts):
        whole, at = b"".join((LEAD, t, b"\n")), DEPTH
        while at < len(whole):
            cut = whole.find(b" ", at + SLICE_BYTES) + 1 if len(whole) - at > 2 * SLICE_BYTES else 0
            out.append(whole[at - DEPTH : cut or len(whole)])
            owner.append(i)
            size += len(out[-1])
            at = cut or len(whole)
            if size >= SLICE_BYTES or len(out) == most:
                yield out, owner
                out, owner, size = [], [], 0
    if out:
        yield out, owner


class Slice:
    """The symbols of some pieces: what gram each makes, and the words that end in them."""

    def __init__(self, parts: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def grams(self, with_piece: bool = False) -> np.ndarray:
        """For each symbol the context, nearest byte first, and the symbol; 56 bits, and with ``with_piece`` 8 for the piece."""
        n = self.raw.size - DEPTH
        key = np.zeros(n, np.uint64)
        for back in (*range(1, DEPTH + 1), 0):
            key <<= np.uint64(8)
            key |= self.raw[DEPTH - back : DEPTH - back + n]
        if with_piece:
            key <<= np.uint64(8)
            key |= np.repeat(np.arange(self.sizes.size, dtype=np.uint64), self.sizes)[DEPTH:]
        inside = np.ones(n, bool)
        for lead in range(DEPTH):  # the leads of all pieces but the first
            inside[self.begins[1:] - DEPTH + lead] = False
        return key[inside]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all words in order, and the piece of each."""
        last = np.flatnonzero((self.raw == WORD_END) | (self.raw == TEXT_END))
        piece = np.searchsorted(self.begins, last, side="right") - 1
        own = last >= self.begins[piece] + DEPTH  # not a lead's
        last, piece = last[own], piece[own]
        begin = np.empty_like(last)
        begin[1:] = last[:-1] + 1
        fresh = np.append(True, piece[1:] != piece[:-1])
        begin[fresh] = self.begins[piece[fresh]] + DEPTH
        power, inverse = _power_tables(self.raw.size + 1)
        prefix = np.zeros(self.raw.size + 1, np.uint64)
        np.cumsum(_BYTES[self.raw] * power[: self.raw.size], out=prefix[1:])
        spans = (prefix[last] - prefix[begin]) * inverse[begin]
        return mix(spans + (last - begin).astype(np.uint64) * GAMMA), piece

    def tokens(self) -> np.ndarray:
        """Of each piece: its words, and one for the text's end (an empty text has the end only)."""
        ends = np.add.reduceat((self.raw == WORD_END) | (self.raw == TEXT_END), self.begins, dtype=np.int64)
        for lead in range(DEPTH):
            ends -= self.raw[self.begins + lead] == WORD_END
        return ends + (self.raw[self.begins + self.sizes - 1] == TEXT_END) - self._empty()

    def _empty(self) -> np.ndarray:
        return (self.sizes == DEPTH + 1) & (self.raw[self.begins + self.sizes - 1] == TEXT_END)


END_WORD = mix(np.zeros(1, np.uint64))[0]  # the hash of no bytes: the end of a text


def words_and_ends(some: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and their pieces: words, and one end per text."""
    words, piece = some.words()
    ended = np.flatnonzero((some.raw[some.begins + some.sizes - 1] == TEXT_END) & ~some._empty())
    return np.append(words, np.full(ended.size, END_WORD)), np.append(piece, ended)


def shard_of(keys: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """The shard of each key: grams by the three bytes nearest to the symbol, words by themselves."""
    near = keys >> np.uint64(32) if kind == GRAM else keys
    return (mix(near + GAMMA) % np.uint64(shards)).astype(np.int32)


class Counted:
    """Distinct grams and words of a chunk of texts, with their counts."""

    def __init__(self) -> None:
        self.grams: list[np.ndarray] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, some: Slice) -> None:
        keys = some.grams()
        keys.sort()
        distinct, first = runs(keys)
        counts = np.diff(np.append(first, keys.size))
        times = (counts - 1) // 255  # a count is the low 8 bits; what is more comes as further entries
        self.grams.append(distinct << np.uint64(8) | (counts - 255 * times).astype(np.uint64))
        if times.any():
            self.grams.append(np.repeat(distinct << np.uint64(8) | np.uint64(255), times))
        self.held += distinct.size
        words = np.sort(words_and_ends(some)[0])
        distinct, first = runs(words)
        self.words.append((distinct, np.diff(np.append(first, words.size))))

    def take(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Rows (kind, ordered keys, counts); forgets them."""
        if not self.grams:
            return []
        keys = np.sort(np.concatenate(self.grams))
        distinct, first = runs(keys >> np.uint64(8))
        counts = np.add.reduceat((keys & np.uint64(255)).astype(np.int64), first)
        words = summed(np.concatenate([w for w, _ in self.words]), np.concatenate([n for _, n in self.words]))
        self.__init__()
        return [(GRAM, distinct, counts), (WORD, *words)]


def _by_shard(keys: np.ndarray, kind: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its keys, in order."""
    shard = shard_of(keys, kind, shards)
    order = np.argsort(shard, kind="stable")
    names, first = runs(shard[order])
    for s, a, b in zip(names.tolist(), first, np.append(first[1:], keys.size)):
        yield s, order[a:b]


# --- the trie ---

class Level:
    """The pairs of one order, and per context: total, symbols, and what exclusion of its symbols leaves one order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: "Level | None") -> None:
        self.keys, self.counts = keys, counts
        self.contexts, first = runs(keys >> np.uint64(8))
        self.total = np.add.reduceat(counts, first) if keys.size else counts
        self.symbols = np.diff(np.append(first, keys.size))
        if below is not None and keys.size:
            shorter = (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))
            taken = np.add.reduceat(below.counts[np.searchsorted(below.keys, shorter)], first)
            parent = np.searchsorted(below.contexts, self.contexts >> np.uint64(8))
            self.rest_total, self.rest_symbols = below.total[parent] - taken, below.symbols[parent] - self.symbols
        else:
            self.rest_total = self.rest_symbols = np.zeros(self.contexts.size, np.int64)

    def find(self, table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table_, keys), max(0, table_.size - 1))
        return at, (table_[at] == keys) if table_.size else np.zeros(keys.size, bool)


def shorten(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the order one below, summed."""
    return summed((keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255)), counts)


class Trie:
    """Levels of orders 0 to DEPTH; ``low`` are the pairs of order ``LOW`` of the whole model, ``pairs`` a shard's of order DEPTH."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray]) -> None:
        some = [low]
        while len(some) <= LOW:
            some.append(shorten(*some[-1]))
        self.levels: list[Level] = []
        for keys, counts in reversed(some):
            self.levels.append(Level(keys, counts, self.levels[-1] if self.levels else None))

    def with_shard(self, pairs: tuple[np.ndarray, np.ndarray]) -> "Trie":
        some = [pairs]
        while len(some) < DEPTH - LOW:
            some.append(shorten(*some[-1]))
        whole = object.__new__(Trie)
        whole.levels = list(self.levels)
        for keys, counts in reversed(some):
            whole.levels.append(Level(keys, counts, whole.levels[-1]))
        return whole

    def log_of(self, grams: np.ndarray) -> np.ndarray:
        """log10 of each gram's symbol's probability after its context."""
        logs, waiting = np.zeros(grams.size), np.arange(grams.size)
        total, kinds = np.zeros(grams.size, np.int64), np.full(grams.size, -1, np.int64)  # after exclusion; -1: nothing is excluded
        symbol = grams & np.uint64(255)
        for order in range(DEPTH, -1, -1):
            level = self.levels[order]
            context = grams[waiting] >> np.uint64(8 * (DEPTH - order + 1))
            ctx, known = level.find(level.contexts, context)
            here, ctx = waiting[known], ctx[known]
            fresh = kinds[here] < 0
            all_, some = np.where(fresh, level.total[ctx], total[here]), np.where(fresh, level.symbols[ctx], kinds[here])
            at, seen = level.find(level.keys, context[known] << np.uint64(8) | symbol[here])
            logs[here[seen]] += np.log10((level.counts[at[seen]] - 0.5) / all_[seen])
            out = ~seen & (some > 0)
            logs[here[out]] += np.log10(some[out] / (2 * all_[out]))
            total[here], kinds[here] = level.rest_total[ctx], level.rest_symbols[ctx]
            done = np.zeros(waiting.size, bool)
            done[np.flatnonzero(known)[seen]] = True
            waiting = waiting[~done]
        root = self.levels[0].symbols[0] if self.levels[0].keys.size else 0
        logs[waiting] -= math.log10(max(1, SYMBOLS - root))
        return logs


# --- training ---

@dataclass
class Model:
    shards: int
    rows: DataFrame  # (shard, kind, keys, counts, n_keys, n_total): one row per shard and kind
    low: tuple[np.ndarray, np.ndarray]  # pairs of order LOW
    train_tokens: int
    vocabulary: int


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, [plain(t.as_py()) for t in part.column(part.num_columns - 1)]


def _slices(parts: Iterator[list[bytes]]) -> Iterator[Slice]:
    """Slices of texts given in portions; small portions share a slice."""
    held: list[bytes] = []
    size = 0
    for texts in parts:
        held += texts
        size += sum(map(len, texts))
        if size > SLICE_BYTES:
            for some, _ in pieces(held, len(held)):
                yield Slice(some)
            held, size = [], 0
    for some, _ in pieces(held, len(held)):
        yield Slice(some)


def train(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """The model of all rows of ``docs``; null texts count as empty, an empty table gives a model that knows nothing."""
    shards = shards or 2 * shuffle_partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counted()

        def out() -> Iterator[pa.RecordBatch]:
            for kind, keys, counts in found.take():
                rows = [(s, pack(keys[at]), pack(counts[at], False)) for s, at in _by_shard(keys, kind, shards)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array(np.full(len(rows), kind), pa.int32()),
                     *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["shard", "kind", "keys", "counts"])

        for some in _slices(t for _, t in _texts(batches)):
            found.add(some)
            if found.held > CHUNK_KEYS:
                yield from out()
        yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if current is not None:
                keys, counts = summed(*(np.concatenate(x) for x in zip(*held)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int32()), pa.array([pack(keys)], pa.binary()), pa.array([pack(counts, False)], pa.binary()),
                     pa.array([keys.size], pa.int64()), pa.array([int(counts.sum())], pa.int64())],
                    names=["shard", "kind", "keys", "counts", "n_keys", "n_total"])

        for batch in batches:
            for shard, kind, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, kind) != current:
                    yield from out()
                    current, held, size = (shard, kind), [], 0
                held.append((unpack(keys), unpack(counts, False).astype(np.int64)))
                size += held[-1][0].size
                if size > MODEL_KEYS and len(held) > 1:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = 0
        yield from out()

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = unpack(keys), unpack(counts, False).astype(np.int64)
                for _ in range(DEPTH - LOW):
                    pairs = shorten(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1])], names=["gram", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "shard int, kind int, keys binary, counts binary")
    dealt = parts.repartition("shard").sortWithinPartitions("shard", "kind")
    rows = materialize(dealt.mapInArrow(gather, "shard int, kind int, keys binary, counts binary, n_keys long, n_total long"), "ppm-model")
    words = rows.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("n_total"), F.lit(0)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    low = rows.filter(F.col("kind") == GRAM).select("keys", "counts").mapInArrow(shortened, "gram long, n long")
    low = low.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()  # at most 256 ** 3 pairs
    return Model(shards, rows, (low["gram"].to_numpy().astype(np.uint64), low["n"].to_numpy()), words[0], words[1])


# --- scoring ---

def _answer(model_low: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = current = trie = None
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def values(kind: int, keys: np.ndarray) -> np.ndarray:
            if kind == GRAM:
                return trie.log_of(keys)
            at = np.minimum(np.searchsorted(known[0], keys), max(0, known[0].size - 1))
            there = (known[0][at] == keys) if known[0].size else np.zeros(keys.size, bool)
            return np.where(there, known[1][at] if known[0].size else 0, 0)

        for batch in batches:
            shards, kinds, chunks, keys, counts = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(shards):
                mine, first = (shards[at], kinds[at]), at
                while at < len(shards) and (shards[at], kinds[at]) == mine:
                    at += 1
                if mine != current:
                    current, known, trie = mine, nothing, None
                if chunks[first] is None:  # the model's own row comes first
                    known = unpack(keys[first]), unpack(counts[first], False).astype(np.int64)
                    first += 1
                if trie is None and first < at and mine[1] == GRAM:
                    base = base or Trie(model_low.value)
                    trie = base.with_shard(known)
                while first < at:  # many chunks ask the same, so some of them are answered together
                    asked, end, size = [], first, 0
                    while end < at and size < MODEL_KEYS // 4:
                        asked.append(unpack(keys[end]))
                        size += asked[-1].size
                        end += 1
                    some, back = np.unique(np.concatenate(asked), return_inverse=True)
                    found = values(mine[1], some)[back]
                    cuts = np.cumsum([a.size for a in asked])[:-1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(chunks[first:end], pa.int64()), pa.array(np.full(end - first, mine[1]), pa.int32()), pa.array(keys[first:end], pa.binary()),
                         pa.array([pack_values(v, mine[1]) for v in np.split(found, cuts)], pa.binary())], names=["chunk", "kind", "keys", "payload"])
                    first = end

    return run


def _ask(shards: int):
    """Rows of a task's chunks: questions (kind and shard) and, with kind -1, the texts and other columns as Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chunk, kept = Counted(), TaskContext.get().partitionId() << 24, 0
        names, kinds = ["chunk", "kind", "shard", "keys", "payload"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=names)

        def questions() -> Iterator[pa.RecordBatch]:
            for kind, keys, _ in found.take():
                yield out([(chunk, kind, s, pack(keys[at]), None) for s, at in _by_shard(keys, kind, shards)])

        held: list[bytes] = []
        size = 0

        def count() -> None:
            for some, _ in pieces(held, len(held)):
                found.add(Slice(some))

        for part, texts in _texts(batches):
            sink = pa.BufferOutputStream()
            whole = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.large_binary())], names=[str(i) for i in range(part.num_columns)])
            with pa.ipc.new_stream(sink, whole.schema) as stream:
                stream.write_batch(whole)
            yield out([(chunk, -1, kept, None, zstandard.compress(sink.getvalue(), 1))])
            kept += 1
            held += texts
            size += sum(map(len, texts))
            if size > SLICE_BYTES:
                count()
                held, size = [], 0
                if found.held > CHUNK_KEYS:
                    yield from questions()
                    chunk, kept = chunk + 1, 0
        count()
        yield from questions()

    return run


def _finish(names: list[str]):
    """Rows of a chunk's documents from its answers (kinds 0 and 1) and its texts, which come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, answers = None, {}

        def ready(kind: int) -> tuple[np.ndarray, np.ndarray]:
            rows = answers.get(kind)
            if isinstance(rows, list):
                keys, values = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
                order = np.argsort(keys, kind="stable")
                answers[kind] = keys[order], values[order]
            return answers[kind]

        def score(texts: list[bytes]) -> list[np.ndarray]:
            n = len(texts)
            tokens, known, base, logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for parts, owner in pieces(texts):
                some, owner = Slice(parts), np.array(owner)
                k = owner.size
                np.add.at(tokens, owner, some.tokens())
                keys = np.sort(some.grams(True))
                distinct, first = runs(keys >> np.uint64(8))
                values = np.repeat(ready(GRAM)[1][np.searchsorted(ready(GRAM)[0], distinct)], np.diff(np.append(first, keys.size)))
                np.add.at(logs, owner, np.bincount((keys & np.uint64(255)).astype(np.int64), values, k))
                words, piece = words_and_ends(some)
                counts = ready(WORD)[1][np.searchsorted(ready(WORD)[0], words)].astype(np.float64)
                np.add.at(base, owner, np.bincount(piece, np.log10(counts + 0.5), k))
                np.add.at(known, owner, np.bincount(piece, counts > 0, k).astype(np.int64))
            return [tokens, known, base, logs]

        for batch in batches:
            for chunk, kind, keys, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != current:
                    current, answers = chunk, {}
                if kind >= 0:
                    answers.setdefault(kind, []).append((unpack(keys), unpack_values(payload, kind)))
                    continue
                with pa.ipc.open_stream(zstandard.decompress(payload)) as stream:
                    for part in stream:
                        found = score(part.column(part.num_columns - 1).to_pylist())
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, found)], names=[*names, "n_tokens", "n_known", "known_log", "score"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, *keep, n_tokens, n_known, train_tokens, base_score, score), one per row of ``docs``.

    Null texts are empty (an end alone). Repeated rows and keys each keep a
    row, equal texts get equal scores. ``key`` and ``keep`` may have any names
    but those of the results; columns named otherwise are not read. An empty
    table gives an empty result.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    names = [key, *keep]
    inner = [f"kept_{i}" for i in range(len(names))]
    low = spark.sparkContext.broadcast(model.low)
    some = docs.select(*(F.col(c).alias(i) for c, i in zip(names, inner)), F.col(text).alias("text"))
    chunks = materialize(some.mapInArrow(_ask(model.shards), "chunk long, kind int, shard int, keys binary, payload binary"), "ppm-chunks")
    asked = chunks.filter("kind >= 0").select("shard", "kind", "chunk", "keys", F.lit(None).cast("binary").alias("counts"))
    known = model.rows.select("shard", "kind", F.lit(None).cast("long").alias("chunk"), "keys", "counts")
    dealt = known.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", F.col("chunk").asc_nulls_first())
    answers = dealt.mapInArrow(_answer(low), "chunk long, kind int, keys binary, payload binary")
    texts = chunks.filter("kind < 0").select("chunk", "kind", "keys", "payload")
    together = answers.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"))
    head = ", ".join(f"{i} {kinds[c]}" for c, i in zip(names, inner))
    found = together.mapInArrow(_finish(inner), f"{head}, n_tokens long, n_known long, known_log double, score double")
    whole = math.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
    return found.select(
        *(F.col(i).alias(c) for c, i in zip(names, inner)), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * whole).alias("base_score"), "score")


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 5 is not 1.

    Null and empty texts are an end alone; repeated rows each keep a row.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 1)
    return score(docs, train(docs.filter(~F.col("held_out"))), keep=("held_out",))
