"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with up to ``error_rate`` of its characters edited. It is cut
into that budget plus one pieces, so every such occurrence holds one piece
unchanged. All pieces are searched at once in each whole text. A hit around
which more of the item's letter grams are missing than its budget of edits can
destroy is dropped; any other is verified with Myers' bit-parallel edit distance
to its left and to its right. Items of fewer than ``SHORT_CHARS`` characters must
occur unchanged and as whole words, as a few edits would make other words of them.
Texts and items are compared in lower case with white space runs as one space.

Items are broadcast in blocks of about ``BLOCK_CHARS`` characters, each matched
against all texts; the blocks bound memory, not the number of items.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

ERROR_RATE = 0.1
SHORT_CHARS = 20  # shorter items (after normalising) have no budget and match whole words only
BLOCK_CHARS = 1_000_000
GRAM = 3  # an edit destroys at most so many of an item's grams of that length


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def prefix_distance(masks: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """Least edit distance of a pattern to any prefix of ``text``, and that prefix's length (the shortest).

    ``masks`` and ``m`` describe the pattern. Distances over ``limit`` are
    returned as limit + 1.
    """
    if m == 0:
        return 0, 0
    top, full = 1 << (m - 1), (1 << m) - 1
    up, down, score = full, 0, m
    best, length = m, 0
    get = masks.get
    for j, c in enumerate(text[: m + limit], 1):
        eq = get(c, 0)
        x = eq | down
        d0 = ((eq & up) + up ^ up) | x
        right_up = down | ~(d0 | up) & full
        right_down = up & d0
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        if score < best:
            best, length = score, j
        right_up = right_up << 1 | 1
        right_down <<= 1
        up = (right_down | ~(d0 | right_up)) & full
        down = right_up & d0 & full
    return (best, length) if best <= limit else (limit + 1, 0)


def _border(text: str, at: int) -> bool:
    """Place ``at`` does not part two letters or digits."""
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


class ItemMatcher:
    """Finds items (id, text) in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE) -> None:
        by_text: dict[str, list[int]] = {}
        for key, text in items:
            if t := normal(text):
                by_text.setdefault(t, []).append(key)
        self.items = [(t, int(error_rate * len(t)) if len(t) >= SHORT_CHARS else 0, keys) for t, keys in by_text.items()]
        pieces: dict[str, list] = {}
        for n, (t, budget, _) in enumerate(self.items):
            cuts = [k * len(t) // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()
        self.grams = [frozenset(t[i : i + GRAM] for i in range(len(t) - GRAM + 1)) for t, _, _ in self.items]
        self.ready: dict[tuple[int, int, int], tuple] = {}

    def _sides(self, n: int, a: int, b: int) -> tuple:
        """Masks and lengths of the item right of a piece and (reversed) left of it."""
        if (n, a, b) not in self.ready:
            t = self.items[n][0]
            right, left = t[b:], t[:a][::-1]
            self.ready[n, a, b] = tuple((_masks(s), len(s)) for s in (right, left))
        return self.ready[n, a, b]

    def match(self, text: str | None, any_will_do: bool = False) -> dict[int, tuple[int, int, int]]:
        """For each item found: item number -> (distance, start, end) of its best occurrence in the normalised text."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items:
            return found
        t = normal(text)
        for last, places in self.automaton.iter(t):
            for n, a, b in places:
                budget, begin = self.items[n][1], last + 1 - (b - a)
                known = found.get(n)
                if known and known[0] == 0:
                    continue  # nothing better can come
                if len(self.items[n][0]) < SHORT_CHARS:
                    if _border(t, begin) and _border(t, last + 1):
                        found[n] = (0, begin, last + 1)
                        if any_will_do:
                            return found
                    continue
                left_size, right_size = a + budget, len(self.items[n][0]) - b + budget
                window = t[max(0, begin - left_size) : last + 1 + right_size]
                present = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
                if len(self.grams[n] - present) > GRAM * budget:
                    continue
                right, left = self._sides(n, a, b)
                after, before = t[last + 1 : last + 1 + right_size], t[max(0, begin - left_size) : begin][::-1]
                r, to = prefix_distance(*right, after, budget)
                if r > budget:
                    continue
                l, back = prefix_distance(*left, before, budget - r)
                if r + l <= budget and (known is None or r + l < known[0]):
                    found[n] = (r + l, begin - back, last + 1 + to)
                    if any_will_do:
                        return found
        return found


_matchers: dict[str, ItemMatcher] = {}


def _matcher(token: str, shared: Broadcast, error_rate: float) -> ItemMatcher:
    """This worker's matcher for a block of items; only the latest is kept."""
    if token not in _matchers:
        _matchers.clear()
        _matchers[token] = ItemMatcher(shared.value, error_rate)
    return _matchers[token]


def _item_blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items with id and text, in blocks of about ``BLOCK_CHARS`` characters."""
    items = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("item_text"))
    items = items.filter("item_id is not null and item_text is not null")
    total = items.agg(F.sum(F.length("item_text").cast("long") + 1)).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).collect()
        yield [(r[0], r[1]) for r in rows]


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """Rows (doc_id, item_id, distance, budget, start, end) for every item found in a row of ``docs``.

    Null and empty texts hold nothing; items with null id, or that normalise to
    nothing, match nothing; items of fewer than ``SHORT_CHARS`` characters match
    unchanged and as whole words; items of equal text are all returned. A repeated document row repeats its result. start and
    end are places of the best (first among equals) occurrence in the
    normalised text. Only the named columns are read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, budget int, start long, end long"
    pairs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _item_blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(token, shared, error_rate)
            for batch in batches:
                cols: list[list] = [[] for _ in range(6)]
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for n, (distance, start, end) in matcher.match(t.as_py()).items():
                        _, budget, ids = matcher.items[n]
                        for item in ids:
                            for col, v in zip(cols, (doc, item, distance, budget, start, end)):
                                col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "distance", "budget", "start", "end"])

        part = pairs.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _clean(shared: Broadcast, error_rate: float):
    """A boolean UDF: the text holds none of the broadcast items."""
    token = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(token, shared, error_rate)
        for batch in batches:
            yield pd.Series([not matcher.match(t, True) for t in batch], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows and columns are otherwise unchanged, and nothing is shuffled."""
    for block in _item_blocks(items, item_key, item_text):
        docs = docs.filter(_clean(docs.sparkSession.sparkContext.broadcast(block), error_rate)(F.col(text)))
    return docs


def op6_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found, within a tenth of its characters, in every document; repeated rows repeat their results."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
