"""Substring deduplication on a compacted de Bruijn graph of word windows.

A window of ``WINDOW`` words is an edge of the graph. Windows are compacted where
they are read: consecutive windows of a text that hold the same anchor (the
largest-hashed run of ``ANCHOR`` words inside each of them) form one path. Equal
windows hold equal anchors, so paths need to be compared only by anchor. Where
all paths of an anchor are one and the same, nothing branches and the smallest
document decides for the whole path. Where they differ, each distinct path still
goes as a whole in all documents but its first; there it is looked up in its
source text, and its windows are joined by their hashes with those of the other
paths.

The rows that travel are paths (about five windows each). Anchors that hold a
notable share of all paths, found in a sample of texts, are dealt out at random
and always treated as branching, so no task gathers them; the sample decides
where work is done, not what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .common import materialize, table
from .shingles import GAMMA, Windows, mix, words_of

WINDOW, ANCHOR = 13, 5
SAMPLE_TEXTS = 64  # one in so many texts is looked at for frequent anchors
FREQUENT = 5000  # an anchor with 1 / FREQUENT of the sample's paths is frequent; so there are at most FREQUENT

# An occurrence is one long: first window, number of windows (at most 9), frequent or not, 16 bits of the text's hash.
LENGTH_BITS, PRINT_BITS = 5, 16


def text_print(words: list[bytes], windows: Windows) -> int:
    """16 bits that tell apart texts of rows with one doc_id."""
    return int(mix(windows.prefix[-1:] + np.uint64(len(words)))[0]) & 0xFFFF


def paths(windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, path hashes, first windows and numbers of windows of a text."""
    n = windows.n - WINDOW + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z
    grams = windows.hashes(ANCHOR)
    at = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1).argmax(1) + np.arange(n)  # leftmost of the largest
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    length = np.diff(np.append(first, n))
    a, b = windows.starts[first], windows.ends[first + length + WINDOW - 2]
    spans = (windows.prefix[b] - windows.prefix[a]) * windows.inverse[a]
    shape = (b - a).astype(np.uint64) * GAMMA + (at[first] - first).astype(np.uint64)
    return grams[at[first]], mix(mix(spans + GAMMA) ^ shape), first, length


def _read(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 200):
                some = []
                for t in texts.slice(at, 200):
                    words = words_of(t.as_py(), False)
                    w = Windows(words)
                    anchor, path, first, length = paths(w)
                    hot = np.isin(anchor, frequent)
                    if hot.any():  # dealt out by keys of their own
                        anchor = np.where(hot, mix(path + first.astype(np.uint64) * GAMMA), anchor)
                    place = ((first << LENGTH_BITS | length) << 1 | hot) << PRINT_BITS | text_print(words, w)
                    some.append((anchor, path, place))
                rows = np.array([x[0].size for x in some])
                owner = docs.slice(at, 200).take(pa.array(np.repeat(np.arange(rows.size), rows)))
                yield pa.RecordBatch.from_arrays(
                    [owner, pa.array(np.concatenate([x[2] for x in some]).astype(np.int64)), *(pa.array(np.concatenate([x[k] for x in some]).view(np.int64)) for k in (0, 1))],
                    names=["doc", "place", "anchor", "path"])

    return run


def _source_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (window, doc, code) of the windows of paths, looked up in their texts."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = words_of(text.as_py(), False)
            w = Windows(words)
            mark, hashes = text_print(words, w), w.hashes(WINDOW).view(np.int64)
            for place in places:
                start, n = place >> (PRINT_BITS + 1 + LENGTH_BITS), place >> (PRINT_BITS + 1) & (1 << LENGTH_BITS) - 1
                if place & 0xFFFF == mark and start + n <= hashes.size:
                    out[0].append(hashes[start : start + n])
                    out[1] += [doc] * n
                    out[2] += [(i << LENGTH_BITS | 1) << PRINT_BITS | mark for i in range(start, start + n)]
        found = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["window", "doc", "code"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_words, n_removed, kept_text)."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, places in zip(batch.column(1), batch.column(2).to_pylist()):
            words = words_of(text.as_py(), False)
            n_words.append(len(words))
            if places:
                codes = np.array(places, np.int64)
                codes = codes[codes & 0xFFFF == text_print(words, Windows(words))]
                start, n = codes >> (PRINT_BITS + LENGTH_BITS), codes >> PRINT_BITS & (1 << LENGTH_BITS) - 1
                inside = start + n + WINDOW - 1 <= len(words)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start[inside], 1)
                np.add.at(change, start[inside] + n[inside] + WINDOW - 1, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text), one per row of ``docs``.

    A word goes if some window of ``WINDOW`` words over it also starts in a
    document with a smaller key. Kept words are joined by one space. Null and
    empty texts have no words; shorter texts lose none. A null key is neither
    smaller nor larger than any. Rows of one key don't count against each
    other. Only ``key`` and ``text`` are read; an empty table gives an empty
    result.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = "doc long, place long, anchor long, path long"
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_TEXTS)) == 0).mapInArrow(_read(np.zeros(0, np.uint64)), schema)
    seen = materialize(sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 20"), "sample-anchors")
    total = seen.agg(F.sum("n")).first()[0] or 0
    frequent = np.array([r[0] for r in seen.filter(F.col("n") * FREQUENT >= total).select("anchor").collect()], np.int64).view(np.uint64)

    found = docs.mapInArrow(_read(frequent), schema).repartition("anchor")
    same = W.partitionBy("anchor")
    hot = F.col("place").bitwiseAND(1 << PRINT_BITS) != 0
    judged = found.select(
        "doc", "place", "path", hot.alias("hot"), F.min("doc").over(same).alias("smallest"), F.max("doc").over(same).alias("largest"),
        (F.min("path").over(same) != F.max("path").over(same)).alias("differ"))
    shared = materialize(judged.filter("hot or smallest < largest").select(
        "doc", "place", "path", (F.col("hot") | F.col("differ")).alias("branching"), "smallest").filter("branching or smallest < doc"), "repeated-paths")

    by_doc = docs.repartition("doc_id")  # the texts travel once; both uses below read the same exchange
    start = F.shiftright("place", PRINT_BITS + 1 + LENGTH_BITS)
    mark = F.col("place").bitwiseAND((1 << PRINT_BITS) - 1)
    length = F.shiftright("place", PRINT_BITS + 1).bitwiseAND((1 << LENGTH_BITS) - 1)
    code = F.shiftleft(F.shiftleft(start, LENGTH_BITS) + length, PRINT_BITS) + mark
    branching = shared.filter("branching").select("path", "doc", "place")
    # written, so that the join below reads two plain exchanges and a frequent path's rows can be split
    first = materialize(branching.groupBy("path").agg(F.min("doc").alias("smallest")), "first-of-path")
    branching = branching.join(first, "path")
    # a path that a smaller document holds as a whole goes as a whole; its first document's windows are compared one by one
    whole = shared.filter("not branching").unionByName(branching.filter("smallest < doc"), allowMissingColumns=True).select("doc", code.alias("code"))
    wanted = branching.filter("smallest = doc").groupBy("doc").agg(F.collect_set("place").alias("places"))
    windows = by_doc.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "places").mapInArrow(
        _source_windows, "window long, doc long, code long")
    starts = windows.groupBy("window").agg(F.min("doc").alias("smallest"), F.max("doc").alias("largest")).filter("smallest < largest")
    parts = windows.join(starts, "window").filter("smallest < doc").select("doc", "code")
    cuts = whole.unionByName(parts).groupBy("doc").agg(F.collect_set("code").alias("places"))
    return by_doc.join(cuts.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "places").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op4_de_bruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document's words without windows repeated from smaller doc_ids."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
