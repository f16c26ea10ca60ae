"""Best-fit packing by minimum bin slack, on the histogram of lengths.

Pieces of equal length are interchangeable, so the packing is decided on the
histogram alone, which has at most ``capacity`` rows however large the corpus
is. For one bin a bitset subset-sum dynamic programme over the lengths still
available (with their multiplicities) finds the fullest feasible combination;
it is removed as often as the counts allow, which uses up at least one length,
so there are at most ``capacity`` programmes. Each piece then takes its place
by its rank among the pieces of its length, counted without gathering a length
in one task: ranks inside hash buckets plus prefix sums of the buckets' counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import free_name, materialize, shuffle_partitions, table
from .tokens import CACHE_WORDS, encoder, tokenizer_path

CAPACITY = 4096
BATCH_TEXTS = 1024  # encoded in one call
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``capacity``.

    The longest length is always taken (each must go somewhere, and long ones
    are hardest to place), the rest fills the remaining room. Among equal sums
    longer lengths are preferred. Returns {length: how many}.
    """
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    chosen = {first: 1}
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length] - (length == first), room // length), 1
        while left > 0:  # multiplicities by powers of two
            take = min(size, left)
            grown = (reach | reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns as (first sequence number, repetitions, {length: how many per bin})."""
    left, plan, at = {k: v for k, v in counts.items() if 0 < k <= capacity and v > 0}, [], 0
    while left:
        pattern = fullest(left, capacity)
        times = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        plan.append((at, times, pattern))
        at += times
    return plan


def _slots(plan: list[tuple[int, int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, how many per bin, offset in the bin)."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    for first, times, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.setdefault(length, []).append((used.get(length, 0), first, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def rank_in_group(df: DataFrame, group: str, order: list[str], rank: str) -> DataFrame:
    """Add each row's 0-based rank among rows of equal ``group``, spreading a hot group over hash buckets."""
    buckets = shuffle_partitions(df.sparkSession)
    bucket, inside, before = (free_name([*df.columns, rank], x) for x in ("hash_bucket", "rank_inside", "rank_before"))
    salted = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    ranked = salted.withColumn(inside, F.row_number().over(W.partitionBy(group, bucket).orderBy(*order)) - 1)
    earlier = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = salted.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("rows_in"))
    starts = totals.select(group, bucket, F.coalesce(F.sum("rows_in").over(earlier), F.lit(0)).alias(before))
    joined = ranked.join(starts, [group, bucket])
    return joined.select(*df.columns, (F.col(inside) + F.col(before)).alias(rank))


def pack(pieces: DataFrame, length: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to rows with a positive integer ``length`` up to ``capacity``.

    ``order`` names columns that tell rows apart (rows equal in them are
    interchangeable). Columns named like the results are replaced. Every row keeps a place of its own, repeated ones too; an
    empty table gives an empty result. Longer rows must be cut before.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count(F.lit(1))).collect()}  # at most ``capacity`` rows
    if any(k is None or not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots = _slots(plan_bins(counts, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(slots)  # bounded by capacity patterns of at most capacity lengths

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        seq, off = np.empty_like(n), np.empty_like(n)
        order_ = np.argsort(n, kind="stable")
        for part in np.split(order_, np.flatnonzero(np.diff(n[order_])) + 1):
            if part.size:
                rows = shared.value[int(n[part[0]])]
                row = rows[np.searchsorted(rows[:, 0], r[part], side="right") - 1]
                k = r[part] - row[:, 0]
                seq[part] = row[:, 1] + k // row[:, 2]
                off[part] = row[:, 3] + k % row[:, 2] * n[part]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    rank = free_name(pieces.columns, "rank_in_length")
    spot = free_name([*pieces.columns, rank], "place")
    ranked = rank_in_group(pieces, length, order, rank).withColumn(spot, place(length, rank))
    return ranked.select(*pieces.columns, f"{spot}.sequence_id", f"{spot}.offset")


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of every document's ids (then ``end_id``), cut only beyond ``capacity``; null text is empty.

    ``cache_words`` bounds what a worker remembers of encoded words.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, cache_words=cache_words), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for first in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(first, BATCH_TEXTS)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        for col, v in zip(out, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def op1_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens; null text is the end id alone."""
    pieces = materialize(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")), "pieces")
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"])
