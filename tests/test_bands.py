"""Banded operators against plain loops, with bands so narrow that runs cross many of them."""

import math
import random
import statistics

import pytest

from genoweave.operators import histogram as hs, indexes as ix


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(4)
    rows = []
    for g in ("a", "b", None):
        at = 0
        for _ in range(150):
            at += rng.choice([0, 1, 3, 40, 700])
            rows.append((g, at, at + rng.choice([0, 2, 30, 400])))
    return rows + rows[:7]  # repeated rows too


def groups(rows):
    return {g: sorted(r[1:] for r in rows if r[0] == g) for g in {r[0] for r in rows}}


@pytest.mark.parametrize("band", [5, 64, 1 << 32])
def test_chunks_and_blocks(spark, spans, band):
    df = spark.createDataFrame(spans, "g string, start long, end long").repartition(3)
    chunks, blocks = [], []
    for g, rows in groups(spans).items():
        run, last, reach, block = None, None, None, None
        for s, e in rows:
            if last is None or (s >> 4) - (last >> 4) > 1:
                run = [g, s, e, 0]
                chunks.append(run)
            run[2], run[3], last = max(run[2], e), run[3] + 1, e
            if reach is None or s - reach >= 20:
                block = [g, s, e]
                blocks.append(block)
            block[2] = max(block[2], e)
            reach = e if reach is None else max(reach, e)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = ix.coalesce_chunks(df, ["g"], 4, band).select("g", "start", "end", "chunks").collect()
    assert order(got) == order(chunks)
    assert order(ix.consolidate_blocks(df, ["g"], 20, band).select("g", "start", "end").collect()) == order(blocks)


@pytest.mark.parametrize("band", [3, 50, 1 << 20])
def test_order_and_lengths(spark, band):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), i, rng.choice(["x", "y"]), rng.randrange(500), rng.randrange(90)) for i in range(0, 900, 3)]
    df = spark.createDataFrame([(*r[:4], r[3] + r[4]) for r in rows], "g string, ord long, contig string, start long, end long").repartition(3)
    back, stats = [], {}
    for g in ("a", None):
        prev, seen, longest, lengths = None, 0, 0, []
        for _, o, c, s, extra in [r for r in rows if r[0] == g]:
            if prev and prev[0] == c and prev[1] > s:
                back.append(o)
            seen += s - prev[1] if prev and s >= prev[1] else s
            longest = max(longest, extra + 1)
            lengths.append(longest)
            prev = (c, s)
        stats[g] = (len(lengths), seen, longest, statistics.mean(lengths), statistics.stdev(lengths))
    found = ix.out_of_order(df, "ord", "contig", "start", ["g"], band)
    assert found.columns == df.columns and sorted(r.ord for r in found.collect()) == sorted(back)
    got = {r[0]: tuple(r)[1:] for r in ix.length_statistics(df, ["g"], ["ord"], band).collect()}
    assert got.keys() == stats.keys()
    for g in got:
        assert got[g] == pytest.approx(stats[g])


@pytest.mark.parametrize("near", [1 / 2000, 0.2, 0.0])
def test_percentiles(spark, monkeypatch, near):
    monkeypatch.setattr(hs, "NEAR", near)
    monkeypatch.setattr(hs, "ACCURACY", 2)  # a poor bracket must not matter
    rng = random.Random(8)
    data = {"ties": [float(rng.randrange(4)) for _ in range(300)], "one": [2.5], "two": [1.0, 4.0], "tail": [math.exp(20 * rng.random()) for _ in range(500)], None: [rng.gauss(0, 1) for _ in range(77)]}
    rows = [(g, x) for g, xs in data.items() for x in xs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for p in (0.01, 0.3, 0.5, 0.999):
        legacy, nearest = {}, {}
        for g, xs in data.items():
            xs, n, at = sorted(xs), len(xs), p * (len(xs) + 1)
            i = math.floor(at)
            legacy[g] = xs[0] if at < 1 else xs[-1] if at >= n else xs[i - 1] + (at - i) * (xs[i] - xs[i - 1])
            nearest[g] = xs[max(1, math.ceil(p * n)) - 1]
        got = {r.grp: r.percentile for r in hs.list_percentile(df, "g", "v", p).collect()}
        assert got.keys() == legacy.keys() and all(got[g] == pytest.approx(legacy[g], rel=1e-12) for g in got)
        assert {r.grp: r.percentile for r in hs.list_percentile(df, "g", "v", p, "r1").collect()} == nearest
