"""Near-duplicate groups by SuperMinHash signatures, banding, full verification and union-find.

One pass over the texts gives each its shingle set's identity (128 bits), its
size and the hashes of its signature's bands. Equal sets are one node from then
on, so exact copies cost nothing more. Nodes that share a band hash are a
bucket. Every member is first compared with the bucket's smallest node, a number
of comparisons in proportion to the members; what this links is joined into
components. Only buckets that still hold several components go on: they are dealt
into blocks by set size and by whether a set is in the bucket's largest component,
and pairs of blocks are compared in tasks of bounded size. Two blocks meet only if
their sizes let them reach the threshold, and never two of the largest component,
whose sets are connected already; so neither a large group of copies nor a chain of
texts that share boilerplate makes a quadratic number of tasks, and no pair that a
bucket proposes is left out. Equal buckets are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import free_name, materialize, table
from .components import components
from .shingles import GAMMA, mix, shingle_set

SHINGLE_WORDS = 5
SLOTS = 288  # of a signature
MISS = 2e-5  # a pair at the threshold shares no band with at most this probability
BLOCK_SHINGLES = 200_000  # of a block, and of a bucket that is compared as a whole
CHUNK = 30_000  # shingles signed together
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (one row of m values per non-empty set).

    An element's j-th step draws a random value and the j-th entry of its own
    random permutation of the slots; the slot takes the smallest (step, value).
    The permutation entries of one element differ, which correlates the slots
    and lowers the variance against independent minima. A set stops after the
    step that has filled its last slot, as later steps are larger.
    """
    sizes = np.array([s.size for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * m, UNSET)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    permutation = None
    for j in range(m):
        drawn = mix(elements + np.uint64((j + 1) * int(GAMMA) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((drawn >> half) * np.uint64(m - j) >> half).astype(np.int64)
        if j == 0:
            slot = k
        else:
            slot = permutation[here, k]
            permutation[here, k] = permutation[here, j]
            permutation[here, j] = slot
        np.minimum.at(out, owner * m + slot, drawn & low | np.uint64(j) << half)
        open_sets = (out.reshape(-1, m) == UNSET).any(1)
        if not open_sets.any():
            break
        going = open_sets[owner]
        if j == 0:
            elements, owner, first = elements[going], owner[going], k[going]
            here = np.arange(elements.size)
            permutation = np.tile(np.arange(m, dtype=np.uint16), (elements.size, 1))
            permutation[here, first], permutation[:, 0] = 0, first
        elif going.mean() < 0.7:
            elements, owner, permutation = elements[going], owner[going], permutation[going]
            here = np.arange(elements.size)
    return out.reshape(-1, m)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GAMMA, (len(signatures), 1))
    for r in range(rows):
        acc = mix(acc ^ signatures.reshape(-1, bands, rows)[:, :, r])
    return acc.view(np.int64)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def set_identity(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows of a signature's slots: the most rows that keep to ``MISS`` at the threshold (36 of 8 at 85, 48 of 6 at 80)."""
    fits = (r for r in range(1, SLOTS + 1) if SLOTS % r == 0 and (1 - (percent / 100) ** r) ** (SLOTS // r) <= MISS)
    rows = max(fits, default=1)
    return SLOTS // rows, rows


def _sign(n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            while at < len(texts):
                sets, total, first = [], 0, at
                while at < len(texts) and total < CHUNK:
                    sets.append(shingle_set(texts[at].as_py(), SHINGLE_WORDS))
                    total += sets[-1].size
                    at += 1
                full = [s for s in sets if s.size]
                bands = iter(band_hashes(superminhash(full, n_bands * rows), n_bands, rows)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, at - first), pa.array([s.size for s in sets], pa.int64()),
                     pa.array([set_identity(s) if s.size else None for s in sets], pa.binary()),
                     pa.array([next(bands) if s.size else None for s in sets], pa.list_(pa.int64())), batch.column(2).slice(first, at - first)],
                    names=["doc_id", "n_shingles", "set_id", "bands", "text_hash"])

    return run


def link_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Root (smallest index) of each set's component under 100 * intersection >= percent * union; union-find."""
    n = len(sets)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([s.size for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")  # owners ascend inside a token
    tokens, owners = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    last = np.append(first[1:], tokens.size)
    length = last - first
    which = np.repeat(np.arange(first.size), length)
    # places of each shingle's posting, back in the order of the sets
    end = np.empty(tokens.size, np.int64)
    end[order] = last[which]
    place = np.empty(tokens.size, np.int64)
    place[order] = np.arange(tokens.size)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for d in range(n - 1):
        mine = slice(bounds[d], bounds[d + 1])
        begin, stop = place[mine] + 1, end[mine]  # only later sets
        count = stop - begin
        keep = count > 0
        if not keep.any():
            continue
        begin, count = begin[keep], count[keep]
        steps = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(owners[steps], minlength=n)
        for e in np.flatnonzero(100 * shared >= percent * (sizes[d] + sizes - shared)):
            if e > d:
                a, b = find(d), find(int(e))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _confirm(percent: int):
    """Links inside each task's sets: rows (task, set_id, shingles) ordered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}

        def solve() -> pa.RecordBatch:
            ids = sorted(held)
            roots = link_groups([held[i] for i in ids], percent) if len(ids) > 1 else ()
            found = [(ids[r], ids[i]) for i, r in enumerate(roots) if r != i]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for t, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if t != task:
                    yield solve()
                    task, held = t, {}
                held[node] = shingles.values.to_numpy().view(np.uint64)
        yield solve()

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingles) of texts whose set is the one looked for (another row can have the same key)."""
    for batch in batches:
        nodes, sets = [], []
        for node, set_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = shingle_set(text.as_py(), SHINGLE_WORDS)
            if set_identity(found) == set_id:
                nodes.append(node)
                sets.append(found.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _star_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of buckets' members to their bucket's smallest node, confirmed on full sets."""
    pairs = buckets.filter("hub <> node").select("hub", "node").distinct()
    one = sets.select("node", F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("y"))
    both = pairs.join(one, "node").join(other, "hub")
    possible = both.filter(100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y")))
    shared = F.size(F.array_intersect("x", "y"))
    return possible.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _rest_links(buckets: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside the buckets that still hold several."""
    rooted = buckets.join(roots.withColumnRenamed("root", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    # equal buckets (by their members and these members' components) are one
    print_ = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print")
    open_ = rooted.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("members"), print_).filter("low < high")
    open_ = open_.groupBy("print", "members").agg(F.min("band").alias("band")).select("band")
    rows = materialize(rooted.join(open_, "band").join(sets.select("node", F.size("shingles").alias("n")), "node"), "open-buckets")

    main = rows.groupBy("band", "c").agg(F.count(F.lit(1)).alias("size")).groupBy("band").agg(F.max_by("c", F.struct("size", "c")).alias("main"))
    # sets that can reach the threshold are in one size class or in neighbouring ones
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    kinds = rows.join(main, "band").select("band", "node", "n", (F.col("c") == F.col("main")).alias("in_main"), F.floor(F.log("n") / width).alias("size_class"))
    blocks = kinds.groupBy("band", "in_main", "size_class").agg(F.sum("n").alias("total"))
    blocks = blocks.withColumn("blocks", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int"))
    shape = blocks.groupBy("band").agg(F.sum("total").alias("all"), F.collect_list(F.struct("in_main", "size_class", "blocks")).alias("shape"))  # two entries a size class
    dealt = kinds.join(shape, "band").join(blocks.select("band", "in_main", "size_class", "blocks"), ["band", "in_main", "size_class"])
    dealt = dealt.withColumn("own", F.struct("in_main", "size_class", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    near = F.filter("shape", lambda s: (F.abs(s["size_class"] - F.col("size_class")) <= 1) & ~(s["in_main"] & F.col("in_main")))
    others = F.flatten(F.transform(near, lambda s: F.transform(
        F.sequence(F.lit(0), s["blocks"] - 1), lambda b: F.struct(s["in_main"].alias("in_main"), s["size_class"].alias("size_class"), b.alias("block")))))
    tasks = F.when(F.col("all") <= BLOCK_SHINGLES, F.array(F.xxhash64("band"))).otherwise(
        F.transform(others, lambda o: F.xxhash64("band", F.least(o, F.col("own")), F.greatest(o, F.col("own")))))
    asked = dealt.select("node", F.explode(tasks).alias("task"))
    full = asked.join(sets, "node").select("task", "node", "shingles").repartition("task").sortWithinPartitions("task")
    return full.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept, class_id, text_hash), one per row of ``docs``.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    5-word shingles (all words, if fewer). Texts without words and null texts
    are linked with nothing. ``component_id`` is the smallest key reachable;
    rows of one key with different texts are separate texts. ``class_id`` names the
    class by one of its sets (null: no words). Only ``key`` and
    ``text`` are read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    signed = materialize(
        docs.mapInArrow(_sign(*bands_for(percent)), "doc_id long, n_shingles long, set_id binary, bands array<long>, text_hash long"), "signed")
    node = F.when(F.col("set_id").isNotNull(), F.xxhash64("set_id"))  # 64 of the 128 bits name a set from here on
    named = signed.withColumn("node", node)
    nodes = named.filter("node is not null")

    members = nodes.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub <> other").select("band", "hub")
    hubs = materialize(hubs, "hubs")  # written, so that the join reads two plain exchanges and a frequent band can be split
    buckets = materialize(members.join(hubs, "band").select("band", "hub", "node"), "buckets")

    distinct = materialize(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("set_id").alias("set_id")), "distinct-sets")
    wanted = distinct.join(buckets.select("node").distinct(), "node").select("node", "set_id", F.col("doc_id").alias("of_doc"))
    # always a merge join: the side without texts is a share of the documents, at no size a broadcast
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("node", "set_id", "text")
    sets = materialize(texts.mapInArrow(_shingles, "node long, shingles array<long>").dropDuplicates(["node"]), "candidate-sets")

    roots = materialize(components(_star_links(buckets, sets, percent)), "star-roots")
    rest = _rest_links(buckets, sets, roots, percent)
    for end in ("a", "b"):  # from sets to the components they are in already
        known = roots.select(F.col("node").alias(end), F.col("root").alias("known"))
        rest = rest.join(known, end, "left").withColumn(end, F.coalesce("known", end)).drop("known")
    further = components(rest).select(F.col("node").alias("root"), F.col("root").alias("further"))
    rooted = distinct.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted.join(further, "root", "left").select("node", "doc_id", F.coalesce("further", "root").alias("class_id")), "rooted")
    smallest = rooted.groupBy("class_id").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.join(smallest, "class_id").select("node", "component_id", "class_id")
    out = named.join(classes, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
                      "class_id", "text_hash")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate class, and all rows without words.

    Of a class the row with the smallest key stays; of repeated rows with that
    key the first by the other columns. Columns are unchanged.
    """
    names = [free_name(docs.columns, x) for x in ("keep_key", "keep_hash", "keep_words", "text_hash_", "row_rank")]
    keep_key, keep_hash, keep_words, hashed, rank = names
    found = near_duplicates(docs, key, text, percent).filter("kept")
    # a class can hold several texts with the smallest key; the smallest text hash decides
    first = W.partitionBy("doc_id", "class_id").orderBy("text_hash")
    winners = found.withColumn("place", F.row_number().over(first)).filter("place = 1 or class_id is null")
    winners = winners.select(F.col("doc_id").alias(keep_key), F.col("text_hash").alias(keep_hash), F.col("class_id").isNotNull().alias(keep_words)).distinct()
    here = docs.withColumn(hashed, text_hash(F.col(text)))
    joined = here.join(winners, F.col(key).eqNullSafe(F.col(keep_key)) & (F.col(hashed) == F.col(keep_hash)))
    others = [F.col(c) for c, kind in docs.dtypes if c not in (key, text) and not kind.startswith("map")]
    again = W.partitionBy(key, hashed).orderBy(*(others or [F.col(hashed)]))
    return joined.withColumn(rank, F.row_number().over(again)).filter((F.col(rank) == 1) | ~F.col(keep_words)).select(*docs.columns)


def op8_superminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at similarity 0.85.

    One row per row; repeated rows are one class and are all ``kept`` if theirs
    is its smallest key. Null and empty texts are classes of their own.
    """
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
