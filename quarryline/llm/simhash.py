"""SimHash near copies by anchor-point covering.

A fingerprint's 64 bits are cut into three segments.  Of two fingerprints with at
most four differing bits, some segment differs in at most one.  In each segment a
covering code gives the anchors: the Hamming code on 15 bits times all words on
the rest, so every value lies within 1 (the covering radius) of an anchor.  A
fingerprint has its home at its nearest anchor and is replicated to every anchor
within radius plus threshold, 2; near pairs therefore meet at a home, where all 64
bits are compared.

Equal fingerprints are one class from the start, so a group of exact copies of any
size is one row.  An anchor's homes beyond ``HOT_HOMES`` are split and its visitors
go to each part.  Tasks take links together as they find them and give a star for
each local component, never all pairs.

Defined results: a null text or one without words has fingerprint zero, linked like
any other; texts of fewer words than a shingle have one shingle, all their words; a
null doc_id keeps its row and is never a component's id unless all are null;
repeated rows are rows of one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .components import components, told, with_lowest
from .words import _UPPER_TO_LOWER

SEGMENTS = ((0, 22), (22, 21), (43, 21))
HAMMING = 15
THRESHOLD = 4
HOT_HOMES = 50_000
PAIRS_AT_ONCE = 1 << 21


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 hashes (seed 42) of a UTF-8 text's lower-cased shingles, repeats included."""
    import xxhash

    words = (text or b"").translate(_UPPER_TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    of = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([of(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([of(line[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a text's shingles: the bits set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return reduce(lambda v, i: v | 1 << int(i), np.flatnonzero(2 * counts > len(hashes)), 0)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every text, ``width`` words a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            made = np.fromiter((fingerprint(shingles(t.as_py(), width)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the low 15 bits: the exclusive or of the numbers of set bits."""
    out = np.zeros(len(values), np.uint64)
    for i in range(HAMMING):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def _errors(size: int, reach: int = 2) -> list[np.ndarray]:
    """For each syndrome, what to flip to come to an anchor within ``reach``."""
    by: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    flips = [0, *(1 << i for i in range(size)), *(1 << i | 1 << j for i in range(size) for j in range(i))]
    for e, s in zip(flips, _syndromes(np.array(flips, np.uint64)), strict=True):
        if bin(e).count("1") <= reach:
            by[int(s)].append(e)
    return [np.array(x, np.uint64) for x in by]


def _replicated(fps: DataFrame) -> DataFrame:
    """``anchor, home, fp``: each fingerprint at its home and at every anchor in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fp), 20_000):
                fp = all_fp[at : at + 20_000]
                for k, (shift, size) in enumerate(SEGMENTS):
                    v = (fp >> np.uint64(shift)) & np.uint64((1 << size) - 1)
                    s = _syndromes(v)
                    for syndrome, flips in enumerate(_errors(size)):
                        rows = np.flatnonzero(s == syndrome)
                        if not len(rows):
                            continue
                        near = np.uint64(1 << syndrome - 1 if syndrome else 0)
                        anchors = (v[rows, None] ^ flips[None, :]) | np.uint64(k << 24)
                        home = np.broadcast_to(flips == near, anchors.shape)
                        fps_ = np.broadcast_to(fp[rows, None], anchors.shape)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchors.ravel().astype(np.int32)), pa.array(home.ravel().astype(bool)), pa.array(fps_.ravel().view(np.int64))],
                            names=["anchor", "home", "fp"],
                        )

    return fps.mapInArrow(run, "anchor int, home boolean, fp long")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each node's component, for links a-b among n nodes."""
    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = lo != hi
        a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    return root


def _compare(limit: int):
    def stars(key: np.ndarray, home: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        """Compare homes with visitors of each key; rows are sorted by key, homes first."""
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        homes = np.add.reduceat(home.astype(np.int64), starts)
        nodes, node = np.unique(fp, return_inverse=True)
        root = np.arange(len(nodes))
        row_group = np.repeat(np.arange(len(starts)), ends - starts)
        wants = homes[row_group]  # each row meets all homes of its key
        upto = np.cumsum(wants)
        at = 0
        while at < len(key):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            rows = np.arange(at, stop)
            n = wants[rows]
            left = np.repeat(rows, n)
            first = np.repeat(starts[row_group[rows]] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            right = np.arange(len(left)) + first
            a, b = node[left], node[right]
            near = (a != b) & (np.bitwise_count(fp[left] ^ fp[right]) <= limit)
            a, b = root[a[near]], root[b[near]]
            root = _roots(a, b, len(nodes))[root]
            at = stop
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        if not len(moved):
            return None
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[moved]].view(np.int64)), pa.array(nodes[moved].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            part = (
                batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int64) << 32 | batch.column("shard").to_numpy(zero_copy_only=False),
                batch.column("home").to_numpy(zero_copy_only=False),
                batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64),
            )
            if not len(part[0]):
                continue
            kept.append(part)
            key = part[0]
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut == 0 and (len(kept) == 1 or kept[-2][0][-1] == key[0]):
                continue
            whole = [np.concatenate([p[i] for p in kept]) for i in range(3)]
            done = len(whole[0]) - (len(key) - cut)
            if out := stars(*(w[:done] for w in whole)):
                yield out
            kept = [tuple(w[done:] for w in whole)]
        if kept and (out := stars(*(np.concatenate([p[i] for p in kept]) for i in range(3)))):
            yield out

    return run


def near_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``a, b``: links that join the same fingerprints as all pairs within ``threshold`` bits."""
    if threshold > THRESHOLD:
        raise ValueError(f"three segments find pairs of up to {THRESHOLD} differing bits")
    sent = _replicated(fps)
    homes = _replicated(fps).where("home").groupBy("anchor").count().where(F.col("count") > HOT_HOMES)
    hot = homes.select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / HOT_HOMES).cast("int").alias("shards"))
    hot = settled(hot, "hot-anchors")
    if hot.isEmpty():
        sent = sent.withColumn("shard", F.lit(0))
    else:
        sent = sent.join(hot, F.col("anchor") == F.col("hot"), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
        sent = sent.withColumn("shard", F.explode(F.when(F.col("home"), own).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))))
        both = sent.where("home AND shards > 1").withColumn("home", F.lit(False))  # homes visit the other parts too
        others = both.select("anchor", "home", "fp", F.explode(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda i: i != F.col("shard"))).alias("shard"))
        sent = sent.select("anchor", "home", "fp", "shard").unionByName(others)
    sent = sent.select("anchor", "shard", "home", "fp").repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", F.col("home").desc())
    return sent.mapInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: fingerprint as 16 hex digits,
    component_id the smallest doc_id reachable over links, its own included.
    """
    fps = settled(fingerprints(docs, width), "fingerprints")
    classes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = settled(near_links(classes.select("fp"), threshold), "near")
    linked = classes.join(components(links), F.col("fp") == F.col("node"))
    linked = with_lowest(linked.select("fp", "least", "root"), "root", "fp", "least", "component_id")
    named = classes.join(linked.select(F.col("fp").alias("of"), "component_id"), F.col("fp") == F.col("of"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return told(fps, named, "fp", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_near_duplicates(spark, sf_dir):
    """Near copies among all documents: four-word shingles, links at four bits or fewer."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
