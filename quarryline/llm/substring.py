"""Substring dedup over the De Bruijn graph of word windows.

A window of ``width`` words is an edge of the graph, from its first words to its
last.  Edges found in more than one document are repeated; each of their
occurrences gets a source coordinate, a place in a document with a smaller id.
Occurrences that follow one another in a document while their sources do so too are
an unbranched path and compact into one span.  The words of each span are then held
against the words at its source coordinate; a document loses the words that spans
with a smaller source cover.

Edges travel as hashes, packed by a task for each bucket of hashes.  Of an edge's
occurrences in one batch of documents only those in the smallest document travel:
the others already have their source, so a passage in a third of all documents
sends one edge a batch, not one a document.  If the check against the words finds
a hash shared by different windows, everything is redone under another seed.

Defined results: a null text has no words; documents shorter than a window keep all;
a null doc_id keeps all its words and is nobody's source; different texts under one
doc_id are numbered, each has its own spans, and none is the other's source; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled
from .words import owners, planes, release, rolling, slices, split_words, unplaned, window_starts

WIDTH = 13
STORED = 7  # bytes of a hash that travel; its bucket tells more
BATCH_BYTES = 8 << 20
SEEDS = 8


def _hashed(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(len(h), 8)[:, :STORED].tobytes()


def _unhashed(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // STORED, 8), np.uint8)
    out[:, :STORED] = np.frombuffer(data, np.uint8).reshape(-1, STORED)
    return out.view(np.uint64).ravel()


def _sources(h: np.ndarray, doc: np.ndarray, var: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each occurrence, the smallest document with its hash, the first of its texts
    that has it, and its first place there."""
    if not len(h):
        return doc, var, pos
    order = np.argsort(h, kind="stable")
    s = h[order]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    sizes = np.diff(np.append(starts, len(s)))
    out, there = [], np.ones(len(s), bool)
    for column in (doc, var, pos):
        value = np.where(there, column[order], np.iinfo(column.dtype).max)
        least = np.repeat(np.minimum.reduceat(value, starts), sizes)
        there &= value == least
        back = np.empty_like(column)
        back[order] = least
        out.append(back)
    return tuple(out)


def _edges(docs: DataFrame, width: int, bits: int, seed: int) -> DataFrame:
    """``bucket, hashes, docs, vars, places``: a batch's edges packed by bucket; and, with null
    hashes, occurrences whose source is in the batch (docs, vars, places, then sources).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", BATCH_BYTES)):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            nth = batch.column("_var").to_numpy(zero_copy_only=False)
            offsets, codes, dictionary = split_words(batch.column("text"))
            at = window_starts(offsets, width)
            if not len(at):
                continue
            of = xxhash.xxh64_intdigest
            named = np.fromiter((of(w.as_buffer(), seed) for w in dictionary), np.uint64, len(dictionary))
            h = rolling(named[codes], width)[at]
            row = owners(offsets)[at]
            pos = (at - offsets[row]).astype(np.int32)
            doc = ids[row].astype(np.int64)
            var = nth[row].astype(np.int32)
            source, of_source, q = _sources(h, doc, var, pos)
            local = source < doc
            out: dict[str, list] = {"bucket": [], "hashes": [], "docs": [], "vars": [], "places": [], "sources": [], "source_vars": [], "source_places": []}

            def add(bucket, hashes, doc, var, pos, source=None, of_source=None, q=None, out=out):
                out["bucket"].append(int(bucket))
                out["hashes"].append(hashes)
                out["docs"].append(planes(np.diff(doc, prepend=0)))
                out["vars"].append(planes(var) if var.any() else None)  # null: all 0
                out["places"].append(planes(pos))
                out["sources"].append(None if source is None else planes(np.diff(source, prepend=0)))
                out["source_vars"].append(planes(of_source) if of_source is not None and of_source.any() else None)
                out["source_places"].append(None if q is None else planes(q))

            if local.any():
                add(of(np.int64(doc[0]).tobytes(), seed) & ((1 << bits) - 1), None, doc[local], var[local], pos[local], source[local], of_source[local], q[local])
            far = ~local
            h, doc, var, pos = h[far], doc[far], var[far], pos[far]
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=1 << bits))
            for b, (lo, hi) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
                if hi > lo:
                    k = order[lo:hi]
                    add(b, _hashed(np.ascontiguousarray(h[k])), doc[k], var[k], pos[k])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in list(out)[1:])]))

        release()

    rows = docs.where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "bucket int, hashes binary, docs binary, vars binary, places binary, sources binary, source_vars binary, source_places binary")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences with a smaller source, from packed edges sorted by bucket."""

    def rows(*columns):
        for at in range(0, len(columns[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in columns], names=["doc", "var", "pos", "source", "source_var", "q"])

    def numbers(data: bytes | None, n: int) -> np.ndarray:
        return np.zeros(n, np.int32) if data is None else unplaned(data, np.int32)

    held: list[tuple] = []
    bucket = None

    def settle():
        h, doc, var, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        found = _sources(h, doc, var, pos)
        lost = found[0] < doc
        yield from rows(*(c[lost] for c in (doc, var, pos, *found)))

    for batch in batches:
        for row in batch.to_pylist():
            doc, pos = np.cumsum(unplaned(row["docs"], np.int64)), unplaned(row["places"], np.int32)
            if row["hashes"] is None:
                source, n = np.cumsum(unplaned(row["sources"], np.int64)), len(doc)
                yield from rows(doc, numbers(row["vars"], n), pos, source, numbers(row["source_vars"], n), unplaned(row["source_places"], np.int32))
                continue
            if bucket != row["bucket"] and held:
                yield from settle()
                held = []
            bucket = row["bucket"]
            held.append((_unhashed(row["hashes"]), doc, numbers(row["vars"], len(doc)), pos))
    if held:
        yield from settle()
    release()


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` and ``_var``, the number of a row's text where its doc_id has several."""
    text = F.xxhash64("text")
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b")
    several = settled(several.select(F.col("doc_id").alias("_of")), "several-texts")
    if several.isEmpty():
        return docs.withColumn("_var", F.lit(0))
    texts = docs.join(several, F.col("doc_id") == F.col("_of"), "left_semi").select(F.col("doc_id").alias("_of"), text.alias("_text")).distinct()
    texts = settled(texts.withColumn("_var", F.row_number().over(Window.partitionBy("_of").orderBy("_text"))), "numbered")
    met = docs.join(texts, (F.col("doc_id") == F.col("_of")) & (text == F.col("_text")), "left")
    return met.withColumn("_var", F.coalesce("_var", F.lit(0))).drop("_of", "_text")


def repeated_spans(docs: DataFrame, width: int = WIDTH, seed: int = 0) -> DataFrame:
    """``doc, var, start, windows, source, source_var, source_start``: compacted paths of
    repeated windows in the texts of ``docs`` (doc_id, _var, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(8, (4 * parts - 1).bit_length())
    packed = _edges(docs, width, bits, seed).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = packed.mapInArrow(_resolve, "doc long, var int, pos int, source long, source_var int, q int")
    path = ["doc", "var", "source", "source_var", F.col("pos") - F.col("q")]
    nth = F.dense_rank().over(Window.partitionBy(*path).orderBy("pos"))  # repeated rows share their places
    runs = found.select("doc", "var", "pos", "source", "source_var", "q", (F.col("pos") - nth).alias("run"))
    spans = runs.groupBy("doc", "var", "source", "source_var", (F.col("pos") - F.col("q")).alias("shift"), "run")
    spans = spans.agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("windows"), F.min("q").alias("source_start"))
    return spans.select("doc", "var", "start", "windows", "source", "source_var", "source_start")


def _squeezed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the way to their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else zip_.compress(t) for t in batch.column(at).cast(pa.large_binary()).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()))

    schema = ", ".join(f"`{n}` {'binary' if n == 'text' else t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, schema)


def _applied(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                text_at, spans_at = (batch.schema.get_field_index(c) for c in ("text", "spans"))
                texts, n_words, n_removed, shas, checks = [], [], [], [], []
                for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                    raw = unzip.decompress(text) if text is not None else b""
                    words = raw.split()
                    n = len(words)
                    gone, own = [], []
                    for span in spans or ():
                        start, last = span["start"], span["start"] + span["windows"] + width - 1
                        if last > n:
                            continue
                        digest = hashlib.blake2b(b" ".join(words[start:last]), digest_size=16).digest()
                        own.append({k: span[k] for k in ("source", "source_var", "source_start", "windows")} | {"digest": digest})
                        if span["lost"]:
                            gone.append((start, last))
                    if gone:
                        off = np.zeros(n + 1, np.int64)
                        for a, b in gone:
                            off[a] += 1
                            off[b] -= 1
                        keep = np.cumsum(off[:n]) == 0
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    line = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    shas.append(hashlib.sha256(line).hexdigest())
                    checks.append(own)
                    if keep_text:
                        texts.append(None if text is None else (line if gone else raw).decode("utf-8", "surrogatepass"))
                out = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "spans", "_var")}
                if keep_text:
                    out["text"] = pa.array(texts, pa.string())
                kind = pa.list_(pa.struct([("source", pa.int64()), ("source_var", pa.int32()), ("source_start", pa.int32()), ("windows", pa.int32()), ("digest", pa.binary())]))
                out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "checks": pa.array(checks, kind)}
                yield pa.RecordBatch.from_pydict(out)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = False, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``others`` and ``n_words, n_removed, kept_sha256`` of every row.

    With ``keep_text`` also ``text``: unchanged where nothing was removed, else the
    kept words joined by one space.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    kinds = dict(docs.dtypes)
    docs = _numbered(docs)
    for seed in range(SEEDS):
        spans = settled(repeated_spans(docs.select("doc_id", "_var", "text"), width, seed), "spans")
        span = ["windows", "source", "source_var", "source_start"]
        lost = spans.select("doc", "var", F.struct("start", *span, F.lit(True).alias("lost")).alias("span"))
        asked = spans.select(*span).distinct()
        asked = asked.select(F.col("source").alias("doc"), F.col("source_var").alias("var"), F.struct(F.col("source_start").alias("start"), *span, F.lit(False).alias("lost")).alias("span"))
        by_doc = lost.unionByName(asked).groupBy("doc", "var").agg(F.collect_list("span").alias("spans"))
        met = _squeezed(docs).join(by_doc, (F.col("doc_id") == F.col("doc")) & (F.col("_var") == F.col("var")), "left").drop("doc", "var")
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *others, *(["text"] if keep_text else [])])
        schema += ", n_words long, n_removed long, kept_sha256 string, checks array<struct<source:bigint,source_var:int,source_start:int,windows:int,digest:binary>>"
        done = settled(met.mapInArrow(_applied(width, keep_text), schema), "kept")
        check = done.select(F.explode("checks").alias("c")).groupBy("c.source", "c.source_var", "c.source_start", "c.windows")
        if check.agg(F.min("c.digest").alias("a"), F.max("c.digest").alias("b")).where("a <> b").isEmpty():
            return done.drop("checks")
    raise RuntimeError(f"spans differ from the words at their sources under each of {SEEDS} seeds")


def op8_substring_dedup(spark, sf_dir):
    """Words of every document that repeat a 13-word window of a smaller doc_id."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
