"""Language-model scores of whole texts by a causal self-attention model on subword ids.

Texts are lower-cased (A-Z) and cut into words; each word is a run of subword ids of
a public tokenizer, each text closes with one end id.  The model (``attention``) gives
every subword id a probability after those before it, which sum to 1 over all ids;
overlapping windows score every place once, and ``score`` is the sum of log10 over a
text's places, its end included.  ``base_score`` is the smoothed word unigram's.

Everything learned comes from all training texts, which are those whose
crc32(doc_id) mod 10 isn't 0: word and subword counts are exact and corpus-wide, and
the attention weights are averaged over all tasks, each of which trains on the texts of
every batch it holds (local SGD): a round takes one of as many random parts of them as
there are rounds, so together they take every window of every training text once,
however the corpus is dealt out.
The weights, and with them ``score``, depend on how the stored rows lie in tasks; the
same files in the same session settings give the same scores.

A task keeps a batch's texts as codes into the batch's own words; words travel to
their hash bucket once a batch, and their counts travel back.

Defined results: a null text is an empty one, its only token the end; a null doc_id
is scored, learned from and not held out; repeated rows are scored and counted each;
without training texts all counts are 0 and the model is its untrained start; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import settled
from .words import pack, planes, release, roomy, slices, split_words, unpack, unplaned

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
RATES = (0.02, 0.01, 0.005)
"""Adam's rate in each round; there are as many rounds, and as many parts of the texts."""
BATCH_BYTES = 8 << 20
SMOOTH = 0.1
CHUNKS, LANES = 8, 4  # weights travel in chunks; a chunk is summed in this many lanes
LN10 = float(np.log(10))
_BATCH = "batch long, bucket int, words binary, counts binary, pack binary, subs binary, n_train long"


@lru_cache(maxsize=2)
def _tokenizer(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("words", pat_str=r" ?[^ ]+", mergeable_ranks=table, special_tokens={}), len(table)


def _subwords(ranks: bytes, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words laid end to end, and each word's number of them: a word's first
    subword alone begins with the space before it, so all are cut in one call."""
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    tokenizer, _ = _tokenizer(ranks)
    flat = tokenizer.encode_to_numpy(" " + " ".join(words), disallowed_special=())
    firsts = np.flatnonzero(_begins(ranks)[flat])
    return flat.astype(np.uint16), np.diff(firsts, append=len(flat))


@lru_cache(maxsize=2)
def _begins(ranks: bytes) -> np.ndarray:
    """Which ids begin with a space."""
    tokenizer, end = _tokenizer(ranks)
    return np.array([tokenizer.decode_single_token_bytes(i)[:1] == b" " for i in range(end)], bool)


@lru_cache(maxsize=2)
def subword_clusters(ranks: bytes) -> np.ndarray:
    """Each id's cluster: does it begin a word, and its first letter; the end id is last."""
    out = []
    for a in sorted((map(bytes.split, ranks.splitlines())), key=lambda x: int(x[1])):
        token = base64.b64decode(a[0])
        begins, letter = token[:1] == b" ", token.lstrip(b" ")[:1].lower()
        group = (letter[0] - 97) // 2 if letter.isalpha() and letter < b"{" else 13 if letter.isdigit() else 14
        out.append(15 * begins + group)
    return np.array([*out, 30], np.int64)


def _held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids], bool)


_PACKED = [np.int64, np.uint8, np.int32, np.int32, np.uint8, np.uint16]
"""doc ids, flags (1 held out, 2 null id), words per text, word codes, subwords per word, subword ids"""


def _batches(docs: DataFrame, ranks: bytes, bits: int) -> DataFrame:
    """Rows of three kinds for each batch: words by bucket, the coded texts, subword counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy()
        _, end = _tokenizer(ranks)
        zip_ = zstandard.ZstdCompressor(level=1)
        nth = 0
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                name = (TaskContext.get().partitionId() << 32) + nth
                nth += 1
                ids = batch.column("doc_id").to_pylist()
                held = _held_out(ids)
                offsets, codes, dictionary = split_words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
                words = dictionary.to_numpy(zero_copy_only=False)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                codes, bucket = back[codes], bucket[order]
                words = words[order].tolist()
                flat, n_subs = _subwords(ranks, words)
                learn = np.repeat(~held, np.diff(offsets))
                counts = np.bincount(codes[learn], minlength=len(words)).astype(np.int64)
                seen_n = np.bincount(flat, np.repeat(counts, n_subs), end + 1).astype(np.int64)
                seen_n[end] = int((~held).sum())
                seen = np.flatnonzero(seen_n)
                rows = {c.split()[0]: [] for c in _BATCH.split(", ")}

                def add(rows=rows, name=name, **row):
                    for c, values in rows.items():
                        values.append(row.get(c, name if c == "batch" else None))

                long = n_subs > 255  # a very long word: its subwords are counted apart
                edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(0, np.int64)
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    blob = zip_.compress("\n".join(words[lo:hi]).encode())
                    add(bucket=int(bucket[lo]), words=blob, counts=planes(counts[lo:hi]))
                flags = held.astype(np.uint8) + 2 * np.array([i is None for i in ids], np.uint8)
                packed = pack(
                    ids=np.array([i or 0 for i in ids], np.int64), flags=flags, lengths=np.diff(offsets).astype(np.int32), codes=codes.astype(np.int32),
                    n_subs=np.where(long, 0, n_subs).astype(np.uint8), subs=flat,
                )
                packed += pack(long=np.flatnonzero(long).astype(np.int64), sizes=n_subs[long].astype(np.int64))
                add(pack=packed, subs=pack(at=seen, n=seen_n[seen]), n_train=int((~held).sum()))
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "counts", "pack", "subs")), ("n_train", pa.int64())]))

        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BATCH)


def _unbatch(packed: bytes) -> list[np.ndarray]:
    """ids, flags, words per text, word codes, subwords per word, subword ids of a batch."""
    out = unpack(packed, [*_PACKED, np.int64, np.int64])
    n_subs = out[4].astype(np.int64)
    n_subs[out[6]] = out[7]
    return [*out[:4], n_subs, out[5]]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's words counted over all batches, as each batch's words in their order."""
    held: list[tuple[int, list[str], np.ndarray]] = []
    bucket = None
    names = ["batch", "bucket", "total", "tokens", "types"]

    def settle():
        code = pa.array([w for _, ws, _ in held for w in ws], pa.string()).dictionary_encode()
        at = code.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(at, np.concatenate([c for *_, c in held]), len(code.dictionary)).astype(np.int64)
        ends = np.cumsum([len(ws) for _, ws, _ in held])
        blobs = [planes(t) for t in np.split(total[at], ends[:-1])]
        first = [1] + [0] * (len(held) - 1)
        columns = [[b for b, *_ in held], [bucket] * len(held), blobs, [int(total.sum()) * f for f in first], [int((total > 0).sum()) * f for f in first]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            if bucket != row["bucket"] and held:
                yield from settle()
                held = []
            bucket = row["bucket"]
            held.append((row["batch"], unzip.decompress(row["words"]).decode("utf-8", "surrogatepass").split("\n"), unplaned(row["counts"], np.int64)))
    if held:
        yield from settle()


def _places(codes: np.ndarray, lengths: np.ndarray, n_subs: np.ndarray, subs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of texts laid end to end, each closed by the end id, and their lengths."""
    starts = np.cumsum(n_subs) - n_subs
    each = n_subs[codes]
    ends = np.concatenate(([0], np.cumsum(each)))
    per = np.diff(ends[np.concatenate(([0], np.cumsum(lengths)))]) + 1
    out = np.full(int(per.sum()), end, np.int64)
    body = np.ones(len(out), bool)
    body[np.cumsum(per) - 1] = False
    out[body] = subs[np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], each)]
    return out, per


def _chunks(lengths: np.ndarray, most: int = 1 << 19):
    """Runs of texts with about ``most`` words, as (first, last) of texts and of words."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, stop, before, int(ends[stop - 1])
        at = stop


def _counted(batches: DataFrame, n_ids: int) -> np.ndarray:
    """How often each subword id occurs in the training texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for part in parts:
            for blob in part.column("subs").to_pylist():
                at, n = unpack(blob, [np.int64, np.int64])
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "n"])

    found = batches.select("subs").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # at most a row an id
    counts = np.zeros(n_ids, np.int64)
    counts[found["i"].to_numpy()] = found["n"].to_numpy()
    return counts


def _round_of(n: int, rounds: int) -> np.ndarray:
    """The round that learns from each of n texts: equal shares, at random."""
    return np.random.default_rng(n).permutation(n) % rounds


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of many tasks added up by lane, in the order of the tasks."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            w, used = np.frombuffer(row["w"], np.float32).astype(np.float64) * row["used"], row["used"]
            before = totals.get(row["lane"])
            totals[row["lane"]] = (used, w) if before is None else (used + before[0], w + before[1])
    lanes = list(totals)
    columns = [pa.array(lanes, pa.int32()), pa.array([totals[k][0] for k in lanes], pa.int64()), pa.array([totals[k][1].tobytes() for k in lanes], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["lane", "used", "w"])


def _rounds(batches: DataFrame, symbols: attention.Symbols, counts: np.ndarray, rates: tuple[float, ...] = RATES) -> np.ndarray:
    """Weights after rounds of local training, a task going on from batch to batch, averaged
    by windows used."""
    weights, end, parts = attention.initial(symbols, counts), len(counts) - 1, int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for nth, rate in enumerate(rates):

        def run(parts: Iterator[pa.RecordBatch], start=weights, nth=nth, rate=rate) -> Iterator[pa.RecordBatch]:
            roomy()
            trainer = attention.Trainer(start, rate)
            for part in parts:
                for packed in part.column("pack").to_pylist():
                    _, flags, lengths, codes, n_subs, subs = _unbatch(packed)
                    for first, last, a, b in _chunks(lengths.astype(np.int64)):
                        learn = ((flags[first:last] & 1) == 0) & (_round_of(last - first, len(rates)) == nth)
                        keep = np.repeat(learn, lengths[first:last])
                        ids, per = _places(codes[a:b][keep], lengths[first:last][learn].astype(np.int64), n_subs, subs, end)
                        trainer.learn(symbols.of.take(ids).astype(np.int64), per)
            if trainer.used:
                task = TaskContext.get().partitionId()
                made = [c.tobytes() for c in np.array_split(trainer.w, CHUNKS)]
                lanes = [c * LANES + task % LANES for c in range(CHUNKS)]
                columns = [pa.array(lanes, pa.int32()), pa.array([task] * CHUNKS, pa.int32()), pa.array([trainer.used] * CHUNKS, pa.int64()), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lane", "task", "used", "w"])
            release()

        made = batches.select("pack").mapInArrow(run, "lane int, task int, used long, w binary")
        lanes = made.repartition(min(parts, CHUNKS * LANES), "lane").sortWithinPartitions("lane", "task")
        rows = lanes.mapInArrow(_summed, "lane int, used long, w binary").collect()  # at most CHUNKS * LANES rows
        if rows:
            chunks = []
            for c in range(CHUNKS):
                own = sorted((r for r in rows if r["lane"] // LANES == c), key=lambda r: r["lane"])
                chunks.append(sum(np.frombuffer(r["w"], np.float64) for r in own) / sum(r["used"] for r in own))
            weights = np.concatenate(chunks).astype(np.float32)
    return weights


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rates: tuple[float, ...] = RATES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = f.read()  # some hundred kB
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = settled(_batches(docs, ranks, max(4, (parts - 1).bit_length())), "batches")
    packs = all_rows.where("pack IS NOT NULL")
    words = all_rows.where("words IS NOT NULL").select("batch", "bucket", "words", "counts").repartition(parts, "bucket").sortWithinPartitions("bucket")
    totals = settled(words.mapInArrow(_totals, "batch long, bucket int, total binary, tokens long, types long"), "totals")
    n_words, n_types = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    ends = packs.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    tokens, types = n_words + ends, n_types + (ends > 0)
    clusters = subword_clusters(ranks)
    counts = _counted(packs, len(clusters))
    symbols = attention.Symbols.from_counts(clusters, counts, SMOOTH)
    weights = _rounds(packs, symbols, counts, rates)
    below = tokens + SMOOTH * (types + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        roomy()
        out = []
        counted = right.sort_by("bucket").column("total").to_pylist()
        count = np.concatenate([unplaned(b, np.int64) for b in counted]) if counted else np.zeros(0, np.int64)
        base, known = np.log10((count + SMOOTH) / below), (count > 0).astype(float)
        for packed in left.column("pack").to_pylist():
            ids, flags, lengths, codes, n_subs, subs = _unbatch(packed)
            lengths = lengths.astype(np.int64)
            for first, last, a, b in _chunks(lengths):
                n, code = lengths[first:last], codes[a:b]
                text = np.repeat(np.arange(len(n)), n)
                places, per = _places(code, n, n_subs, subs, len(clusters) - 1)
                ids_of = symbols.of.take(places).astype(np.int64)
                logs = attention.log_probabilities(weights, ids_of, per) / LN10 + symbols.share.take(places)
                null = (flags[first:last] & 2) > 0
                out.append(
                    pa.table(
                        {
                            "doc_id": pa.array(ids[first:last], mask=null),
                            "held_out": (flags[first:last] & 1) == 1,
                            "n_tokens": n + 1,
                            "n_known": np.bincount(text, known[code], len(n)).astype(np.int64) + int(ends > 0),
                            "train_tokens": np.full(len(n), tokens, np.int64),
                            "base_score": np.bincount(text, base[code], len(n)) + np.log10((ends + SMOOTH) / below),
                            "score": np.add.reduceat(logs, np.cumsum(per) - per),
                        }
                    )
                )
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    met = packs.select("batch", "pack").groupBy("batch").cogroup(totals.select("batch", "bucket", "total").groupBy("batch"))
    return met.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scores(spark, sf_dir):
    """Model and base score of every document, learned from those that aren't held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
