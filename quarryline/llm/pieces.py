"""SentencePiece encoding and decoding of whole texts.

A text is cut where no piece can reach across, before each run of spaces; what lies
between is a word.  A task keeps a batch's texts as codes into its own words, and
the distinct words of the corpus, gathered by hash bucket, are encoded once each as
relations: every word explodes into its substrings of bounded length, these meet the
piece table in an equi-join, the edges that remain are grouped by word into its
lattice, and one ``aggregate`` folds the lattice into the word's segmentation.

Two folds share the lattice.  For unigram models it is Viterbi: the best sum of
scores up to each place.  A BPE model's scores are merge ranks, and the best sum of
them is not the model's encoding; there the fold takes the edges by rank and joins
two neighbours where an edge spans just these.  One pass is exact: until a piece's
turn its span, if no merge crosses its ends, holds what the piece's own edges alone
make of it, and a merge across its ends stays for good.  Only pieces that one pass
over their own edges doesn't give can be due later; the few words that hold such a
piece, and words of over 61 characters, are merged with a queue instead.

Characters without a piece become bytes.  Decoding joins the bytes of the pieces.

Defined results: a null or empty text has no ids and decodes to the empty text; the
character U+2581 is read as a space, as the format has it; an empty table gives no
rows; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import pack, planes, release, roomy, slices, unpack, unplaned

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONGEST = 61  # characters of a word whose boundaries, and one bit more, fit a long
BATCH_BYTES = 12 << 20
SPACE = "▁"


@dataclass(frozen=True)
class Pieces:
    """A piece table: ordinary pieces with id and score, and how bytes and ids decode."""

    score: dict[str, float]
    ids: dict[str, int]
    risky: frozenset[str]  # one pass over a piece's own edges doesn't give it
    byte_ids: tuple[int, ...]
    decoded: tuple[bytes, ...]
    unknown: int
    unigram: bool
    longest: int


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The piece table of a SentencePiece model file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    _check(proto)
    n = s.get_piece_size()
    plain = [i for i in range(n) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))]
    return table([(s.id_to_piece(i), i, s.get_score(i)) for i in plain], {s.id_to_piece(i): i for i in range(n) if s.is_byte(i)}, n, s.unk_id(), proto.trainer_spec.model_type == 1)


def _check(proto) -> None:
    """A model that would be read otherwise than its own library does is refused."""
    rules, kinds = proto.normalizer_spec, proto.trainer_spec
    odd = {
        "a normaliser": bool(rules.precompiled_charsmap),
        "no dummy prefix": not rules.add_dummy_prefix,
        "white space removed": rules.remove_extra_whitespaces,
        "white space unescaped": not rules.escape_whitespaces,
        "white space as suffix": kinds.treat_whitespace_as_suffix,
        "neither unigram nor BPE": kinds.model_type not in (1, 2),
        "user-defined pieces": any(x.type == 4 for x in proto.pieces),
    }
    if any(odd.values()):
        raise ValueError("the model has " + ", ".join(name for name, is_so in odd.items() if is_so))


def table(plain: list[tuple[str, int, float]], byte_pieces: dict[str, int], n: int, unknown: int, unigram: bool) -> Pieces:
    score = {p: s for p, _, s in plain}

    def irregular(p: str) -> bool:
        """Does one pass over the piece's own edges fail to give the piece?"""
        edges = sorted((-score[p[a:b]], a, b) for a in range(len(p)) for b in range(a + 2, len(p) + 1) if p[a:b] in score)
        marks = set(range(len(p) + 1))
        for _, a, b in edges:
            inner = marks.intersection(range(a + 1, b))
            if a in marks and b in marks and len(inner) == 1:
                marks -= inner
        return len(marks) > 2

    decoded = [b""] * n
    for p, i, _ in plain:
        decoded[i] = p.replace(SPACE, " ").encode()
    for b in range(256):
        if (i := byte_pieces.get(f"<0x{b:02X}>")) is not None:
            decoded[i] = bytes([b])
    byte_ids = tuple(byte_pieces.get(f"<0x{b:02X}>", unknown) for b in range(256))
    return Pieces(score, {p: i for p, i, _ in plain}, frozenset() if unigram else frozenset(p for p in score if len(p) > 1 and irregular(p)), byte_ids, tuple(decoded), unknown, unigram, max(map(len, score), default=1))


def merged(word: str, score: dict[str, float]) -> list[str]:
    """BPE merges of a word of any length: the best pair first, leftmost among equals."""
    ends = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    queue: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        """The pair that begins at a."""
        if 0 <= a and ends[a] < len(word):
            m = ends[a]
            s = score.get(word[a : ends[m]])
            if s is not None:
                heapq.heappush(queue, (-s, a, m, ends[m]))

    for a in range(len(word) - 1):
        offer(a)
    while queue:
        _, a, m, b = heapq.heappop(queue)
        if ends[a] != m or ends[m] != b:
            continue  # one of the two has been merged meanwhile
        ends[a], ends[m] = b, -1
        if b < len(word):
            before[b] = a
        offer(before[a])
        offer(a)
    out, a = [], 0
    while a < len(word):
        out.append(word[a : ends[a]])
        a = ends[a]
    return out


def _spell(parts: list[str], p: Pieces) -> list[int]:
    """Ids of segmented parts; a part without a piece goes byte by byte."""
    out: list[int] = []
    for part in parts:
        i = p.ids.get(part)
        if i is not None:
            out.append(i)
        else:
            out.extend(p.byte_ids[b] for b in part.encode("utf-8", "surrogatepass"))
    return out


# --- the lattice ------------------------------------------------------------------


def lattice(words: DataFrame, pieces: DataFrame, shortest: int, longest: int, keys: list[str]) -> DataFrame:
    """``keys, n, edges, risky``: for each word the pieces found in it, as edges.

    ``words`` has ``keys`` and ``word``; ``pieces`` has ``piece, cost, risky`` and is
    at most a vocabulary large, so it is broadcast.
    """
    w = words.select(*keys, "word", F.length("word").alias("n")).where(F.col("n") >= shortest)
    at = w.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - shortest)).alias("a"))
    spans = at.select("*", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.col("n") - F.col("a")))).alias("size"))
    spans = spans.select(*keys, "n", "a", (F.col("a") + F.col("size")).alias("b"), F.substring("word", F.col("a") + 1, F.col("size")).alias("piece"))
    met = spans.join(F.broadcast(pieces), "piece")
    return met.groupBy(*keys, "n").agg(F.collect_list(F.struct("cost", "a", "b")).alias("edges"), F.max("risky").alias("risky"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _fits(marks: Column, e: Column) -> Column:
    """Does an edge span just two neighbours?"""
    inner = _bit(e["b"]) - _bit(e["a"] + 1)  # bits a+1 to b-1
    return (marks.bitwiseAND(_bit(e["a"])) != 0) & (marks.bitwiseAND(_bit(e["b"])) != 0) & (F.bit_count(marks.bitwiseAND(inner)) == 1)


def _joined(marks: Column, e: Column) -> Column:
    return marks.bitwiseAND(F.bitwise_not(_bit(e["b"]) - _bit(e["a"] + 1)))


def merge_fold(edges: Column, n: Column) -> Column:
    """Boundaries (bit i: a part begins or ends at i) after merging by cost, then place."""
    return F.aggregate(F.array_sort(edges), _bit(n + 1) - 1, lambda m, e: F.when(_fits(m, e), _joined(m, e)).otherwise(m))


def viterbi_fold(edges: Column, n: Column, unknown_cost: float) -> Column:
    """Boundaries of the path of least cost; a character of its own costs ``unknown_cost`` at most."""
    by_end = F.array_sort(F.transform(edges, lambda e: F.struct(e["b"].alias("b"), e["a"].alias("a"), e["cost"].alias("cost"))))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("marks"))

    def place(states: Column, i: Column) -> Column:
        """One place further: the best of its edges, or a lone character."""
        last = F.element_at(states, -1)
        lone = F.struct((last["cost"] + unknown_cost).alias("cost"), last["marks"].bitwiseOR(_bit(i)).alias("marks"))
        here = F.transform(
            F.filter(by_end, lambda e: e["b"] == i),
            lambda e: F.struct((states[e["a"]]["cost"] + e["cost"]).alias("cost"), states[e["a"]]["marks"].bitwiseOR(_bit(i)).alias("marks")),
        )
        return F.concat(states, F.array(F.array_min(F.concat(F.array(lone), here))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), F.array(start), place), -1)["marks"]


def segmented(words: DataFrame, p: Pieces, keys: list[str]) -> DataFrame:
    """``keys, marks`` of every word that has an edge; null marks where one pass won't do."""
    spark = words.sparkSession
    least = 1 if p.unigram else 2
    rows = [(w, -s, w in p.risky and not p.unigram) for w, s in p.score.items() if len(w) >= least]
    dim = spark.createDataFrame(rows, "piece string, cost double, risky boolean")
    found = lattice(words.where(F.length("word") <= LONGEST), dim, least, p.longest, keys)
    edges, n = F.col("edges"), F.col("n")
    if p.unigram:
        return found.select(*keys, viterbi_fold(edges, n, 10.0 - min(p.score.values(), default=0.0)).alias("marks"))
    return found.select(*keys, F.when(~F.col("risky"), merge_fold(edges, n)).alias("marks"))


# --- texts as words and back ------------------------------------------------------

_RUNS = re.compile(r" *[^ ]+| +")


def _word_lists(texts: pa.Array) -> pa.LargeListArray:
    """Each text's words, without the one space every word begins with."""
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.ends_with(texts, " "))
    odd = pc.or_(odd, pc.equal(texts, ""))
    lists = pc.split_pattern(texts, " ")
    if not pc.any(odd).as_py():
        return lists
    rows = lists.to_pylist()
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        text = texts[int(i)].as_py()
        rows[i] = [x[1:] for x in _RUNS.findall(" " + text)] if text else []
    return pa.array(rows, pa.large_list(pa.large_string()))


def _coded(batch: pa.RecordBatch, bits: int, nth: int):
    """Batch name, words by falling frequency, their buckets, words per text, codes.

    The name tells the task, the batch's number in it and its contents: batches of equal
    texts stay apart, and another read that deals the rows otherwise is found out.
    """
    lists = _word_lists(batch.column("text"))
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-np.bincount(codes, minlength=len(flat.dictionary)), kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    codes = back[codes].astype(np.uint32)
    words = flat.dictionary.take(pa.array(order)).to_pylist()
    of = xxhash.xxh64_intdigest
    bucket = (np.fromiter((of(w) for w in words), np.uint64, len(words)) >> np.uint64(64 - bits)).astype(np.uint32)
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.uint32)
    name = xxhash.xxh3_64(f"{TaskContext.get().partitionId()} {nth}".encode())
    name.update(codes.tobytes())
    name.update(lengths.tobytes())
    for w in words:
        name.update(w.encode("utf-8", "surrogatepass") + b"\0")
    return name.intdigest() - (1 << 63), words, bucket, lengths, codes


def _vocabularies(docs: DataFrame, bits: int) -> DataFrame:
    """``batch, bucket, words``: each batch's words, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for nth, batch in enumerate(part for whole in batches for part in slices(whole, "text", BATCH_BYTES)):
            name, words, bucket, *_ = _coded(batch, bits, nth)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=-1)) if len(order) else np.zeros(1, int)
            blobs = [zip_.compress(SPACE.join([words[i] for i in order[a:b].tolist()]).encode("utf-8", "surrogatepass")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(blobs), pa.int64()), pa.array(bucket[order[edges[:-1]]].astype(np.int32) if blobs else [], pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "bucket", "words"]
            )

        release()

    return docs.mapInArrow(run, "batch long, bucket int, words binary")  # all columns, as in _packs: Arrow batches end by their bytes


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's distinct words, one a row and all in one, and each batch's words as
    numbers of them."""
    zip_, unzip = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    held: list[tuple[int, list[str]]] = []
    bucket = None
    schema = pa.schema([("bucket", pa.int32()), ("wid", pa.int32()), ("word", pa.string()), ("batch", pa.int64()), ("packed", pa.binary())])

    def packed(batch: int | None, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"bucket": bucket, "wid": None, "word": None, "batch": batch, "packed": data}], schema=schema)

    def settle():
        code = pa.array([w for _, ws in held for w in ws], pa.string()).dictionary_encode()
        order = pc.sort_indices(code.dictionary).to_numpy()  # numbers that don't depend on the order of arrival
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        at = number[code.indices.to_numpy(zero_copy_only=False)]
        words = code.dictionary.take(pa.array(order))
        n = len(words)
        for lo in range(0, n, 1 << 16):
            hi = min(n, lo + (1 << 16))
            columns = [pa.array(np.full(hi - lo, bucket, np.int32)), pa.array(np.arange(lo, hi, dtype=np.int32)), words.slice(lo, hi - lo), pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        yield packed(None, zip_.compress(SPACE.join(words.to_pylist()).encode("utf-8", "surrogatepass")))
        for (name, _), refs in zip(held, np.split(at, np.cumsum([len(ws) for _, ws in held])[:-1]), strict=True):
            yield packed(name, planes(refs))

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and held:
                yield from settle()
                held = []
            bucket = row["bucket"]
            held.append((row["batch"], unzip.decompress(row["words"]).decode("utf-8", "surrogatepass").split(SPACE)))
    if held:
        yield from settle()
    release()


def _spelled(words: list[str], marks: list[int | None], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Pieces per word and the ids of all, from words and their boundaries."""
    out = []
    for word, mark in zip(words, marks, strict=True):
        whole = SPACE + word.replace(" ", SPACE)
        if mark is not None:
            ends = [i for i in range(1, len(whole) + 1) if mark >> i & 1]
            parts = [whole[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        elif p.unigram:
            parts = best_path(whole, p)
        else:
            parts = merged(whole, p.score)
        out.append(_spell(parts, p))
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return sizes, np.fromiter((i for s in out for i in s), np.uint32, int(sizes.sum()))


def _answers(p: Pieces):
    def run(marked: pa.Table, kept: pa.Table) -> pa.Table:
        """Ids of each batch's words of a bucket."""
        rows = kept.to_pylist()
        blob = next(r["packed"] for r in rows if r["batch"] is None)
        words = zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass").split(SPACE)
        marks: list[int | None] = [None] * len(words)
        for wid, mark in zip(marked.column("wid").to_pylist(), marked.column("marks").to_pylist(), strict=True):
            marks[wid] = mark
        sizes, flat = _spelled(words, marks, p)
        starts = np.cumsum(sizes) - sizes
        out: dict[str, list] = {"batch": [], "bucket": [], "ids": []}
        for row in rows:
            if row["batch"] is None:
                continue
            at = unplaned(row["packed"], np.uint32).astype(np.int64)
            each = sizes[at]
            take = np.repeat(starts[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            out["batch"].append(row["batch"])
            out["bucket"].append(row["of_bucket"])
            out["ids"].append(pack(sizes=each.astype(np.uint32), ids=flat[take]))
        release()
        return pa.table(out, schema=pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())]))

    return run


def best_path(word: str, p: Pieces) -> list[str]:
    """The Viterbi path of a long word."""
    lone = 10.0 - min(p.score.values(), default=0.0)
    best, came = [0.0], [0]
    for e in range(1, len(word) + 1):
        options = [(best[a] - p.score[word[a:e]], a) for a in range(max(0, e - p.longest), e) if word[a:e] in p.score]
        cost, a = min([*options, (best[e - 1] + lone, e - 1)])
        best.append(cost)
        came.append(a)
    out, e = [], len(word)
    while e:
        out.append(word[came[e] : e])
        e = came[e]
    return out[::-1]


def _packs(docs: DataFrame, bits: int, others: list[str]) -> DataFrame:
    """``batch, pack, rows``: a batch's texts as codes, and its other columns as Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for nth, batch in enumerate(part for whole in batches for part in slices(whole, "text", BATCH_BYTES)):
            name, _, bucket, lengths, codes = _coded(batch, bits, nth)
            rest = batch.select(others)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_batch(rest)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([pack(buckets=bucket, lengths=lengths, codes=codes)], pa.binary()), pa.array([zip_.compress(sink.getvalue().to_pybytes())], pa.binary())], names=["batch", "pack", "rows"]
            )

        release()

    return docs.mapInArrow(run, "batch long, pack binary, rows binary")


def decode_lists(ids: pa.Array, p: Pieces) -> list[bytes]:
    """Texts of lists of ids, as bytes: a text's first space is the one encoding put there."""
    raw = pa.array(p.decoded, pa.binary()).take(ids.flatten())
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, raw), b"").to_pylist()
    return [t[1:] if t[:1] == b" " else t for t in joined]


def decode(encoded: DataFrame, path: str = MODEL, column: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its lists of ids (null: empty)."""
    p = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            if lists.null_count or lists.offset:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            text = pa.array([t.decode("utf-8", "replace") for t in decode_lists(lists, p)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def encode(docs: DataFrame, path: str = MODEL, others: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``others``, ``n_pieces``, ``ids`` and ``decoded_sha256`` (of the ids decoded again) of every row."""
    p = load(path)
    spark: SparkSession = docs.sparkSession
    docs = docs.select(*others, F.col("text").cast("string").alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (parts - 1).bit_length())
    sent = _vocabularies(docs, bits).repartition(parts, "bucket").sortWithinPartitions("bucket")
    gathered = sent.mapInArrow(_gathered, "bucket int, wid int, word string, batch long, packed binary")
    words = gathered.where("word IS NOT NULL").select("bucket", "wid", "word").repartition(parts, "bucket")
    marked = words.withColumn("word", F.concat(F.lit(SPACE), F.translate("word", " ", SPACE)))
    marks = segmented(marked, p, ["bucket", "wid"])
    kept = gathered.where("word IS NULL").select(F.col("bucket").alias("of_bucket"), "batch", "packed").repartition(parts, "of_bucket")
    answers = marks.groupBy("bucket").cogroup(kept.groupBy("of_bucket")).applyInArrow(_answers(p), "batch long, bucket int, ids binary")

    kinds = dict(docs.dtypes)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        blobs = right.sort_by("bucket").to_pylist()
        got = {r["bucket"]: r["ids"] for r in blobs}
        for row in left.to_pylist():
            buckets, lengths, codes = unpack(row["pack"], [np.uint32, np.uint32, np.uint32])
            sizes_of, ids_of = np.zeros(len(buckets), np.int64), []
            order = np.argsort(buckets, kind="stable")
            at = 0
            for b in sorted(got):
                sizes, ids = unpack(got[b], [np.uint32, np.uint32])
                sizes_of[order[at : at + len(sizes)]] = sizes
                ids_of.append(ids)
                at += len(sizes)
            if at != len(buckets):
                raise ValueError("a batch's words changed between two reads of the input")
            ordered = sizes_of[order]
            starts = np.empty(len(buckets), np.int64)
            starts[order] = np.cumsum(ordered) - ordered
            flat = np.concatenate(ids_of).astype(np.int32) if ids_of else np.zeros(0, np.int32)
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rows"])).read_all()
            ends, first = np.cumsum(lengths.astype(np.int64)), 0
            while first < len(lengths):  # a bounded part of the texts at a time
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + (1 << 18), "right")))
                code, n = codes[before : int(ends[last - 1])].astype(np.int64), lengths[first:last].astype(np.int64)
                each = sizes_of[code]
                ids = flat[np.repeat(starts[code] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
                per = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array(ids))
                shas = [hashlib.sha256(t).hexdigest() for t in decode_lists(lists, p)]
                out.append(pa.table([*rows.slice(first, last - first).columns, pa.array(per), lists, pa.array(shas)], names=[*rows.schema.names, "n_pieces", "ids", "decoded_sha256"]))
                first = last
        return pa.concat_tables(out) if out else None

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        made = run(left, right)
        release()
        return made if made is not None else empty

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", n_pieces long, ids array<int>, decoded_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()
    met = _packs(docs, bits, list(others)).groupBy("batch").cogroup(answers.groupBy("batch"))
    return met.applyInArrow(joined, schema)


def op1_sentencepiece(spark, sf_dir):
    """Every document encoded, and the digest of its ids decoded again."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
