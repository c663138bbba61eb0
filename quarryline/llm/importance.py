"""Resampling by importance: documents whose hashed n-grams look like a target's are drawn more.

Every run of one to ``order`` words falls in a bucket by its CRC-32.  A bucket's gain is
the logarithm of its share in the target over its share in the corpus; a document weighs
the sum of its features' gains, and Gumbel noise of its id turns the highest scores into
a draw without replacement.

Texts are skewed in length, so the work goes by chunks: a text of over ``CHUNK`` bytes is
split at word boundaries, each chunk owns the words that start in it and carries the next
``order - 1`` words, so every feature is counted by the chunk of its first word and by no
other.  Chunks are dealt over all tasks; counts of chunks are summed by bucket, weights
of chunks by document.  Shorter texts are one chunk and stay where they are read.

The CRC of a feature comes from those of its words: appending bytes is linear over GF(2),
so each distinct word of a batch is hashed once and runs are put together by table.

Only the gains (a number a bucket) pass the driver.  Ranks come from a range partitioning
by score, numbered in each range and offset by the ranges before.

Defined results: a null text has no features and weight 0; a null doc_id makes its noise
from no digits and comes last among ties; repeated rows are documents of their own with
equal scores; an empty target gives gains from the corpus alone; an empty corpus gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import settled
from .words import owners, release, slices, split_words

ORDER, BUCKETS, CHUNK = 3, 10_000, 1 << 18
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
"""Letters lower-cased, digits and all of UTF-8's longer characters kept, all else a blank."""


def _stepping() -> np.ndarray:
    """What one more zero byte does to each byte of a CRC-32 register: 4 x 256."""
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, v >> 1 ^ np.uint32(0xEDB88320), v >> 1).astype(np.uint32)
    low = np.arange(256, dtype=np.uint32)
    return np.stack([v, low, low << 8, low << 16]).astype(np.uint32)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0, crc & 255]
    for k in range(1, 4):
        out = out ^ table[k, crc >> (8 * k) & 255]
    return out


def appending(lengths: np.ndarray) -> np.ndarray:
    """For each length, the table that moves a CRC past so many further bytes: n x 4 x 256."""
    low = np.arange(256, dtype=np.uint32)
    out = np.repeat(np.stack([low << (8 * k) for k in range(4)]).astype(np.uint32)[None], len(lengths), axis=0)
    power, left = _stepping(), lengths.astype(np.int64)
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _through(power, out[odd])
        power, left = _through(power, power), left >> 1
    return out


def feature_hashes(offsets: np.ndarray, codes: np.ndarray, dictionary: pa.Array, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, crc`` for each run length: the words that begin such a run, and its CRC-32."""
    words = [w.as_py() for w in dictionary.cast(pa.large_binary())]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(words))
    lengths, which = np.unique(np.fromiter(map(len, words), np.int64, len(words)), return_inverse=True)
    plain, longer = appending(lengths), appending(lengths + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    places = np.arange(len(codes))
    yield places, crc[codes]
    so_far = spaced[codes]
    for n in range(1, order):
        inside = places + n < ends[places]
        places, so_far = places[inside], so_far[inside]
        after = codes[places + n]

        def moved(tables: np.ndarray, so_far: np.ndarray = so_far, at: np.ndarray = which[after]) -> np.ndarray:
            out = tables[at, 0, so_far & 255]
            for k in range(1, 4):
                out ^= tables[at, k, so_far >> (8 * k) & 255]
            return out

        yield places, moved(plain) ^ crc[after]
        so_far = moved(longer) ^ spaced[after]


def chunks(docs: DataFrame, order: int = ORDER, size: int = CHUNK) -> DataFrame:
    """``doc_id, text_key, chunk, own, text`` of every row: ``own`` words of the chunk count
    as first words of features (null: all), later ones are carried."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                data = np.frombuffer(text.as_py().translate(_KEPT), np.uint8)
                inside = np.concatenate(([False], data != 32, [False]))
                starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
                piece = starts // size
                firsts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(piece) else np.zeros(1, np.int64)
                for k, (a, b) in enumerate(zip(firsts.tolist(), [*firsts[1:].tolist(), len(starts)], strict=True)):
                    upto = min(b + order - 1, len(starts))
                    words = data[starts[a] : ends[upto - 1]].tobytes() if upto > a else b""
                    columns = [batch.column(c).slice(i, 1) for c in ("doc_id", "text_key")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([k], pa.int32()), pa.array([b - a], pa.int64()), pa.array([words.decode()])], names=["doc_id", "text_key", "chunk", "own", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    long = F.octet_length("text") > size
    whole = rows.where(F.coalesce(~long, F.lit(True))).select("doc_id", "text_key", F.lit(-1).alias("chunk"), F.lit(None).cast("long").alias("own"), "text")
    pieces = rows.where(long).mapInArrow(cut, "doc_id long, text_key long, chunk int, own long, text string")
    return whole.unionByName(pieces.repartition("doc_id", "text_key", "chunk"))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of a batch of chunks and, for each chunk, where its own words end."""
    texts = [(t.as_py() or b"").translate(_KEPT) for t in batch.column("text").cast(pa.large_binary())]
    offsets, codes, dictionary = split_words(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    own = pc.fill_null(batch.column("own"), 1 << 62).to_numpy(zero_copy_only=False)
    return offsets, codes, dictionary, offsets[:-1] + np.minimum(own, np.diff(offsets))


def counts(pieces: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all chunks, counted in each task before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, codes, dictionary, upto = _words(batch)
                owned = np.arange(len(codes)) < np.repeat(upto, np.diff(offsets))
                for places, crc in feature_hashes(offsets, codes, dictionary, order):
                    total += np.bincount(crc[owned[places]] % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])
        release()

    return pieces.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket, from two tables of counts."""
    of = lambda df, n: df.select("bucket", F.col("n").alias(n))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(of(corpus, "s"), "bucket", "left").join(of(target, "t"), "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    totals = [df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(n)) for df, n in ((corpus, "all_s"), (target, "all_t"))]
    both = both.crossJoin(totals[0]).crossJoin(totals[1])  # a row each
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(pieces: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """``doc_id, text_key, n_words, n_features, weight`` of every row of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, codes, dictionary, upto = _words(batch)
                owned = np.arange(len(codes)) < np.repeat(upto, np.diff(offsets))
                of = owners(offsets)
                n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(len(codes) + 1, np.int64)
                for places, crc in feature_hashes(offsets, codes, dictionary, order):
                    some = owned[places]
                    places, crc = places[some], crc[some]
                    n += np.bincount(of[places], minlength=batch.num_rows)
                    weight[places + 1] += gain[crc % len(gain)]
                upto_here = np.cumsum(weight)
                columns = [batch.column(c) for c in ("doc_id", "text_key", "chunk")]
                made = [upto - offsets[:-1], n, upto_here[offsets[1:]] - upto_here[offsets[:-1]]]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, made)], names=["doc_id", "text_key", "chunk", "n_words", "n_features", "weight"])
        release()

    scored = pieces.mapInArrow(run, "doc_id long, text_key long, chunk int, n_words long, n_features long, weight long")
    sums = ("n_words", "n_features", "weight")
    summed = scored.where("chunk >= 0").groupBy("doc_id", "text_key").agg(F.sum((F.col("chunk") == 0).cast("int")).alias("copies"), *[F.sum(c).alias(c) for c in sums])
    each = summed.select("doc_id", "text_key", F.explode(F.sequence(F.lit(1), "copies")).alias("_"), *[F.expr(f"{c} div copies").alias(c) for c in sums])
    return scored.where("chunk < 0").select("doc_id", "text_key", *sums).unionByName(each.drop("_"))


def ranked(rows: DataFrame, by: list, drawn: int) -> DataFrame:
    """``rows`` with ``rank``, 1 to ``drawn`` in the order ``by``, null beyond."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("nth", pa.array(np.arange(at + 1, at + batch.num_rows + 1)))
            at += batch.num_rows

    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
    held = settled(ranges.mapInArrow(numbered, StructType([*ranges.schema.fields, StructField("nth", LongType())])), "ranked")
    sizes = held.groupBy(F.col("range").alias("of")).agg(F.max("nth").alias("n"))
    before = sizes.select("of", (F.sum("n").over(Window.orderBy("of")) - F.col("n")).alias("before"))  # a row a range
    rank = F.col("before") + F.col("nth")
    return held.join(before, F.col("range") == F.col("of")).withColumn("rank", F.when(rank <= drawn, rank)).select(*rows.columns, "rank")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, text_key, n_words, n_features, weight, score, rank`` of every row.

    ``percent`` of a hundred documents with ``least_words`` or more are drawn; ``rank`` is
    the place in the draw, null if not drawn.  ``target`` needs ``text`` alone.
    """
    pieces = chunks(docs, order, chunk)
    aim = chunks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, chunk)
    table = gains(settled(counts(pieces, order, buckets), "counts"), settled(counts(aim, order, buckets), "aim"), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in table.collect():  # one number a bucket
        gain[r["bucket"]] = r["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = settled(weights(pieces, gain, order).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    inside = ranked(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], drawn)
    return inside.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, all their columns; ``found`` comes from ``importance``.
    Of repeated rows as many stay as were drawn."""
    drawn = found.where("rank IS NOT NULL").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).agg(F.count("*").alias("_drawn"))
    keyed = docs.withColumn("_key", F.xxhash64(F.col("text").cast("string")))
    met = keyed.join(drawn, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("_drawn"))
    return met.withColumn("_nth", nth).where("_nth <= _drawn").select(*[f"`{c}`" for c in docs.columns])


def op13_importance_resampling(spark, sf_dir):
    """All ``documents`` weighed towards ``benchmark``, five of a hundred drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


IMPORTANCE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
w AS (SELECT 'd' AS kind, row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
      UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
r AS (SELECT kind, row_no, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS run FROM w),
c AS (SELECT kind, row_no, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(run)), lambda i: CAST('0x' || hex(encode(run))[2 * i + 1:2 * i + 2] AS BIGINT))), lambda a, b: xor(a >> 8, steps[xor(a, b) % 256 + 1])), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT run FROM c), crc),
f AS (SELECT kind, row_no, bucket, CAST(sum(n) AS BIGINT) AS n FROM c JOIN h USING (run) GROUP BY ALL),
b AS (SELECT bucket, CAST(sum(n) FILTER (WHERE kind = 'd') AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE kind = 'b'), 0) AS DOUBLE) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000)))) AS BIGINT) AS gain FROM b),
d AS (SELECT row_no, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE kind = 'd' GROUP BY row_no),
o AS (SELECT doc_id, row_no, len(words) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN d USING (row_no) WHERE kind = 'd'),
p AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * (SELECT count(*) FROM o WHERE able) // 100 THEN place END AS rank FROM p
"""
