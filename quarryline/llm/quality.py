"""Quality rules: fixed limits first, then gradient-boosted trees over document statistics.

The statistics are counted over the whole text.  The trees are fitted to the
``quality`` labels of at most ``SAMPLE`` labelled rows (those with the smallest
hash of their doc_id: a bounded sample, the same on every run), with log-odds that
never rise with the share of symbols, repeated words or repeated lines.  All rows
are then scored by the flattened trees, a batch at a time.

Defined results: a null text has no words and fails the base rules; with no usable
labels the model keeps everything the base rules keep; labels that are null, or of
documents that aren't there, take no part; several labels of one document count
once each; repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .trees import Forest, fit
from .words import covered, mixed, owners, rolling, slices, split_words, window_starts

SAMPLE = 20_000
SPREAD = 1 << 40
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "line_words")
MONOTONE = {2: -1, 3: -1, 4: -1}
KEEP_MARGIN = 0.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS, _DIGITS, _UPPER = b"#*$%&|<>", b"0123456789", bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def repeated_words(offsets: np.ndarray, codes: np.ndarray, width: int = 8) -> np.ndarray:
    """Per text: words inside windows of ``width`` words found twice or more in it."""
    at = window_starts(offsets, width)
    of = owners(offsets)
    if not len(at):
        return np.zeros(len(offsets) - 1, np.int64)
    key = rolling(mixed(codes.astype(np.uint64) + np.uint64(1)), width)[at] ^ mixed(of[at].astype(np.uint64) * np.uint64(2) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.concatenate(([False], s[1:] == s[:-1]))
    same[:-1] |= same[1:]
    hit = covered(at[order[same]], width, len(codes))
    return np.bincount(of[hit], minlength=len(offsets) - 1)


def _statistics(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows, 5) and features (rows, 10) of a batch's texts."""
    texts = pc.fill_null(batch.column("text"), "")
    offsets, codes, _ = split_words(texts)
    n = np.diff(offsets)
    raw = texts.cast(pa.large_binary()).to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw))

    def holds(chars: bytes) -> np.ndarray:
        return size - np.fromiter((len(t.translate(None, chars)) for t in raw), np.int64, len(raw))

    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = points - holds(WHITE)
    lines = [[x for x in t.split(b"\n") if x.strip(WHITE)] for t in raw]
    n_lines = np.fromiter(map(len, lines), np.int64, len(raw))
    dup = n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(raw))
    repeat = repeated_words(offsets, codes)
    symbols = holds(_SYMBOLS)
    of = owners(offsets)
    pairs = np.unique(of * np.int64(len(codes) + 1) + codes)
    distinct = np.bincount(pairs // np.int64(len(codes) + 1), minlength=len(raw))
    words, letters, rows = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    base = np.stack([n, chars, symbols, dup, repeat], axis=1)
    features = np.stack(
        [np.log1p(n), chars / words, symbols / letters, dup / rows, repeat / words, holds(_UPPER) / letters, holds(_DIGITS) / letters, holds(_MARKS) / letters, distinct / words, np.log1p(n / rows)],
        axis=1,
    )
    return base, features


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and ``features`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                base, features = _statistics(batch)
                lists = pa.ListArray.from_arrays(np.arange(0, features.size + 1, features.shape[1], dtype=np.int32), features.ravel())
                columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(base[:, j]) for j in range(len(BASE))), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "features"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """The trees, from at most ``sample`` labelled rows brought to the driver."""
    named = labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    rows = stats.select("doc_id", "features").join(named, F.col("doc_id") == F.col("labelled"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    n = named.count()
    if n > sample:  # leave tasks with about as many rows as are wanted, not that many each
        rows = rows.where(spread < F.lit(int(1.2 * SPREAD * sample / n)))
    rows = rows.orderBy(spread, "doc_id", "quality").limit(sample).select("features", "quality").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float), MONOTONE)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``kept`` and the model's ``quality_margin``."""
    stats = settled(statistics(docs), "statistics")
    forest = train(stats, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            rest = batch.select(["doc_id", *BASE])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(forest.margins(x))], names=[*rest.schema.names, "quality_margin"])

    scored = stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", quality_margin double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("quality_margin") > (KEEP_MARGIN if len(forest.value) else float("-inf")))).alias("kept"), "quality_margin")


def op6_quality_rules(spark, sf_dir):
    """Base counts and verdict of every document, the model fitted to the labels table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, labels)
