"""Importance resampling against a plain version, whole and in chunks."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from quarryline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(rows, target):
    made = [(d, *features(t)) for d, t in rows]
    s, t = sum((c for *_, c in made), Counter()), sum((features(x)[1] for x in target), Counter())
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in s}
    out = []
    for d, n, c in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in c.items())
        out.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdE é9日-"), rng.integers(1, 7))) for _ in range(400)]
    made = [(i, " ".join(rng.choice(words, rng.integers(1, 120)))) for i in range(300)]
    long = " ".join(rng.choice(words, 20_000))
    made += [(400, long), (401, long), (401, long), (None, long), (402, "-" * 90_000), (403, "x" * 90_000 + " y"), (404, "a " * 2), (405, None), (405, None), (None, ""), (None, None), (406, "é" * 3000 + "\x00" + "Q" * 7), (7, made[7][1])]
    return made, [m[1] for m in made[:6]] + [None, ""]


@pytest.mark.parametrize("chunk", [1 << 18, 1000, 61])
def test_against_a_plain_version(spark, rows, chunk):
    made, target = rows
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in made], "doc_id long, text string, bucket string, n int").repartition(5)
    found = importance.importance(df, spark.createDataFrame([(t,) for t in target], "text string"), chunk=chunk)
    got = [tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(plain(made, target), key=key)
    drawn = importance.resampled(df, found)
    assert drawn.columns == df.columns and drawn.count() == sum(r[4] is not None for r in got)


def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows[0], "doc_id long, text string")
    none = df.where("false")
    assert importance.importance(none, df).isEmpty()
    got = [tuple(r) for r in importance.importance(df, none).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(plain(rows[0], []), key=key)


def test_hashes_of_runs_are_the_texts_own():
    words = ["a", "bé", "c" * 300, "日本", "z9"]
    dictionary, codes = pa.array(words, pa.large_string()), np.array([0, 1, 2, 3, 4, 2, 1])
    got = {n: dict(zip(p.tolist(), c.tolist(), strict=True)) for n, (p, c) in enumerate(importance.feature_hashes(np.array([0, 4, 7]), codes, dictionary, 4), 1)}
    for n in range(1, 5):
        for first, last in ((0, 4), (4, 7)):
            for i in range(first, last):
                run = [words[c] for c in codes[i : min(i + n, last)]]
                assert got[n].get(i) == (zlib.crc32(" ".join(run).encode()) if len(run) == n else None)
