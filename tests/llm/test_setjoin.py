"""Jaccard components against all pairs."""

import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarryline.llm import components, setjoin, sieve
from quarryline.llm.common import settled, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """component_id of each row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    return [(d, len(s), lowest.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(500)]
    some = lambda n: list(rng.choice(words, n))
    passage, texts = some(30), []
    for size in (12, 30, 60, 90, 200, 400):
        for _ in range(5):
            base = some(size)
            texts.append(base)
            for share in (0.004, 0.01, 0.02, 0.03, 0.04, 0.045, 0.05, 0.06):  # similarity from about 0.98 to 0.6
                made = list(base)
                for k in np.flatnonzero(rng.random(size) < share):
                    made[k] = str(rng.choice(words))
                texts.append(made)
            texts.append(base[: int(size * 0.81) + 1])
    family = some(150)  # a chain: each two neighbours link, the ends don't
    for k in range(25):
        texts.append([f"x{k}_{i}" for i in range(k * 3)] + family[k * 3 :])
    crowd = some(100)
    for k in range(60):
        made = list(crowd)
        made[int(rng.integers(100))] = f"edit{k}"
        texts.append(made)
    texts += [some(int(rng.integers(5, 80))) + passage + some(int(rng.integers(0, 80))) for _ in range(60)]
    texts += [some(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9) for _ in range(2)]
    made = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)) * 3, texts, strict=True)]
    made += [(9001, None), (9002, ""), (9003, " \t\n"), (9001, None), (None, None), (9004, made[0][1].upper().replace("É", "é")), (9005, made[0][1].replace(" ", "\n")), (None, made[3][1]), (None, "lonely words of a row without id"), (None, "lonely words of a row without id"), (made[9][0], "another text of the same id here"), made[5], made[5], (9006, "A b c"), (9007, "a B c"), (9008, "z " * 5000)]
    return made


@pytest.mark.parametrize("group,tokens", [(512, 1 << 20), (6, 700)])
def test_against_all_pairs(spark, monkeypatch, group, tokens):
    monkeypatch.setattr(setjoin, "GROUP", group)
    monkeypatch.setattr(setjoin, "TOKENS", tokens)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n int, class string").repartition(6)
    got = [tuple(r) for r in setjoin.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_empty_table(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_common_counts_tokens():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 5, 4000, 8000, 8000)]
    got = setjoin.common(sets)
    for i, j in itertools.combinations(range(5), 2):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_texts_are_not_shuffled_and_spent_tables_go(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settled(df, name)

    before = {p for p in os.listdir(shared_dir(spark).removeprefix("file://"))}
    monkeypatch.setattr(setjoin, "settled", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(corpus(), "doc_id long, text string")
        assert setjoin.jaccard_components(df).count() == len(corpus())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plans["sets"].splitlines()
    at = next(k for k, x in enumerate(lines) if "MapInArrow" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    below = lines[at + 1 : next((k for k in range(at + 1, len(lines)) if depth(lines[k]) <= depth(lines[at])), len(lines))]
    assert below and not any("SortMergeJoin" in x for x in below)
    after = {p.rpartition("-")[0] for p in os.listdir(shared_dir(spark).removeprefix("file://")) if p not in before}
    assert "names" in after and not after & {"rows", "sets"}


def test_sieve_loses_no_key(spark):
    keys = spark.range(0, 30000, 3).select(F.xxhash64("id").alias("key"))
    passed = sieve.Sieve(keys).passed(spark.range(90000), F.xxhash64("id"))
    ids = np.array([r["id"] for r in passed.collect()])
    own = (ids % 3 == 0) & (ids < 30000)
    assert own.sum() == 10000 and (~own).sum() < 4000 and passed.columns == ["id"]


def test_a_star_step_is_not_planned_into_the_next(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(components, "settled", lambda df, name: (sizes.append(df._jdf.queryExecution().analyzed().toString().count("Join")), settled(df, name))[1])
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    assert {r["root"] for r in components.components(chain).collect()} == {0}
    assert max(sizes) <= 2
