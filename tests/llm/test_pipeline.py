"""The corpus pipeline, each stage against a plain version of it on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from quarryline.llm import mixing, pieces, quality
from quarryline.llm.common import settled

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(settled(stage(spark, tables[-1], SF), name))
    return tables


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "tokens"]
    assert all(t.columns == stages[0].columns for t in stages[:-1])


def test_quality_stage(spark, stages):
    kept = quality.judge(stages[0].select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
    assert {r["doc_id"] for r in kept.collect()} == set(rows(stages[1]))


def test_near_dedup_stage(stages):
    sets = {}
    for i, r in rows(stages[1]).items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = {i: i for i in sets}
    for _ in range(8):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert set(rows(stages[2])) == {i for i in sets if root[i] == i}


def test_near_dedup_of_several_texts_under_one_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    given = [(1, texts[0]), (2, texts[1]), (2, texts[0] + " end"), (3, texts[2]), (3, texts[2]), (4, texts[1])]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], schema)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, df, SF).collect())
    assert got == Counter([(1, texts[0]), (2, texts[1]), (3, texts[2])])


def test_substring_stage(stages):
    given, got, first = rows(stages[2]), rows(stages[3]), {}
    words = {i: WORD.findall(given[i]["text"]) for i in sorted(given)}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        if w and len(gone) == len(w):
            assert i not in got
        else:
            assert got[i]["text"] == (" ".join(x for p, x in enumerate(w) if p not in gone) if gone else given[i]["text"])


def test_mixing_stage(stages):
    taken = rows(mixing.mix(stages[3].select("doc_id", "source", "text")))
    wanted = Counter({i: int(r["taken"] / r["size"] + 0.5) for i, r in taken.items() if r["size"]})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == +wanted


def test_tokens_stage(stages):
    s, given = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), rows(stages[4])
    out = stages[5].collect()
    assert len(out) == stages[4].count()
    assert all(r["ids"] == s.encode(given[r["doc_id"]]["text"]) for r in out)


def test_awkward_documents(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (None, "a", "en", None, 1), (1, "", "en", "s", 0), (1, " ".join(map(str, range(40))), "en", "s", 5), (1, " ".join(map(str, range(40))), "en", "s", 5)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, df, SF).count() >= 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).isEmpty()


def test_near_dedup_finds_similar_texts(spark):
    """Pairs planted at five-word similarities of 0.8 to 0.95 are found, those below 0.8 are not."""
    rng = random.Random(7)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    texts, wanted = {}, set()
    for i in range(0, 600, 2):
        w = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(150, 400))]
        v = list(w)
        for k in rng.sample(range(len(v)), rng.randrange(1, max(2, len(v) // 30))):
            v[k] = f"x{rng.randrange(50_000)}"
        a, b = grams(w), grams(v)
        alike = len(a & b) / len(a | b)
        texts |= {i: " ".join(w), i + 1: " ".join(v)}
        wanted |= {i} if alike >= 0.8 else {i, i + 1}
    big = [f"b{k}" for k in range(300)]  # a group too large for all its pairs
    for i in range(600, 700):
        v = list(big)
        v[(i * 7) % 300] = f"y{i}"
        texts[i] = " ".join(v)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert 50 < len(wanted) - 300 < 250  # pairs of both kinds
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, SF).collect()} == wanted | {600}


def test_near_dedup_loses_no_pair_at_the_threshold(spark):
    """Pairs at exactly 0.8 that no MinHash band has in common."""
    texts = {}
    for s in (33778, 37613, 38471):
        w = [f"w{s}x{k}" for k in range(14)]
        texts |= {2 * s: " ".join(w[:13]), 2 * s + 1: " ".join(w[1:])}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, SF).collect()} == {i for i in texts if i % 2 == 0}
