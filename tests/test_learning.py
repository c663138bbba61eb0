"""State learned in micro-batches is the state of one batch."""

import tempfile

import pytest
from quarryline.operators import resolve
from quarryline.operators.feed import feed
from quarryline.operators.product import widened_fan_out
from quarryline.streaming import learning
from quarryline.streaming.learning import Learned

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def streamed(spark):
    """The feed in five files, one a micro-batch, the later rows first."""
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    whole = feed(spark, SF).persist()
    for i in range(5):
        whole.where(f"(row_index DIV 7) % 5 = {4 - i}").coalesce(1).write.mode("append").parquet(f"{root}/feed")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/feed")
    query = learning.learn(stream, f"{root}/state", f"{root}/checkpoint", f"{root}/resolved")
    query.awaitTermination(600)
    assert query.exception() is None
    return whole, root


def test_five_batches_learn_what_one_does(spark, streamed):
    whole, root = streamed
    state, said = Learned(spark, f"{root}/state"), resolve.mentions(whole)
    assert state.versions() == [0, 1, 2, 3, 4]
    for got, want in ((state.manufacturers(), resolve.manufacturers(said)), (state.brands(), resolve.brands(said)), (state.owners(), resolve.owners(said))):
        assert rows(got) == rows(want.select(*got.columns))
    assert rows(state.manufacturers(widened=True).where("fan_out > 0").select("supplier_key", "fan_out", "distributor")) == rows(widened_fan_out(said))
    once = Learned(spark, f"{root}/once")
    once.absorb(whole, 0)
    assert rows(once.prefix_rules()) == rows(state.prefix_rules()) and state.prefix_rules().count() > 0
    assert rows(state.resolved(whole)) == rows(once.resolved(whole))


def test_a_replayed_batch_changes_nothing(spark, streamed):
    whole, root = streamed
    state = Learned(spark, f"{root}/state")
    before = [rows(state.table(t)) for t in learning.TABLES]
    state.absorb(whole, 3)
    assert [rows(state.table(t)) for t in learning.TABLES] == before and state.versions() == [0, 1, 2, 3, 4]


def test_batches_are_resolved_by_their_own_version(spark, streamed):
    whole, root = streamed
    state, first = Learned(spark, f"{root}/state"), spark.read.parquet(f"{root}/resolved/version=0")
    own = whole.join(first.select("row_index"), "row_index", "left_semi")
    assert rows(first) == rows(state.resolved(own, 0)) and 0 < first.count() < whole.count()
    assert spark.read.parquet(f"{root}/resolved").count() == whole.count()


def test_bases_hold_what_they_merged(spark, streamed, monkeypatch):
    whole, _ = streamed
    monkeypatch.setattr(learning, "COMPACT", 2)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    state = Learned(spark, f"{root}/state")
    assert state.manufacturers().isEmpty() and state.versions() == []
    for i in range(5):
        state.absorb(whole.where(f"row_index % 5 = {i}"), i)
    assert [v for v, base in state._log() if base] == [1, 3]
    said = resolve.mentions(whole)
    assert rows(state.manufacturers()) == rows(resolve.manufacturers(said).select(*state.manufacturers().columns))
    early = resolve.mentions(whole.where("row_index % 5 < 3"))
    assert rows(state.brands(2)) == rows(resolve.brands(early).select("brand_key", "name", "n_mentions"))
