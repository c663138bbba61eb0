"""Mixing sources to target weights by a low-discrepancy schedule.

Every source lies as a line of words, its documents in a shuffled order that
depends on their ids and texts alone, cut into blocks of equal numbers of words: a
``SHARE``-th of the source's own target, from one word to ``LONGEST``.  Its target is
then a number of blocks, to the nearest, and that many slots are its own.  Slot i of the
schedule takes the i-th van der Corput point among as many points as the next power of
two: each whole number below that comes once, so the point's place among the cumulative
slots names a source, exactly as often as it has slots (points beyond the last take
nothing), and evenly over any stretch.  The slot's rank among its source's names the block,
the line starting over when it ends.  What the mix takes is what the slots play: for every
source, however small, its target to half a block.

Ranks and offsets are prefix sums in two steps (sums of bounded buckets first),
so a source with a third of all rows is never one group.

Defined results: a null or empty text has size 0 and is never taken; a null source
is a source of its own, after the others; rows that are repeated are documents of
their own; an empty table gives no rows; if all sizes are 0, so are the targets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settled

SHARE, LONGEST = 256, 1024
WEIGHTS = (1, 2, 3)
MOST = 3
SLOT_RUN = 1 << 16
GRID = 4096


def in_blocks(goal: DataFrame, most: int = MOST, block_words: int | None = None) -> DataFrame:
    """``goal`` with ``block`` (words), ``nb`` (blocks of the line) and ``quota`` (slots) of each source."""
    block = F.lit(block_words) if block_words else F.greatest(F.lit(1), F.least(F.lit(LONGEST), F.floor(F.col("target") / SHARE)))
    rounds = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    goal = goal.withColumn("block", block.cast("long")).withColumn("nb", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = rounds * F.col("nb") + F.floor((F.col("target") - rounds * F.col("source_size")) / F.col("block") + 0.5)
    return goal.withColumn("quota", F.least(slots, most * F.col("nb")).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per document with its size.

    Shares by weight; a source stops at ``most`` times its size and what it leaves
    is shared anew by weight among the rest.  Works on a row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    named = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("place", rank).withColumn("weight", named.cast("long")).withColumn("most", most * F.col("source_size"))
    up = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("place"))
    left = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double")
    weight = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("left", left).withColumn("rest", weight)
    share = F.col("left") * F.col("weight") / F.col("rest")
    free = F.when(share <= F.col("most"), F.struct("left", "rest"))
    level = F.first(free, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", level)
    held = F.col("level")["left"] * F.col("weight") / F.col("level")["rest"]
    return by.select("source", "place", "source_size", F.least(F.col("most").cast("double"), F.coalesce(held, F.col("most").cast("double"))).alias("target"))


def _after(df: DataFrame, keys: list[str], levels: list[str], value: Column, order: list[Column], name: str) -> DataFrame:
    """Sum of ``value`` over the rows before, by ``keys``: ordered by the levels, then ``order``.

    Rows are summed by the finest buckets first, and these by the coarser ones, so no window
    holds more than a level's buckets or a finest bucket's rows.
    """
    every = [*keys, *levels]
    sums = df.groupBy(*[F.col(k).alias(f"_{k}") for k in every]).agg(F.sum(value).alias("_sum"))
    ahead = None
    for depth in range(len(levels), 0, -1):
        of = [f"_{k}" for k in [*keys, *levels[: depth - 1]]]
        own = f"_{levels[depth - 1]}"
        by = sums.groupBy(*of, own).agg(F.sum("_sum").alias("_sum")) if depth < len(levels) else sums
        before = Window.partitionBy(*of).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        by = by.withColumn(f"_ahead{depth}", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
        if ahead is None:
            ahead = by
        else:
            renamed = by.select(*[F.col(c).alias(f"{c}_") for c in [*of, own]], f"_ahead{depth}")
            ahead = ahead.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*of, own]])).drop(*[f"{c}_" for c in [*of, own]])
    own = Window.partitionBy(*every).orderBy(*order)
    df = df.withColumn("_own", F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = df.join(ahead, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in every]))
    total = reduce(lambda a, b: a + b, [F.col(f"_ahead{d}") for d in range(1, len(levels) + 1)], F.col("_own"))
    return joined.withColumn(name, total.cast("long")).drop("_own", *[f"_ahead{d}" for d in range(1, len(levels) + 1)], *[f"_{k}" for k in every])


def van_der_corput(i: Column) -> Column:
    """Point i of the base-2 sequence, in [0, 1): the bits of i behind the point, reversed."""
    return F.conv(F.rpad(F.reverse(F.bin(i)), 48, "0"), 2, 10).cast("double") / F.lit(float(1 << 48))


def schedule(goal: DataFrame, total: int) -> DataFrame:
    """``place, rank, slot``: which source each slot takes and how often it came before.

    ``goal`` has a row per source (``place, quota``: its slots); ``total`` is the sum of quotas.
    """
    spark = goal.sparkSession
    upto = Window.orderBy("place")
    bounds = goal.select("place", (F.sum("quota").over(upto) - F.col("quota")).alias("lo"), F.sum("quota").over(upto).alias("hi"))
    of = lambda c: F.floor(F.col(c) / F.lit(float(max(total, 1))) * GRID)
    cells = bounds.where("hi > lo").withColumn("cell", F.explode(F.sequence(of("lo"), of("hi"))))
    points = 1 << max(total - 1, 0).bit_length() if total else 0
    parts = max(spark.sparkContext.defaultParallelism, points >> 22)
    slots = spark.range(0, points, 1, parts).select(F.col("id").alias("slot"), F.floor(van_der_corput(F.col("id")) * float(points)).alias("at")).where(F.col("at") < total)
    taken = slots.withColumn("cell", of("at")).join(cells, "cell").where("at >= lo AND at < hi").select("slot", "place", F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    return _after(taken, ["place"], ["run"], F.lit(1), [F.col("slot")], "rank").select("place", "rank", "slot")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text) as ``doc_id, size, source_size, target, taken,
    n_slots, first_slot, text_key``.

    ``taken`` counts the words the mix takes of a document, repeats included; ``n_slots``
    are the slots that play some of it, ``first_slot`` the first one (null: none);
    ``text_key`` is the text's XXH64, to find the row again.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    line = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"), F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))).alias("shuffled"))
    line = settled(line.withColumns({"part": F.substring("shuffled", 1, 2), "bucket": F.substring("shuffled", 1, 4)}), "sizes")
    goal = settled(in_blocks(targets(line, weights, most), most, block_words), "goal")
    total = goal.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    played = schedule(goal, total).join(goal.select("place", "nb"), "place").where(F.col("rank") < most * F.col("nb"))
    blocks = played.groupBy("place", (F.col("rank") % F.col("nb")).cast("long").alias("block")).agg(F.count("*").alias("plays"), F.min("slot").alias("slot"))

    order = [F.col("shuffled"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    some = line.where("size > 0")
    placed = _after(some, ["source"], ["part", "bucket"], F.col("size"), order, "start")
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*order)))
    named = goal.select(F.col("source").alias("s"), "place", "source_size", "target", F.col("block").alias("long"))
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source", "shuffled")
    end = F.col("start") + F.col("size")
    over = F.sequence(F.expr("start div long"), F.expr("(start + size - 1) div long"))
    pieces = placed.select("*", F.explode(over).alias("block"))
    met = pieces.join(blocks, ["place", "block"], "left")
    words = F.least(end - F.col("block") * F.col("long"), F.col("long")) - F.greatest(F.col("start") - F.col("block") * F.col("long"), F.lit(0))
    keys = ["place", "bucket", "nth", "doc_id", "size", "source_size", "target", "text_key"]
    out = ["doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot", "text_key"]
    plays = F.coalesce("plays", F.lit(0))
    full = met.groupBy(*keys).agg(F.sum(plays * words).cast("long").alias("taken"), F.sum(plays).cast("long").alias("n_slots"), F.min("slot").alias("first_slot")).select(*out)
    bare = line.where("size = 0").join(named, F.col("source").eqNullSafe(F.col("s"))).withColumns({"taken": F.lit(0).cast("long"), "n_slots": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}).select(*out)
    return full.unionByName(bare)


def op7_mix_sources(spark, sf_dir):
    """All documents mixed to the weights 1, 2, 3, none above three times its size."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("text_key")


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS shuffled FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, {MOST} * source_size AS most FROM s),
v AS (SELECT *, (place - 1) % {len(WEIGHTS)} + 1 AS weight FROM w),
u AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (
                  ORDER BY most / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS l,
             CAST(sum(weight) OVER (ORDER BY most / CAST(weight AS DOUBLE), place
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS r,
             row_number() OVER (ORDER BY most / CAST(weight AS DOUBLE), place) AS nth FROM v),
f AS (SELECT l, r FROM u WHERE l * weight / r <= most ORDER BY nth LIMIT 1),
g AS (SELECT source, place, source_size, least(CAST(most AS DOUBLE), coalesce((SELECT l FROM f) * weight / (SELECT r FROM f), CAST(most AS DOUBLE))) AS target FROM v),
z AS (SELECT *, CAST(greatest(1, least({LONGEST}, floor(target / {SHARE}))) AS BIGINT) AS bw, floor(target / greatest(source_size, 1)) AS rounds FROM g),
y AS (SELECT *, CAST(ceil(source_size / CAST(bw AS DOUBLE)) AS BIGINT) AS nb FROM z),
q AS (SELECT *, CAST(least(rounds * nb + floor((target - rounds * source_size) / bw + 0.5), {MOST} * nb) AS BIGINT) AS quota FROM y),
t AS (SELECT total, CASE WHEN total = 0 THEN 0 ELSE CAST(pow(2, ceil(log2(total))) AS BIGINT) END AS points FROM (SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS total FROM q)),
h AS (SELECT q.*, CAST(sum(quota) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM q),
i AS (SELECT slot, CAST(list_sum(list_transform(range(0, 48), lambda k: CAST((slot >> k) & 1 AS DOUBLE) / pow(2e0, k + 1))) * points AS BIGINT) AS spot
      FROM t, (SELECT unnest(range(0, points)) AS slot FROM t) x),
j AS (SELECT place, nb, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM i JOIN h ON spot < hi AND spot >= hi - quota),
k AS (SELECT place, rank % nb AS block, count(*) AS plays, min(slot) AS slot FROM j WHERE rank < {MOST} * nb GROUP BY 1, 2),
p AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.place, bw, row_number() OVER () AS id,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
o AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // bw, (start + size - 1) // bw + 1) ELSE [-1] END) AS block FROM p)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN block < 0 THEN 0 ELSE coalesce(plays, 0) * (least(start + size - block * bw, bw) - greatest(start - block * bw, 0)) END) AS BIGINT) AS taken,
       CAST(sum(coalesce(plays, 0)) AS BIGINT) AS n_slots, min(slot) AS first_slot
FROM o LEFT JOIN k USING (place, block) GROUP BY id, doc_id, size, source_size, target
"""
