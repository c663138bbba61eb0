"""Fuzzy matching of names: an exact filter proposes pairs, word-set similarity decides.

The score is 100 where one name's words hold the other's, else the best of three ratios
of characters in common (``token_set_ratio``), in which common words come first.  With
``r`` for the floor, ``L`` and ``R`` for the lengths of the two names' distinct words, a
pair can only reach it if

* the words both have make up most of one of the names, so among that name's rarest
  words, up to the share that may be missing, one is shared; or
* the names, common words first, have ``c = ceil(r (L + R) / 2)`` characters in sequence in
  common.  One comes from the other by ``L - c`` deletions and ``R - c`` insertions, which break
  two and one of its pairs of neighbouring characters, blanks at the ends of words included.
  These pairs are the same in whatever order the words stand, so both names share
  ``3 c - L - R + 1`` of them or more, and the ``t`` rarest shared ones are among each one's
  rarest pairs, as many as may be missing and ``t`` more.

The first is a join on rare words; the second one on two rare pairs of characters at once, and
where two bring too many names together, on a third with them, and so on, as long as that
splits them.  Then the shared ones are counted.  Neither loses a pair at or above the floor, and as a rival decides within a
margin, the floor of the filter lies that much lower.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, token_set_ratio
from ..storage import discarded, settled

EPS = 1e-9
CROWD = 8  # a key is lengthened if it makes more pairs of names than this, for each name that has it,
SPLIT = 0.75  # unless its last pair of characters left more than this of what met without it


def _words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")))


def _length(c: Column) -> Column:
    return F.length(F.array_join(_words(c), " "))


def _pairs(c: Column) -> Column:
    """Neighbouring characters of the distinct words, a blank around each; the n-th of equal ones is its own."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(2)))
    return once(F.array_sort(F.flatten(F.transform(_words(c), of))), lambda every: F.transform(every, lambda g, i: F.concat(g, (i - F.array_position(every, g)).cast("string"))))


def _rarest_words(names: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """``name, key`` of the rarest words, until their characters before reach the share that may be missing."""
    each = names.select("name", F.explode(_words(F.col("name"))).alias("key")).join(counts, "key")
    order = Window.partitionBy("name").orderBy("n", "key")  # a name's own words
    before = F.coalesce(F.sum(F.length("key") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("before", before).where(F.col("before") <= _length(F.col("name")) * share + EPS).select("name", "key")


def _shared(total: Column, r: float) -> Column:
    """``3 c - L - R + 1`` of ``L + R``."""
    return 3 * F.ceil(r * total / 2 - EPS) - total + 1


def _in_order(left: DataFrame, right: DataFrame) -> DataFrame:
    """``known, name, length, pairs`` of the names of both sides: the pairs of characters that both sides have, as
    ``number`` and the ``lengths`` of names of the other side that have it, those that bring the fewest names together first."""
    sides = left.select(F.lit(False).alias("known"), "name").unionByName(right.select(F.lit(True).alias("known"), "name"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(sides.repartition(n).select("known", "name", _length(F.col("name")).alias("length"), _pairs(F.col("name")).alias("pairs")), "cut")
    each = cut.select("known", "name", "length", F.explode("pairs").alias("pair"))
    asked, known = F.when(~F.col("known"), F.col("length")), F.when(F.col("known"), F.col("length"))
    counts = each.groupBy("pair").agg(F.count(asked).alias("a"), F.count(known).alias("b"), F.collect_set(asked).alias("asked"), F.collect_set(known).alias("names")).where("a > 0 AND b > 0")
    numbers = settled(counts.orderBy(F.col("a") * F.col("b"), "pair").select("pair", F.monotonically_increasing_id().alias("number"), "asked", "names"), "pairs")
    one = F.struct("number", F.when(F.col("known"), F.col("asked")).otherwise(F.col("names")).alias("lengths"))
    return each.join(numbers, "pair").groupBy("known", "name", "length").agg(F.array_sort(F.collect_list(one)).alias("pairs"))


def _longer(rows: DataFrame, t: int) -> DataFrame:
    """Rows whose keys have ``t - 1`` pairs, with each further pair that can be the ``t``-th rarest shared one."""
    rest = F.slice("pairs", F.col("at") + 1, F.col("missing") + t - F.col("at"))
    more = F.transform(rest, lambda p, i: F.struct(F.xxhash64("key", p).alias("key"), (F.col("at") + i + 1).alias("at")))
    return rows.select("known", "name", "pairs", "missing", "shared", "met", F.explode(more).alias("k")).select("known", "name", "pairs", "missing", "shared", "met", "k.key", "k.at")


def _by_pairs(left: DataFrame, right: DataFrame, r: float) -> DataFrame:
    """``asked, name`` that share as many pairs of characters as the floor asks for.

    Two lengths tell how many that are.  Two names are met under their rarest shared pairs: two, or as
    many more as make a key that is no crowd, but no more than they must share."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other, length = F.col("other"), F.col("length")
    reach = (other >= F.ceil(length * (r / (2 - r)) - EPS)) & (other <= F.floor(length * ((2 - r) / r) + EPS))
    names = _in_order(left, right).withColumn("other", F.explode(F.array_distinct(F.flatten("pairs.lengths")))).where(reach)
    mine = F.transform(F.filter("pairs", lambda p: F.array_contains(p["lengths"], F.col("other"))), lambda p: p["number"])
    names = names.select("known", "name", mine.alias("pairs"), _shared(length + other, r).cast("int").alias("shared"), F.xxhash64(F.when(F.col("known"), other).otherwise(length), F.when(F.col("known"), length).otherwise(other)).alias("key"))
    names = names.withColumns({"missing": F.size("pairs") - F.col("shared"), "at": F.lit(0), "met": F.lit(None).cast("long")}).where("missing >= 0")
    rows, same, found, spent, t = _longer(_longer(names, 1), 2), Window.partitionBy("key"), [], None, 2
    while True:
        a, b = F.count_if(~F.col("known")).over(same), F.count_if("known").over(same)
        split = F.coalesce(F.col("a") * F.col("b") <= SPLIT * F.max("met").over(same), F.lit(True))
        crowd = (F.min("shared").over(same) > t) & (F.col("a") * F.col("b") > CROWD * (F.col("a") + F.col("b"))) & split
        rows = rows.withColumns({"a": a, "b": b}).withColumn("crowd", crowd).where("a > 0 AND b > 0").withColumn("met", F.col("a") * F.col("b")).drop("a", "b")
        rows = settled(rows, "keys")
        if spent is not None:
            discarded(spent)
        x = rows.where("NOT crowd AND NOT known").select("key", F.col("name").alias("asked"), F.col("pairs").alias("p"), "at", "shared")
        y = rows.where("NOT crowd AND known").select("key", "name", F.col("pairs").alias("q"))
        both = x.repartition(n, "key").join(y.repartition(n, "key"), "key").withColumn("both", F.array_intersect("p", "q"))
        here = F.get("both", F.lit(t - 1)) == F.get("p", F.col("at") - 1)  # its rarest shared ones are this key
        found.append(settled(both.where((F.size("both") >= F.col("shared")) & here).select("asked", "name"), "near"))
        spent, rows = rows, rows.where("crowd")
        if rows.isEmpty():
            break
        t += 1
        rows = _longer(rows, t)
    discarded(spent)
    return reduce(DataFrame.unionByName, found)


def plausible(asked: DataFrame, known: DataFrame, floor: float) -> DataFrame:
    """``asked, name``: all pairs that may score ``floor`` or more, and some more."""
    r = floor / 100.0
    if not 2 / 3 < r <= 1:
        raise ValueError("the filter holds for floors above 200/3")
    every = asked.select(F.col("asked").alias("name")).unionByName(known.select("name")).distinct()
    left, right = asked.select(F.col("asked").alias("name")).distinct(), known.select("name").distinct()

    words = every.select(F.explode(_words(F.col("name"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    few = lambda df: _rarest_words(df, words, 2 * (1 - r) / (2 - r))
    all_words = lambda df: df.select("name", F.explode(_words(F.col("name"))).alias("key"))
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # keys are few bytes, but what they meet is many rows
    met = lambda a, b: a.select(F.col("name").alias("asked"), "key").repartition(n, "key").join(b.repartition(n, "key"), "key").select("asked", "name").distinct()
    by_words = met(few(left), all_words(right)).unionByName(met(all_words(left), few(right)))
    return by_words.unionByName(_by_pairs(left, right, r)).distinct().repartition(n)


def matched(asked: DataFrame, known: DataFrame, floor: float = 88.0, margin: float = 4.0) -> DataFrame:
    """``asked, name, score, verdict`` of every distinct ``asked``: the best known name, and
    whether it is sure (``fuzzy``), has a rival within ``margin`` (``ambiguous``), or none
    reaches the floor (``unresolved``, no name).  Ties go to the smaller name.

    The filter proposes the fewer pairs the higher its floor, so it begins high.  A name is done
    once its best and a rival are found, or a best so good that rivals below the filter's
    floor are out of the margin; only the others are asked again, a margin lower."""
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # names are few bytes, but much work
    left, known = settled(asked.select("asked").distinct().repartition(n), "asked"), settled(known.select("name").distinct().repartition(n), "known")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "name")
    lead, last = F.col("score") - F.coalesce("next", F.lit(0.0)), floor - margin
    levels = [last]
    while margin > 0 and levels[-1] + margin <= 100 - 2 * margin:
        levels.append(levels[-1] + margin)
    out = []
    for level in reversed(levels):
        if out and left.isEmpty():
            break
        scored = settled(plausible(left, known, level).withColumn("score", token_set_ratio("asked", "name")), "scored")  # or filters would score pairs anew
        ranked = scored.where(F.col("score") >= level).withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
        top = settled(left.join(ranked.where("rank = 1").drop("rank"), "asked", "left"), "top")
        discarded(scored)
        done = F.lit(True) if level == last else F.coalesce((F.col("score") - margin >= level) | (lead < margin), F.lit(False))
        out.append(top.where(done))
        left = top.where(~done).select("asked")
    whole = reduce(DataFrame.unionByName, out)
    reached = F.col("score") >= floor
    verdict = F.when(reached & (lead >= margin), "fuzzy").when(reached, "ambiguous").otherwise("unresolved")
    return whole.select("asked", F.when(reached, F.col("name")).alias("name"), F.when(reached, F.col("score")).alias("score"), verdict.alias("verdict"))
