"""Exact Jaccard links between all texts' sets of word shingles, by a token-group matrix.

Equal sets are one class from the start.  Similar classes are partitioned into groups of
bounded size, each group stores the union of its tokens, and a class as query opens a
group only if its overlap with that union can reach the threshold.

1. The first bound is against all other documents at once.  In the order of their hashes,
   two sets that link share ``margin`` tokens or more among the first few (``prefix``), so a
   class with fewer tokens there that any other class has is done.  Of those left, all tokens
   are counted: only a class most of whose tokens others have goes on.  Most texts, and
   those that share no more than a passage, end here.
2. The rest are grouped by the least token they share with others; a group with more than
   ``GROUP`` classes or ``TOKENS`` tokens is cut in parts.  Each part compares its own
   classes by counting common tokens, and one class stands for each local component when
   the parts of a group meet again, so a large family of near copies is soon one component.
3. The matrix: rarest tokens of each query meet the groups that have them.  A pair goes on
   if the group holds another component than the query's and sizes that fit; then the
   query's overlap with the group's union is counted, and qualifying groups are opened:
   every member in reach is held to the exact similarity.  What a query links with is given
   once a component.

No stage gathers more than a part of a group; counts by token are combined before they
travel, and the joins by token are of the kind Spark splits when a key is crowded.

Shingles are 64-bit hashes (XXH64, seed 42), sets are named by 64 bits more and their size.

Defined results: a null text or one without words has an empty set and links with nothing,
its component is its own doc_id; fewer words than a shingle make one shingle of all of
them; rows with equal sets are linked; a null doc_id is never a component's id unless all
are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, settled
from .components import components, told, with_lowest
from .sieve import Sieve
from .simhash import _roots, shingles
from .words import release

WIDTH, PERCENT = 5, 80
MARGIN = 10  # a tenth of a set
GROUP, TOKENS = 512, 1 << 20
COLUMNS = 4096
FOLDS = 8  # rounds in which parts of one group meet again, at most


def _named(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else 0


def _needed(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` must share with any it links with."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int = PERCENT) -> int:
    """How many tokens of a set of ``n``, in any fixed order, hold ``n / MARGIN`` of those it
    shares with a set it links with."""
    return n - _needed(n, percent) + max(1, n // MARGIN)


def margin(percent: int = PERCENT) -> Column:
    """Common tokens that the prefixes of a set of ``n`` and one it links with have at least:
    the share of the smallest set in reach."""
    return F.greatest(F.lit(1), F.floor(needed(percent) / MARGIN).cast("int"))


def needed(percent: int = PERCENT) -> Column:
    """Tokens that a set of ``n`` shares with any it links with, at least."""
    return F.expr(f"({percent} * n + 99) div 100").cast("int")


def _rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, text_key, class, n, task, tokens``: tokens are the prefix, once a class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        task = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [np.unique(shingles(t.as_py(), width)) for t in batch.column("text").cast(pa.large_binary())]
                names, first = [_named(s) for s in sets], []
                for name, s in zip(names, sets, strict=True):
                    new = len(s) > 0 and (name, len(s)) not in seen
                    seen.add((name, len(s)))
                    first.append(s[: prefix(len(s), percent)].view(np.int64) if new else None)
                columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(names, pa.int64()), pa.array(map(len, sets), pa.int32())]
                columns += [pa.array([task] * len(sets), pa.int32()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "class", "n", "task", "tokens"])
        release()

    return docs.mapInArrow(run, "doc_id long, text_key long, class long, n int, task int, tokens array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``class, set`` of every row: the sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                sets = [np.unique(shingles(t.as_py(), width)) for t in whole.column("text").slice(at, 1000).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([pa.array(map(_named, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "set"])
        release()

    return docs.select("text").mapInArrow(run, "class long, set binary")


def _each(sets: DataFrame) -> DataFrame:
    """``class, token`` of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                data = batch.column("set").to_pylist()
                names = np.repeat(batch.column("class").to_numpy(), [len(d) // 8 for d in data])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.frombuffer(b"".join(data), np.int64))], names=["class", "token"])

    return sets.select("class", "set").mapInArrow(run, "class long, token long")


def _shared(tokens: DataFrame) -> DataFrame:
    """``class, token, df`` of the tokens that several classes have."""
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select(F.col("token").alias("of"), "df")
    return tokens.join(often, F.col("token") == F.col("of")).select("class", "token", "df")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one part of a group after another; rows come sorted by ``group, part``."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[-1]["group"], held[-1]["part"]) != (row["group"], row["part"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share: products of their incidence with the tokens that
    two or more have, ``COLUMNS`` tokens at a time."""
    out = np.zeros((len(sets), len(sets)))
    owner, tokens = np.repeat(np.arange(len(sets)), list(map(len, sets))), np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owner, tokens = owner[order], tokens[order]
    _, column, often = np.unique(tokens, return_inverse=True, return_counts=True)
    kept = often[column] > 1
    owner, column = owner[kept], (np.cumsum(often > 1) - 1)[column[kept]]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        out += has @ has.T
    return out


def _grouped(percent: int, with_union: bool):
    """Local components of each part: ``class, root``, and the part's union on its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["class", "group", "part", "root", "tokens"])

        for rows in _whole(batches):
            sets = [_tokens(r["set"]) for r in rows]
            names = np.array([r["class"] for r in rows])
            root = np.arange(len(rows))
            if len(rows) > 1:
                both, sizes = common(sets), np.array(list(map(len, sets)))
                a, b = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes - both), 1))
                root = _roots(a, b, len(rows))
            union = np.unique(np.concatenate(sets) >> np.uint64(32)).astype(np.uint32).tobytes() if with_union else None
            made += [(int(n), r["group"], r["part"], int(names[k]), None if i else union) for i, (n, r, k) in enumerate(zip(names, rows, root, strict=True))]
            if len(made) > 2000 or union is not None and len(union) > 1 << 20:
                yield out()
                made = []
        if made:
            yield out()
        release()

    return run


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (class, n and ``group``) with ``part``: parts of ``GROUP`` rows and ``TOKENS`` tokens or so."""
    size = rows.groupBy(F.col(group).alias("_of")).agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / TOKENS)).cast("int").alias("parts"))
    return told(rows, size.withColumnRenamed("_of", group), group, "class").withColumn("part", F.pmod(F.xxhash64("class", "parts"), F.col("parts")).cast("int"))


def _compared(members: DataFrame, sets: DataFrame, percent: int, with_union: bool) -> DataFrame:
    met = members.select("class", "group", "part").join(sets, "class").select("group", "part", "class", "set")
    placed = met.repartition("group", "part").sortWithinPartitions("group", "part", "class")
    return placed.mapInArrow(_grouped(percent, with_union), "class long, group long, part int, root long, tokens binary")


def _bound(percent: int):
    """Queries of a group that its union may hold enough of, by the first halves of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            union, kept = np.frombuffer(rows[0]["set"], np.uint32), []
            for r in rows[1:]:
                asked = (_tokens(r["set"]) >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(union, asked), len(union) - 1)
                if (union[at] == asked).sum() >= _needed(max(r["n"], r["least"]), percent):
                    kept.append(r["class"])
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([rows[0]["target"]] * len(kept), pa.int64())], names=["class", "target"])
        release()

    return run


def _opened(percent: int):
    """Links of a group's queries with its members, one a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            inside = [r for r in rows if r["kind"] == 0]
            sets = [_tokens(r["set"]) for r in inside]
            sizes, comp = np.array(list(map(len, sets))), np.array([r["comp"] for r in inside])
            owner, tokens = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
            order = np.argsort(tokens, kind="stable")
            owner, tokens = owner[order], tokens[order]
            a, b = [], []
            for r in rows[len(inside) :]:
                asked = _tokens(r["set"])
                lo, hi = np.searchsorted(tokens, asked, "left"), np.searchsorted(tokens, asked, "right")
                n = hi - lo
                places = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(owner[places], minlength=len(sets))
                near = np.flatnonzero((100 * both >= percent * (len(asked) + sizes - both)) & (comp != r["comp"]))
                near = near[np.unique(comp[near], return_index=True)[1]]
                a += [r["class"]] * len(near)
                b += [inside[k]["class"] for k in near]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release()

    return run


def _met(queries: DataFrame, sets: DataFrame, inside: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each part of a group's queries (``target, class, comp, n, least``), with what
    ``sets`` has of them, behind what is ``inside`` the group (the same and ``set``)."""
    size = queries.groupBy("target").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / TOKENS)).cast("int").alias("parts"))
    asked = told(queries, size, "target", "class").withColumn("part", F.pmod(F.xxhash64("class", "parts"), F.col("parts")).cast("int")).join(sets, "class")
    offered = inside.join(size, "target").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["group", "part", "kind", "target", "class", "comp", "n", "least", "set"]
    both = [df.withColumn("kind", F.lit(k)).withColumn("group", F.col("target")).select(*columns) for k, df in enumerate((offered, asked))]
    placed = both[0].unionByName(both[1]).repartition("group", "part").sortWithinPartitions("group", "part", "kind", "class")
    return placed.mapInArrow(run, schema)


def _read(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: what ``_rows`` gives, and the same without tokens."""
    rows = settled(_rows(docs, width, percent), "rows")
    return rows, settled(rows.drop("task", "tokens"), "names")


def links(docs: DataFrame, rows: DataFrame, names: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``a, b``: links between classes that join what all pairs of ``percent`` or more join.

    The files of ``rows``, which only the first bound reads, are deleted after it.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_key", "doc_id"))
    told_ = rows.where("tokens IS NOT NULL").select("class", "task", "tokens")
    again = told_.groupBy("class").agg(F.min("task").alias("only"), F.count("*").alias("times")).where("times > 1")
    again = settled(again.select(F.col("class").alias("of"), "only", F.xxhash64("class").alias("key")), "copies")
    told_ = Sieve(again.select("key")).marked(told_, F.xxhash64("class"), "often")
    doubtful = told_.where("often").join(again, F.col("class") == F.col("of"), "left").where("only IS NULL OR only = task")
    once = told_.where("NOT often").select("class", "tokens").unionByName(doubtful.select("class", "tokens"))  # a class speaks in one task
    tokens = once.select("class", F.explode("tokens").alias("token"))
    some = _shared(tokens).groupBy("class").agg(F.count("*").alias("shared"))
    named = names.where("n > 0").groupBy("class").agg(first.alias("first"), F.first("n").alias("n"))
    asked = named.join(some, "class").where(F.col("shared") >= margin(percent))
    asked = settled(asked.select("class", "n", F.xxhash64("first.doc_id", "first.text_key").alias("key")), "some-shared")
    discarded(rows)

    texts = Sieve(asked.select("key")).passed(docs, F.xxhash64("doc_id", "text_key"))  # texts themselves are not shuffled
    sets = settled(_sets(texts, width).join(asked.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")
    held = _shared(_each(sets)).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))  # a text's own tokens
    held = held.join(asked.select("class", "n"), "class").where(F.size("shared") >= needed(percent))
    rarest = F.slice("shared", 1, F.greatest(F.size("shared") - needed(percent) + 1, F.lit(1)))
    least = F.array_min(F.transform("shared", lambda s: s["token"]))
    asked = settled(held.select("class", "n", least.alias("group"), F.transform(rarest, lambda s: s["token"]).alias("rare")), "asked")

    dealt = settled(_dealt(asked.select("class", "n", "group"), "group"), "dealt")
    local = settled(_compared(dealt, sets, percent, True), "groups")
    found = local.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b"))
    still = dealt.where("parts > 1").select("class", "n", "group").join(local.where("class = root").select("class"), "class", "left_semi")
    before = None
    for _ in range(FOLDS):
        n = still.count()
        if not n or before is not None and 2 * n > before:
            break
        before = n
        again = settled(_dealt(still, "group"), "dealt")
        met = settled(_compared(again, sets, percent, False), "folded")
        found = found.unionByName(met.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
        still = again.where("parts > 1").select("class", "n", "group").join(met.where("class = root").select("class"), "class", "left_semi")
    found = settled(found, "found")

    comp = components(found).withColumnRenamed("root", "_comp")
    placed = local.select("class", F.xxhash64("group", "part").alias("home"))
    known = asked.select("class", "n", "rare").join(placed, "class").join(comp, F.col("class") == F.col("node"), "left").select("class", "n", "rare", "home", F.coalesce("_comp", "class").alias("comp"))
    known = settled(known, "known")
    cells = known.select("class", "n", "home", "comp", F.explode("rare").alias("token"))
    mixed = cells.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("token").alias("of"))
    cells = settled(cells.join(mixed, F.col("token") == F.col("of"), "left_semi"), "cells")
    matrix = cells.groupBy("token", "home").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    matrix = matrix.select(F.col("token").alias("of"), F.col("home").alias("target"), "least", "most", "lo", "hi")
    reach = (F.col("home") < F.col("target")) & ((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))) & (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    pairs = settled(cells.join(matrix, (F.col("token") == F.col("of")) & reach).select("class", "comp", "n", "target").distinct(), "pairs")
    if pairs.isEmpty():
        discarded(sets)
        return found

    least = known.groupBy(F.col("home").alias("target")).agg(F.min("n").alias("least"))
    unions = local.where("tokens IS NOT NULL").select(F.xxhash64("group", "part").alias("target"), F.col("tokens").alias("set"))
    unions = unions.join(pairs.select("target").distinct(), "target", "left_semi").withColumns({"class": F.lit(0).cast("long"), "comp": F.lit(0).cast("long"), "n": F.lit(0), "least": F.lit(0)})
    open_ = settled(_met(settled(pairs.join(least, "target"), "bounded"), sets, unions, _bound(percent), "class long, target long"), "qualifying")
    members = known.select(F.col("home").alias("target"), "class", "comp", "n").join(open_.select("target").distinct(), "target", "left_semi").join(sets, "class").withColumn("least", F.lit(0))
    queries = open_.join(known.select("class", "comp", "n"), "class").withColumn("least", F.lit(0))
    opened = settled(_met(queries, sets, members, _opened(percent), "a long, b long"), "opened")
    discarded(sets)
    return found.unionByName(opened)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` of every row: the smallest doc_id reachable
    over pairs whose shared shingles are ``percent`` of a hundred of their union or more."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    rows, names = _read(docs, width, percent)
    found = links(docs, rows, names, width, percent)
    classes = settled(names.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")), "classes")
    linked = settled(classes.join(components(found), F.col("class") == F.col("node")).select("class", "least", "root"), "linked")
    linked = with_lowest(linked, "root", "class", "least", "lowest").select(F.col("class").alias("of"), "lowest")
    named = classes.join(linked, F.col("class") == F.col("of"), "left").select("class", F.coalesce("lowest", "least").alias("component_id"))
    full = told(names.where("n > 0").select("doc_id", "text_key", "n", "class"), named, "class", "doc_id")
    out = ("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.select(*out).unionByName(names.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*out))


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, component_id, component_text`` of every row, by the links of
    ``jaccard_components``: besides the smallest doc_id reachable the XXH64 of the text that
    stands for the component (one that has this doc_id); texts without words are one component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    rows, names = _read(docs, width, percent)
    found = links(docs, rows, names, width, percent)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_key", "doc_id"))
    classes = settled(names.groupBy("class").agg(first.alias("first")), "classes")
    linked = settled(classes.join(components(found), F.col("class") == F.col("node")).select("class", "first", "root"), "linked")
    linked = with_lowest(linked, "root", "class", "first", "lowest").select(F.col("class").alias("of"), "lowest")
    named = classes.join(linked, F.col("class") == F.col("of"), "left").select("class", F.coalesce("lowest", "first").alias("lowest"))
    named = named.select("class", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.text_key").alias("component_text"))
    return told(names.select("doc_id", "text_key", "class"), named, "class", "doc_id").select("doc_id", "text_key", "component_id", "component_text")


def op11_jaccard_join(spark, sf_dir):
    """Links of five-word shingles at a similarity of 0.8 or more among all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_key")


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, md5(array_to_string(list_sort(g), chr(0))) AS h, g FROM (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d)),
c AS MATERIALIZED (SELECT min(r) AS c, h, any_value(g) AS g, CAST(len(any_value(g)) AS BIGINT) AS n, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY h),
t AS MATERIALIZED (SELECT c, n, hash(t) AS t FROM (SELECT c, n, unnest(g) AS t FROM c)),
p AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
w AS (SELECT c AS node, c AS root FROM c UNION SELECT p.b, w.root FROM w JOIN p ON p.a = w.node),
k AS (SELECT node, min(least) AS component_id FROM w JOIN c ON c.c = w.root GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s LEFT JOIN c ON s.h = c.h LEFT JOIN k ON k.node = c.c
"""
