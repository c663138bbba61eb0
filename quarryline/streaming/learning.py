"""What the engine learns from a feed, kept across micro-batches.

A batch is summed up in tables that merge by key: suppliers (first spelling, first code,
rows), brands (first spelling, mentions), the two seen together (in brand columns or only
named in descriptions) and prefixes of part numbers.  "First" goes by row index, so batches may
come in any order and the masters of any cut into batches are those of one batch.

Each batch's summary is one version of the state, written under its batch id: a batch that is
replayed after a failure overwrites its own version with the same rows and changes nothing.
The newest versions are read beside the last ``base``, in which every ``COMPACT`` versions
are merged, so a batch writes as much as it has and a read opens few files.  Snapshots are by
version: a batch is resolved by what was known when it came, whatever comes later.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import alpha_prefix, match_key
from ..operators import resolve
from ..operators.mentions import best
from ..packs import OWN, Pack, aliases

COMPACT = 16
TABLES = {
    "suppliers": ["supplier_key"],
    "brands": ["brand_key"],
    "pairs": ["brand_key", "supplier_key", "listed"],
    "prefixes": ["prefix", "brand_key", "supplier_key"],
}


def summed(rows: DataFrame, pack: Pack = OWN) -> dict[str, DataFrame]:
    """The state tables of some rows (``resolve.mentions``)."""
    named = rows.where("supplier_key IS NOT NULL")
    said = F.struct(F.col("row_index").alias("at"), F.col("supplier").alias("value"))
    coded = F.when(F.col("code").isNotNull(), F.struct(F.col("row_index").alias("at"), F.col("code").alias("value")))
    listed = resolve.brand_rows(rows)
    spelt = F.struct(F.struct("row_index", "nth").alias("at"), F.col("brand").alias("value"))
    both = listed.where("supplier_key IS NOT NULL").select("brand_key", "supplier_key", F.lit(True).alias("listed"), "row_index")
    told = best(rows, aliases(rows.sparkSession, pack)).select("row_index", match_key(F.col("brand")).alias("brand_key"))
    both = both.unionByName(named.select("row_index", "supplier_key").join(told, "row_index").select("brand_key", "supplier_key", F.lit(False).alias("listed"), "row_index"))
    first = rows.select("supplier_key", match_key(F.get("brands", F.lit(0))["brand"]).alias("brand_key"), "Mfg_Part_Num").where("brand_key IS NOT NULL")
    cut = first.select("brand_key", "supplier_key", "Mfg_Part_Num", F.explode(F.array(*[alpha_prefix(F.col("Mfg_Part_Num"), n) for n in (5, 4, 3)])).alias("prefix")).where("prefix IS NOT NULL")
    return {
        "suppliers": named.groupBy("supplier_key").agg(F.min(said).alias("name"), F.min(coded).alias("code"), F.count("*").alias("n")),
        "brands": listed.groupBy("brand_key").agg(F.min(spelt).alias("name"), F.count("*").alias("n")),
        "pairs": both.groupBy("brand_key", "supplier_key", "listed").agg(F.min("row_index").alias("first_row"), F.count("*").alias("n")),
        "prefixes": cut.groupBy("prefix", "brand_key", "supplier_key").agg(F.min("Mfg_Part_Num").alias("first_part"), F.count("*").alias("n")),
    }


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of several batches as one: numbers add up, all else is the least there is."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[(F.sum if c == "n" else F.min)(c).alias(c) for c in rest])


class Learned:
    """The state under ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, pack: Pack = OWN):
        self.spark, self.path, self.pack = spark, path.rstrip("/"), pack

    def _log(self) -> list[tuple[int, bool]]:
        """Versions that are whole, and whether a base was made of them."""
        try:
            return sorted((r["version"], r["base"]) for r in self.spark.read.parquet(f"{self.path}/log/*").distinct().collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # nothing learned yet

    def versions(self) -> list[int]:
        return sorted({v for v, base in self._log() if not base})

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        """A state table as of version ``upto``, the newest if none is given."""
        log = [(v, b) for v, b in self._log() if upto is None or v <= upto]
        base = max((v for v, b in log if b), default=None)
        paths = [f"{self.path}/base/{base}/{name}"] if base is not None else []
        paths += [f"{self.path}/batch/{v}/{name}" for v, b in log if not b and (base is None or v > base)]
        if not paths:
            return summed(resolve.mentions(self.spark.createDataFrame([], _FEED)), self.pack)[name]
        return merged(self.spark.read.parquet(*paths), TABLES[name])

    def _write(self, tables: dict[str, DataFrame], kind: str, version: int) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{kind}/{version}/{name}")
        done = self.spark.createDataFrame([(version, kind == "base")], "version long, base boolean")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{kind}-{version}")  # last: from here on it counts

    def absorb(self, feed: DataFrame, version: int) -> None:
        """Learn from one batch of the feed; a version known already is left as it is."""
        log = self._log()
        if (version, False) in log:
            return
        if any(b and v >= version for v, b in log):
            raise ValueError(f"version {version} comes after a base that has merged up to {max(v for v, b in log if b)}")
        rows = resolve.mentions(feed).persist()
        try:
            self._write(summed(rows, self.pack), "batch", version)
        finally:
            rows.unpersist()
        since = max((v for v, b in log if b), default=-1)
        if sum(v > since for v, b in log if not b) + 1 >= COMPACT:
            self._write({name: self.table(name) for name in TABLES}, "base", version)

    # --- masters ------------------------------------------------------------------

    def manufacturers(self, upto: int | None = None, widened: bool = False) -> DataFrame:
        """As ``resolve.manufacturers``; ``widened`` counts brands named in descriptions too."""
        base = self.table("suppliers", upto).select("supplier_key", F.col("name.value").alias("name"), F.col("code.value").alias("code"), F.col("n").alias("n_rows"))
        pairs = self.table("pairs", upto)
        fan = (pairs if widened else pairs.where("listed")).groupBy(F.col("supplier_key").alias("k")).agg(F.count_distinct("brand_key").alias("fan_out"))
        out = base.join(fan, F.col("supplier_key") == F.col("k"), "left").drop("k").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))
        return out.withColumn("distributor", F.col("fan_out") >= resolve.DISTRIBUTOR_FROM)

    def brands(self, upto: int | None = None) -> DataFrame:
        return self.table("brands", upto).select("brand_key", F.col("name.value").alias("name"), F.col("n").alias("n_mentions"))

    def owners(self, upto: int | None = None, widened: bool = False) -> DataFrame:
        """As ``resolve.owners``: the suppliers of each brand by rank."""
        e = self.table("pairs", upto).where("listed").drop("listed").join(self.manufacturers(upto, widened).select("supplier_key", "name", "distributor"), "supplier_key")
        rank = F.row_number().over(Window.partitionBy("brand_key").orderBy("distributor", F.col("n").desc(), "first_row", "supplier_key"))
        return e.withColumn("rank", rank)

    def prefix_rules(self, upto: int | None = None) -> DataFrame:
        """``prefix, learned, support, suppliers, first_part``: prefixes of part numbers that one brand
        alone has, seen twice or more; brands mentioned once only teach nothing."""
        known = self.brands(upto).where("n_mentions > 1").select("brand_key", "name")
        by = self.table("prefixes", upto).join(known, "brand_key").groupBy("prefix").agg(
            F.sum("n").alias("support"), F.count_distinct("brand_key").alias("brands"), F.min("name").alias("learned"), F.array_sort(F.collect_set("supplier_key")).alias("suppliers"), F.min("first_part").alias("first_part")
        )
        return by.where("brands = 1 AND support >= 2").select("prefix", "learned", "support", "suppliers", "first_part")

    def resolved(self, feed: DataFrame, upto: int | None = None, widened: bool = False) -> DataFrame:
        """``row_index, supplier, supplier_method, brand, brand_method, manufacturer``: each row by
        the masters of one version."""
        rows, makers = resolve.mentions(feed), self.manufacturers(upto, widened)
        by = resolve.resolve_suppliers(rows, makers).select("row_index", F.col("manufacturer").alias("supplier"), F.col("method").alias("supplier_method"))
        branded = resolve.resolve_brands(rows, self.brands(upto)).select("row_index", "brand", F.col("method").alias("brand_method"))
        made = resolve.of_record(rows, self.owners(upto, widened), makers).select("row_index", "manufacturer")
        return by.join(branded, "row_index").join(made, "row_index")


_FEED = "row_index long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, DIB_Brand string, Part_Manuf string"


def learn(feed: DataFrame, path: str, checkpoint: str, resolved_to: str | None = None, pack: Pack = OWN, **trigger) -> StreamingQuery:
    """Learn from a streaming feed, batch by batch; with ``resolved_to``, each batch's rows are
    also resolved by the version it made and written there, under its id."""
    trigger = trigger or {"availableNow": True}

    def each(batch: DataFrame, version: int) -> None:
        state = Learned(batch.sparkSession, path, pack)
        state.absorb(batch, version)
        if resolved_to:
            state.resolved(batch, version).write.mode("overwrite").parquet(f"{resolved_to}/version={version}")

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
