"""Sharding by size-tiered compaction over a versioned manifest.

A store is a folder: `data/` holds immutable Parquet shards, `manifests/` a table of shards per
version, and `versions/` one small file per version that names its manifest. That file is written
under another name and renamed, which fails where the version exists; the rename is the commit:
readers see the old version or the new one, and of two writers one loses and can try again. Nothing
is ever changed in place.

append() writes an arrival as it is partitioned, without a shuffle, as small shards. compact()
groups shards of similar size in tiers (powers of `fanout`), packs each tier that holds `fanout`
shards or more into bins of the target size, and rewrites the bins, each as one file, in one Spark
job. Rounds go on until no tier is full; shards near the target are never rewritten. Replaced
shards stay, so that earlier versions can be read, until vacuum(). A job that dies leaves unnamed
files, which vacuum() removes too.

The driver holds paths and sizes of shards, as Spark's own file listing does, never rows.

Edge cases: an empty arrival commits a version without new shards; null and empty texts, ties,
repeated rows and extra columns are stored as they are; the columns of a store are those of its
first arrival; `shard` and `shard_version` are added by read(), which refuses clashing names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recovery import cut, shared_dir

TARGET_BYTES, FANOUT = 64 << 20, 4
#: Up to this many paths of shards go to every executor; more are joined by a shuffle.
BROADCAST_PATHS = 100_000
SHARD = "path string, bytes long, tier int, added long"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root, target_bytes, fanout

    # files, by Hadoop's file system, so any store that Spark can reach will do
    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        if not self._fs.exists(self._path(name)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name)))

    def version(self) -> int:
        return max((int(x) for x in self._list("versions") if x.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, tier, added): the shards of a version, the latest by default."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SHARD)
        name = self.spark.read.text(f"{self.root}/versions/{version:08d}").first()[0]
        return self.spark.read.schema(SHARD).parquet(f"{self.root}/manifests/{name}")

    def _commit(self, shards: DataFrame, base: int) -> int:
        name = uuid.uuid4().hex
        shards.write.parquet(f"{self.root}/manifests/{name}")
        path, draft = self._path(f"versions/{base + 1:08d}"), self._path(f"drafts/{name}")
        self._fs.mkdirs(self._path("versions"))
        out = self._fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        sc = self.spark.sparkContext
        jvm = sc._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        options = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(path), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(path):
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _written(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files under data/<folder>."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        found = files.load(f"{self.root}/data/{folder}").select("path", F.col("length").alias("bytes"))
        name = F.regexp_extract("path", r"/data/(.*)$", 1)
        tier = F.floor(F.log(float(self.fanout), F.greatest("bytes", F.lit(1)))).cast("int")
        return found.select(name.alias("path"), "bytes", tier.alias("tier"), F.lit(version).cast("long").alias("added"))

    def append(self, df: DataFrame) -> int:
        """Store df as new shards and commit; the version."""
        base, folder = self.version(), f"a{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return self._commit(self.manifest(base).union(self._written(folder, base + 1)), base)

    def _bins(self, shards: DataFrame) -> DataFrame:
        """(path, bin) of the shards to merge: full tiers below the target, packed to the target size.

        A tier's shards are dealt by hash into groups of about 64 bins before they are laid end to end, so no task
        holds a tier.
        """
        small = shards.filter(F.col("bytes") * 2 <= self.target)
        full = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"))
        full = full.filter(F.col("n") >= self.fanout)
        dealt = small.join(full, "tier").withColumn(
            "deal", F.pmod(F.xxhash64("path"), F.ceil(F.col("all") / (64 * self.target)))
        )
        ahead = F.sum("bytes").over(W.partitionBy("tier", "deal").orderBy("path").rowsBetween(W.unboundedPreceding, -1))
        bins = dealt.withColumn("k", F.floor(F.coalesce(ahead, F.lit(0)) / self.target))
        bins = bins.select("path", "tier", F.concat_ws("-", "tier", "deal", "k").alias("bin"))
        return bins.join(bins.groupBy("bin").agg(F.count("*").alias("n")).filter("n > 1"), "bin", "left_semi")

    def compact(self) -> int:
        """Merge until no tier holds `fanout` shards that can be merged; the version."""
        while True:
            base = self.version()
            shards = self.manifest(base)
            bins = cut(self._bins(shards))
            old = [r["path"] for r in bins.select("path").collect()]
            if not old:
                return base
            folder = f"c{base + 1:08d}-{uuid.uuid4().hex[:6]}"
            rows = self.spark.read.parquet(*[f"{self.root}/data/{p}" for p in old])
            packed = rows.select(F.struct("*").alias("row"), F.regexp_extract("_metadata.file_path", r"/data/(.*)$", 1).alias("path"))
            numbers = bins.select("bin").distinct().withColumn("number", F.row_number().over(W.orderBy("bin")) - 1)
            numbers = cut(bins.join(numbers, "bin").select("path", "number"))
            dealt = packed.join(F.broadcast(numbers) if len(old) <= BROADCAST_PATHS else numbers, "path")
            n = numbers.agg(F.max("number")).first()[0] + 1
            dealt = dealt.repartitionById(n, F.col("number").cast("int")).select("row.*")
            dealt.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
            kept = shards.join(bins, "path", "left_anti")
            self._commit(kept.union(self._written(folder, base + 1)), base)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with `shard`, the shard's path in the store, and `shard_version`, that of its commit."""
        paths = [(r["path"], r["added"]) for r in self.manifest(version).select("path", "added").collect()]
        if not paths:
            raise FileNotFoundError(f"no shards in {self.root}")
        df = self.spark.read.parquet(*[f"{self.root}/data/{p}" for p, _ in paths])
        if clash := {"shard", "shard_version"} & set(df.columns):
            raise ValueError(f"clashing columns: {sorted(clash)}")
        added = F.regexp_extract("_metadata.file_path", r"/data/(.*)$", 1)
        known = self.spark.createDataFrame(paths, "shard string, shard_version long")
        known = F.broadcast(known) if len(paths) <= BROADCAST_PATHS else known
        return df.select("*", added.alias("shard")).join(known, "shard").select(*df.columns, "shard", "shard_version")

    def vacuum(self, keep_versions: int = 1) -> None:
        """Drop all but the latest versions, with their manifests, and data files that no version left names.

        Only while no writer and no reader of a dropped version is at work.
        """
        if keep_versions < 1:
            raise ValueError("the latest version stays")
        versions = sorted(int(x) for x in self._list("versions") if x.isdigit())
        for v in versions[:-keep_versions]:
            entry = self._path(f"versions/{v:08d}")
            name = self.spark.read.text(f"{self.root}/versions/{v:08d}").first()[0]
            self._fs.delete(entry, False)
            self._fs.delete(self._path(f"manifests/{name}"), True)
        named = {r["path"] for v in versions[-keep_versions:] for r in self.manifest(v).select("path").collect()}
        self._fs.delete(self._path("drafts"), True)
        for folder in self._list("data"):
            for r in self._written(folder, 0).select("path").collect():
                if r["path"] not in named:
                    self._fs.delete(self._path(f"data/{r['path']}"), False)

    def drop(self) -> None:
        self._fs.delete(self._path(), True)


def shard(docs: DataFrame, arrivals: int = 3, store: Store | None = None) -> Store:
    """Store docs as `arrivals` arrivals (by hash of doc_id, each half the size of the one before) and compact."""
    spark = docs.sparkSession
    store = store or Store(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    place = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit((1 << arrivals) - 1))
    for i in range(arrivals):
        low, high = (1 << i) - 1, (1 << (i + 1)) - 1
        store.append(docs.filter((place >= low) & (place < high)))
    store.compact()
    return store


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, shard, shard_version) of the compacted store; the store itself is dropped once they are read."""
    store = shard(docs)
    out = cut(store.read().select("doc_id", "shard", "shard_version"))
    store.drop()
    return out
