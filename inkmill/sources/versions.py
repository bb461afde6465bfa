"""A chunk store of snapshots: each batch is taken in exactly once, and readers keep the version they opened.

Nothing that is written changes. A commit writes its rows, the sources that it takes out (those it replaces among them) and the regions that it
sets into a folder of its own, and then publishes a manifest, one file that lists every live folder with the commit's number. The file is there
whole or not at all, as the writing job's commit renames it into place, so a commit that stops anywhere leaves the version before.
A manifest also holds each writer's last batch, so a batch that comes again is passed over. If two writers publish the same version, the one whose
manifest has that version's name first has made it, and the other, which finds the name taken, publishes again on top of it. That needs a file
system that renames a folder in one step and not onto another, as HDFS does.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "struct<seq: bigint, kind: string, folder: string>"
MANIFEST = f"v bigint, writers map<string, bigint>, parts array<{PART}>"
#: Deleted sources and set regions up to this many are broadcast to the rows.
BROADCAST_ROWS = 500_000
#: Files that a source's rows are dealt to, and rows a file holds at most.
FILES_A_SOURCE, FILE_ROWS = 16, 1_000_000


@dataclass(frozen=True)
class Version:
    number: int
    writers: dict[str, int]
    parts: tuple[tuple[int, str, str], ...]


class VersionedStore:
    """Rows of ``schema``, which has a column source, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), T.StructType.fromDDL(schema)

    def _manifests(self) -> DataFrame | None:
        try:
            read = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifests")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return read.select("*", F.col("_metadata.file_path").alias("file"))

    def version(self, number: int | None = None) -> Version:
        """A version, or the last one; before the first commit there is version 0."""
        found = self._manifests()
        if found is not None:
            last = found.agg(F.max("v")).first()[0] if number is None else number
            row = found.where(F.col("v") == last).orderBy("file").first()
            if row:
                return Version(row["v"], dict(row["writers"]), tuple((p["seq"], p["kind"], p["folder"]) for p in row["parts"]))
        if number:
            raise ValueError(f"there is no version {number}")
        return Version(0, {}, ())

    def _write(self, df: DataFrame, folder: str, kind: str) -> None:
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/data/{folder}/{kind}")

    def _publish(self, made: Version) -> bool:
        """Publish a version; False if another writer has done so."""
        own = f"{self.path}/pending/{uuid.uuid4().hex}"
        row = [(made.number, made.writers, [list(p) for p in made.parts])]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.parquet(own)
        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        src, dst = fs.Path(own), fs.Path(f"{self.path}/manifests/{made.number:012d}")
        whole = src.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(src)
        files = fs.FileContext.getFileContext(whole.toUri(), sc._jsc.hadoopConfiguration())
        files.mkdir(dst.getParent(), fs.permission.FsPermission.getDirDefault(), True)
        try:
            files.rename(src, dst, sc._gateway.new_array(fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, writer: str, batch: int, rows: DataFrame | None = None, gone: DataFrame | None = None, regions: DataFrame | None = None) -> Version:
        """Take in a batch of a writer: rows replace what their sources had, sources of gone(source) go, regions(source, region_code) are set.

        A batch whose number the writer has committed, or passed, changes nothing.
        """
        base = self.version()
        if batch <= base.writers.get(writer, -1):
            return base
        folder, kinds = uuid.uuid4().hex, []
        if rows is not None:
            salt = F.pmod(F.xxhash64(*(c for c, kind in rows.dtypes if "map" not in kind and "variant" not in kind)), F.lit(FILES_A_SOURCE))
            self._write(rows.select(*self.schema.names).repartition(F.col("source"), salt), folder, "rows")
            kinds.append("rows")
            replaced = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}/rows").select("source")
            gone = replaced if gone is None else gone.select("source").unionByName(replaced)
        if gone is not None:
            self._write(gone.select("source").distinct(), folder, "gone")
            kinds.append("gone")
        if regions is not None:
            self._write(regions.select("source", "region_code").dropDuplicates(["source"]), folder, "regions")
            kinds.append("regions")
        while True:
            number = base.number + 1
            made = Version(number, base.writers | {writer: batch}, (*base.parts, *((number, kind, folder) for kind in kinds)))
            if self._publish(made):
                return made
            base = self.version()
            if batch <= base.writers.get(writer, -1):
                return base

    def _part(self, version: Version, kind: str, schema: T.StructType) -> DataFrame:
        """The rows of all folders of a kind, each with the number of its commit as _seq."""
        own = {folder: seq for seq, k, folder in version.parts if k == kind}
        if not own:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_seq", T.LongType())]))
        folder = F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]+)/", 1)
        numbers = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))
        read = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}/{kind}" for f in own))
        return read.select("*", F.element_at(numbers, folder).cast("long").alias("_seq"))

    def snapshot(self, number: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one. A region set later than a row stands in its metadata.region_code, or in its region_code."""
        version = self.version(number)
        rows = self._part(version, "rows", self.schema)
        gone = self._part(version, "gone", T.StructType.fromDDL("source string")).groupBy("source").agg(F.max("_seq").alias("_gone"))
        regions = self._part(version, "regions", T.StructType.fromDDL("source string, region_code string")).groupBy("source").agg(F.max(F.struct("_seq", "region_code")).alias("_set"))
        small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
        live = rows.join(small(gone), "source", "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_seq")))
        live = live.join(small(regions), "source", "left")
        newer = F.col("_set._seq") > F.col("_seq")
        if "metadata" in self.schema.names:
            live = live.withColumn("metadata", F.when(newer, F.col("metadata").withField("region_code", F.col("_set.region_code"))).otherwise(F.col("metadata")))
        elif "region_code" in self.schema.names:
            live = live.withColumn("region_code", F.when(newer, F.col("_set.region_code")).otherwise(F.col("region_code")))
        return live.select(*self.schema.names)

    def compact(self) -> Version:
        """The last version again with its rows in one folder; the folders of earlier versions stay for their readers."""
        base, folder = self.version(), uuid.uuid4().hex
        self._write(self.snapshot(base.number or None), folder, "rows")
        made = Version(base.number + 1, base.writers, ((base.number + 1, "rows", folder),))
        if not self._publish(made):
            raise RuntimeError("another writer committed while the store was compacted")
        return made

    def orphans(self) -> DataFrame:
        """(folder): data folders that no manifest names, as of commits that stopped; they may be removed once no writer is at work."""
        manifests = self._manifests()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/data")
        folders = files.select(F.regexp_extract("path", r"/data/([0-9a-f]+)/", 1).alias("folder")).distinct()
        if manifests is None:
            return folders
        return folders.join(manifests.select(F.explode("parts.folder").alias("folder")).distinct(), "folder", "left_anti")
