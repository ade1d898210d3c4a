"""Papers with their sections and references, stored in shards by paper.

An ingest run rewrites the shards its papers are in and no others, so its cost
follows the run and files of untouched shards stay as they are. Sections and
references go first and papers with their status last: a run that breaks off leaves
papers that are not completed, and the next run replaces what it left of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.session import settle
from folioscope.sources.catalog import upsert_papers

PARTS = ("sections", "references")


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches; none if it is absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass
class PaperStore:
    """Tables ``papers``, ``sections`` and ``references`` under ``root``; all have the
    column ``key``, and papers ``extraction_status``. ``shards`` must not change once
    the folder is in use. Runs on one store must not overlap."""

    root: str
    key: str = "arxiv_id"
    shards: int = 256

    def _names(self, df: DataFrame) -> list[str]:
        """Folders of the shards that rows belong to: ``shards`` names at most."""
        return [f"shard={r.shard}" for r in self._dealt(df).select("shard").distinct().collect()]

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64(self.key), F.lit(self.shards)).cast("int"))

    def _stored(self, like: DataFrame, table: str, names: list[str] | None = None) -> DataFrame:
        spark, path = like.sparkSession, f"{self.root}/{table}"
        there = [n for n in listed(spark, path) if n.startswith("shard=") and (names is None or n in names)]
        if not there:
            return like.limit(0)
        read = spark.read.schema(like.schema).option("basePath", path)
        return read.parquet(*(f"{path}/{n}" for n in there)).select(*like.columns)

    def _replace(self, df: DataFrame, table: str, names: list[str]) -> None:
        """The shards ``names`` now hold exactly these rows."""
        rows, spark = settle(df), df.sparkSession  # what is read is about to be overwritten
        writer = self._dealt(rows).repartition("shard").write.partitionBy("shard").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{table}")
        for name in set(names) - set(self._names(rows)):  # nothing is left in these
            remove(spark, f"{self.root}/{table}/{name}")

    def upsert(self, papers: DataFrame, sections: DataFrame, references: DataFrame, order: list[str] | None = None) -> None:
        """Take in an ingest run. Papers that are completed stay with all their parts;
        of others the incoming row counts (see ``upsert_papers``) and the incoming
        sections and references replace the stored ones, also by none. Parts of papers
        that the run does not name are left out. Null keys are no papers."""
        papers = settle(papers.where(F.col(self.key).isNotNull()))
        names = self._names(papers)
        if not names:
            return
        stored = self._stored(papers, "papers", names)
        done = stored.where("extraction_status = 'completed'").select(self.key)
        taken = settle(papers.select(self.key).distinct().join(done, self.key, "left_anti"))
        for table, incoming in zip(PARTS, (sections, references)):
            kept = self._stored(incoming, table, names).join(taken, self.key, "left_anti")
            fresh = incoming.join(taken, self.key, "left_semi")
            self._replace(kept.select(*incoming.columns).unionByName(fresh.select(*incoming.columns)), table, names)
        self._replace(upsert_papers(stored, papers, self.key, order), "papers", names)

    def table(self, like: DataFrame, name: str) -> DataFrame:
        """All rows of a table, in the shape of ``like``."""
        return self._stored(like, name)
