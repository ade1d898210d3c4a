"""Incremental corpus: a stream of papers, new or changed, keeps the graph up to date.

Each micro-batch extracts its papers anew, finds the titles its references may hold
and the earlier references its titles may be in, and matches these. What it looks up
is kept in tables dealt into shards by a hash of their key: papers and texts of
references by paper, keys of titles and of references by key. A batch lists the shards
of its own keys and opens only their folders, so what it reads follows its own size
and not the corpus. ``compact`` merges the folders that batches leave in a shard.

All else is Parquet in one folder per batch. A replayed batch overwrites what it wrote
and reads only earlier rows, so it is idempotent. A paper's rows are those of the
newest batch that holds it: ``table`` leaves out what a later version replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions.text import normalize_title
from folioscope.operators.citations import MIN_TITLE_LENGTH, citation_match, reference_keys, title_key
from folioscope.operators.extraction import extract_knowledge
from folioscope.operators.graph import paper_entity_id, resolve_edges, resolve_entities
from folioscope.operators.structure import assemble_pages, segment_sections, split_references
from folioscope.sources.store import listed, remove

# Tables in shards: the column that deals them out, and their other columns.
SHARDED = {
    "papers": ("paper_id", "paper_id STRING, title STRING, abstract STRING, ord BIGINT, version BIGINT"),
    "reference_texts": ("paper_id", "paper_id STRING, reference_id STRING, raw_text STRING"),
    "title_keys": ("key", "key BIGINT, paper_id STRING, title STRING"),
    "reference_keys": ("key", "key BIGINT, paper_id STRING, reference_id STRING"),
}
SHARDS = 1024


@dataclass
class CorpusRefresher:
    """foreachBatch target. Input rows: (paper_id, title, abstract, ord, pages
    ARRAY<STRUCT<page_no INT, text STRING>>).

    The version of a paper with the largest ``version``, a whole number, counts,
    and among equal ones the one of the newest batch; inside a batch the one whose
    content sorts last. ``shards`` must not change once a folder is in use."""

    root: str
    version: str = "ord"
    min_title_length: int = MIN_TITLE_LENGTH
    options: dict = field(default_factory=dict)
    shards: int = SHARDS

    def _shard(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.shards)).cast("int")

    def _store(self, df: DataFrame, table: str, run: str) -> None:
        """Rows (with ``batch_id``) to a folder ``run`` of each of their shards."""
        by, _ = SHARDED[table]
        dealt = df.withColumn("shard", self._shard(F.col(by))).withColumn("run", F.lit(run))
        writer = dealt.repartition("shard").write.partitionBy("shard", "run").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{table}")

    def _runs(self, spark: SparkSession, table: str, shards: set[int] | None, before: int | None) -> list[str]:
        """The folders of a table's shards, or of some, that batches before one left."""
        names = [n for n in listed(spark, f"{self.root}/{table}") if n.startswith("shard=")]
        names = [n for n in names if shards is None or int(n[6:]) in shards]
        runs = [f"{table}/{n}/{r}" for n in names for r in listed(spark, f"{self.root}/{table}/{n}") if r.startswith("run=")]
        return [r for r in runs if before is None or int(r.rpartition("run=")[2][1:]) < before]

    def _open(self, spark: SparkSession, table: str, shards: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The stored rows of some shards, or of all. A batch that is run again does
        not open its own folders, which it is about to replace."""
        schema = f"{SHARDED[table][1]}, batch_id BIGINT"
        paths = [f"{self.root}/{r}" for r in self._runs(spark, table, shards, before)]
        if not paths:
            return spark.createDataFrame([], schema)
        stored = spark.read.schema(f"{schema}, shard INT, run STRING").option("basePath", f"{self.root}/{table}").parquet(*paths)
        return stored.drop("shard", "run").distinct()  # a merge that broke off leaves rows twice

    def earlier(self, asked: DataFrame, table: str, batch_id: int) -> DataFrame:
        """Rows of batches before this one whose key is in the one column of
        ``asked``. Only the shards of these keys are opened; at most ``shards``
        numbers come to the driver."""
        (name,) = asked.columns
        keys = asked.distinct()
        shards = {r.shard for r in keys.select(self._shard(F.col(name)).alias("shard")).distinct().collect()}
        return self._open(asked.sparkSession, table, shards, batch_id).join(keys, name, "left_semi")

    def _newest(self, papers: DataFrame) -> DataFrame:
        return papers.groupBy("paper_id").agg(F.max("batch_id").alias("newest"))

    def _standing(self, rows: DataFrame, fresh: DataFrame, batch_id: int) -> DataFrame:
        """Earlier rows of papers that neither a later batch nor this one replaces."""
        newest = self._newest(self.earlier(rows.select("paper_id"), "papers", batch_id))
        kept = rows.join(newest, "paper_id").where("batch_id = newest").drop("newest")
        return kept.join(fresh.select("paper_id"), "paper_id", "left_anti")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows whose paper, and the paper they cite, have no later version."""
        newest = self._newest(self._open(rows.sparkSession, "papers"))
        columns = rows.columns
        rows = rows.join(newest, "paper_id").where("batch_id >= newest").drop("newest")
        if "cited_paper_id" in columns:
            cited = newest.withColumnsRenamed({"paper_id": "cited_paper_id", "newest": "cited_newest"})
            rows = rows.join(cited, "cited_paper_id", "left").where("cited_newest is null or batch_id >= cited_newest")
        return rows.select(*columns)

    def _write(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        path = f"{self.root}/{table}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        run, number = f"b{batch_id}", F.lit(batch_id).cast("bigint").alias("batch_id")
        content = [F.to_json(F.struct(c)) for c in ("title", "abstract", "ord", "pages")]
        order = F.struct(F.col(self.version).cast("bigint").alias("version"), *content)
        kept = F.struct("title", "abstract", "ord", "pages", F.col(self.version).cast("bigint").alias("version"))
        last = batch.groupBy("paper_id").agg(F.max_by(kept, order).alias("last")).select("paper_id", "last.*")
        known = self.earlier(batch.select("paper_id"), "papers", batch_id).groupBy("paper_id").agg(
            F.max_by("version", "batch_id").alias("known")
        )
        fresh = last.join(known, "paper_id", "left").where("known is null or version is null or version >= known").drop("known")
        pages = fresh.select("paper_id", F.explode("pages").alias("p")).select(
            "paper_id", "p.page_no", "p.text"
        )
        # written before use: later steps read files, not the source again
        papers = self._write(fresh.select("paper_id", "title", "abstract", "ord", "version"), "batches", batch_id)
        self._write(assemble_pages(pages), "full_text", batch_id)
        sections = self._write(segment_sections(pages), "sections", batch_id)
        references = self._write(split_references(sections), "references", batch_id)
        raw_entities, raw_edges = extract_knowledge(sections, papers, **self.options)
        raw_entities = self._write(raw_entities, "mentions", batch_id)

        norm = normalize_title(F.col("title"))
        own_titles = papers.where(F.length(norm) >= max(1, self.min_title_length)).select(
            title_key(norm, self.min_title_length).alias("key"), "paper_id", "title"
        )
        words = F.split(normalize_title(F.col("raw_text")), " ")
        own_keys = references.select(
            F.explode(F.array_distinct(reference_keys(words, self.min_title_length))).alias("key"), "paper_id", "reference_id"
        )
        titles = self._standing(self.earlier(own_keys.select("key"), "title_keys", batch_id), papers, batch_id)
        held = self._standing(self.earlier(own_titles.select("key"), "reference_keys", batch_id), papers, batch_id)
        held = held.select("paper_id", "reference_id", "batch_id").distinct()
        texts = self.earlier(held.select("paper_id"), "reference_texts", batch_id).join(held, ["paper_id", "reference_id", "batch_id"])
        self._store(papers.select("*", number), "papers", run)
        self._store(own_titles.select("*", number), "title_keys", run)
        self._store(own_keys.select("*", number), "reference_keys", run)
        self._store(references.select("paper_id", "reference_id", "raw_text", number), "reference_texts", run)

        match = lambda refs, among: citation_match(
            refs.select("paper_id", "reference_id", "raw_text"), among.select("paper_id", "title"), self.min_title_length
        )
        cited = self._write(
            match(references, titles.select("paper_id", "title").distinct().unionByName(papers.select("paper_id", "title")))
            .unionByName(match(texts, papers)), "matches", batch_id,
        )
        citing = self._standing(self.earlier(cited.select("paper_id"), "papers", batch_id), papers, batch_id)
        edge_columns = [
            "paper_id", "source_entity_id", "target_entity_id", "relationship_type", "evidence",
            "confidence",
        ]
        # a citation also names the paper it cites: it goes with either's next version
        edges = resolve_edges(raw_edges, raw_entities, papers).select(*edge_columns, F.lit(None).cast("string").alias("cited_paper_id"))
        sources = citing.select("paper_id", "title").unionByName(papers.select("paper_id", "title")).select(
            "paper_id", paper_entity_id(F.col("title")).alias("source_entity_id")
        )
        cites = cited.join(sources, "paper_id").select(
            "paper_id", "source_entity_id", paper_entity_id(F.col("cited_title")).alias("target_entity_id"),
            F.lit("cites").alias("relationship_type"), F.col("cited_title").alias("evidence"),
            F.col("match_confidence").alias("confidence"), "cited_paper_id",
        )
        self._write(edges.unionByName(cites), "relationships", batch_id)

    def compact(self, spark: SparkSession, up_to: int) -> None:
        """Merge what batches up to ``up_to``, which must have ended, left in the
        shards: one folder a shard, without rows that later versions replaced. Run
        it between batches. Folders go only after the merged one is written."""
        standing = self._open(spark, "papers", before=up_to + 1).groupBy("paper_id").agg(F.max("batch_id").alias("newest"))
        for table in sorted(SHARDED, key=lambda t: t == "papers"):  # papers last: the others are judged by them
            merged = f"m{up_to}"
            rows = self._open(spark, table, before=up_to + 1)
            self._store(rows.join(standing, "paper_id").where("batch_id = newest").drop("newest"), table, merged)
            for run in self._runs(spark, table, None, up_to + 1):
                if not run.endswith(f"run={merged}"):
                    remove(spark, f"{self.root}/{run}")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The rows that count of all batches. ``entities`` are resolved from the
        mentions of all papers, so one that no paper names any more is gone."""
        if name == "entities":
            return resolve_entities(self.table(spark, "mentions").drop("batch_id"), self.table(spark, "papers"))
        if name in SHARDED:
            return self._current(self._open(spark, name))
        return self._current(spark.read.parquet(f"{self.root}/{name}"))
