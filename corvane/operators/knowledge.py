"""A knowledge base of documents on disk: built, updated by differences, extended by other agents, asked for status and contents.

Every change writes a whole version aside and renames it, so readers see one version or the next. One writer at a time.
Relations between documents that did not change are taken over; only those of changed ones are counted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import index as I
from corvane.sources.tables import written

KINDS = {"term": "shared_terms", "work": "shared_works"}
LOG = "version long, action string, agent string, n_new long, n_changed long, n_removed long"


def content_hash(docs: DataFrame) -> DataFrame:
    """docs(doc_id, title, text, ...) with the hash that tells a changed document; a document is told by id, the last row by title and text if there are several. Only texts of such ids are shuffled."""
    own = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    several = I.repeated(own)
    last = own.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("title", "text")).alias("d")).select("doc_id", "d.*")
    own = own.join(several, "doc_id", "left_anti").union(last)
    return own.withColumn("content_hash", F.sha2(F.concat_ws("\u0001", "title", "text"), 256))


def shared(entities: DataFrame) -> DataFrame:
    """entities(doc_id, type, name) -> (kind, term, doc_id) of what relations share: terms and works."""
    kind = F.when(F.col("type") == "term", KINDS["term"]).when(F.col("type") == "work", KINDS["work"])
    return entities.select(kind.alias("kind"), F.col("name").alias("term"), "doc_id").where("kind is not null")


def entity_relations(entities: DataFrame) -> DataFrame:
    """entities(doc_id, type, name) -> relations by shared terms and by shared works."""
    return I.relations(shared(entities))


class KnowledgeBase:
    """Tables of the newest version: documents, keywords (postings), entities (of documents), relations, log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        if not self.fs.exists(self._p("")):
            return 0
        names = (s.getPath().getName() for s in self.fs.listStatus(self._p("")))
        return max((int(n[2:]) for n in names if n.startswith("v=")), default=0)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version()}/{name}")

    def _publish(self, number: int, tables: dict[str, DataFrame]) -> None:
        aside = f"_aside-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{aside}/{name}")
        if self.fs.exists(self._p(f"v={number}")) or not self.fs.rename(self._p(aside), self._p(f"v={number}")):
            raise OSError(f"version {number} was written meanwhile")

    def _commit(self, number: int, action: str, agent: str, docs: DataFrame, keywords: DataFrame, entities: DataFrame, counts: tuple[int, int, int], log: DataFrame | None, relations: DataFrame | None = None) -> None:
        line = self.spark.createDataFrame([(number, action, agent, *counts)], LOG)
        relations = entity_relations(entities) if relations is None else relations
        self._publish(number, {"documents": docs, "keywords": keywords, "entities": entities, "relations": relations, "log": line if log is None else log.union(line)})

    def _changed_relations(self, entities: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
        return I.merge_relations(self.table("relations"), shared(entities), new, gone)

    def _records(self, docs: DataFrame, agent: str, number: int, old: DataFrame | None = None) -> DataFrame:
        """Rows of the documents table; a changed document keeps the version that added it."""
        rows = docs.select("doc_id", "title", F.lit(agent).alias("agent"), "content_hash", F.lit(number).cast("long").alias("updated"))
        if old is None:
            return rows.select("doc_id", "title", "agent", "content_hash", F.col("updated").alias("added"), "updated")
        before = old.select(F.col("doc_id").alias("_id"), F.col("added").alias("_added"))
        rows = rows.join(before, F.col("doc_id") == F.col("_id"), "left")
        return rows.select("doc_id", "title", "agent", "content_hash", F.coalesce("_added", "updated").alias("added"), "updated")

    @staticmethod
    def _keywords(own: DataFrame) -> DataFrame:
        return written(I.keywords(own, unique=True), "keywords")

    @staticmethod
    def _entities(own: DataFrame) -> DataFrame:
        return written(I.document_entities(I.mentions(own)).select("doc_id", "type", "name", "count"), "entities")

    @staticmethod
    def _usable(docs: DataFrame, loose: bool = False) -> DataFrame:
        """Rows of status success; loose: those without a status too, and all if none succeeded."""
        if "status" not in docs.columns:
            return docs
        good = docs.where(F.coalesce("status", F.lit("success")) == "success") if loose else docs.where("status = 'success'")
        return docs if loose and good.isEmpty() else good

    def init(self, docs: DataFrame, agent: str = "documents", status: str = "completed") -> int:
        """Build it from all successful docs(doc_id, title, text[, status]); the new version's number. A manifest that is not completed is an error."""
        if status != "completed":
            raise ValueError(f"manifest status is {status}, not completed")
        own, number = content_hash(self._usable(docs)), self.version() + 1
        self._commit(number, "init", agent, self._records(own, agent, number), self._keywords(own), self._entities(own), (own.count(), 0, 0), None)
        return number

    def pending(self, docs: DataFrame) -> DataFrame:
        """(doc_id, state): new, changed, unchanged or removed, against the newest version."""
        return self._states(content_hash(self._usable(docs)))

    def _states(self, own: DataFrame) -> DataFrame:
        now = own.select(F.col("doc_id").alias("a"), F.col("content_hash").alias("h"))
        old = self.table("documents").select(F.col("doc_id").alias("b"), "content_hash")
        both = now.join(old, F.col("a") == F.col("b"), "full")
        state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("h") != F.col("content_hash"), "changed").otherwise("unchanged")
        return both.select(F.coalesce("a", "b").alias("doc_id"), state.alias("state"))

    def update(self, docs: DataFrame, agent: str = "documents", status: str = "completed") -> int:
        """Take over what differs, as a rebuild would have it; the version then. Without differences nothing is written; without a version it is init()."""
        number = self.version()
        if not number:
            return self.init(docs, agent, status)
        if status != "completed":
            raise ValueError(f"manifest status is {status}, not completed")
        now = content_hash(self._usable(docs))
        states = I.ids(self._states(now), "states")
        counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}  # four rows at most
        if not any(counts.get(k) for k in ("new", "changed", "removed")):
            return number
        old = self.table("documents")
        own = written(now.join(states.where("state in ('new', 'changed')").select("doc_id"), "doc_id", "left_semi"), "own")
        gone = states.where("state in ('changed', 'removed')").select("doc_id")
        keywords, entities = self._keywords(own), self._entities(own)
        documents = old.join(states.where("state = 'unchanged'").select("doc_id"), "doc_id", "left_semi").unionByName(self._records(own, agent, number + 1, old))
        merged = written(I.merge_postings(self.table("entities"), entities, gone), "entities")
        self._commit(
            number + 1, "update", agent, documents, I.merge_postings(self.table("keywords"), keywords, gone), merged,
            tuple(counts.get(k, 0) for k in ("new", "changed", "removed")), self.table("log"), self._changed_relations(merged, own, gone),
        )
        return number + 1

    def register(self, docs: DataFrame, agent: str) -> int:
        """Another agent's documents: new and changed ones come in with their entities and relations, keywords stay as they are, nothing is removed."""
        number = self.version()
        own = content_hash(self._usable(docs, loose=True))
        if not number:
            self._commit(1, "register", agent, self._records(own, agent, 1), self._keywords(own.where("false")), self._entities(own), (own.count(), 0, 0), None)
            return 1
        old = self.table("documents")
        same = old.select("doc_id", "content_hash")
        own = written(own.join(same, ["doc_id", "content_hash"], "left_anti"), "own")
        changed = own.join(old.select("doc_id"), "doc_id", "left_semi").count()
        n = own.count()
        if not n:
            return number
        entities = self._entities(own)
        documents = old.join(own.select("doc_id"), "doc_id", "left_anti").unionByName(self._records(own, agent, number + 1, old))
        merged = written(I.merge_postings(self.table("entities"), entities, own.select("doc_id")), "entities")
        self._commit(number + 1, "register", agent, documents, self.table("keywords"), merged, (n - changed, changed, 0), self.table("log"), self._changed_relations(merged, own, own))
        return number + 1

    def status(self) -> DataFrame:
        """One row of counts; no version: none."""
        if not self.version():
            return self.spark.createDataFrame([], "version long, document_count long, keyword_count long, entity_count long, relation_count long")
        one = self.spark.range(1).select(F.lit(self.version()).cast("long").alias("version"))
        parts = {
            "document_count": self.table("documents"), "keyword_count": self.table("keywords").select("keyword").distinct(),
            "entity_count": self.table("entities").select("type", "name").distinct(), "relation_count": self.table("relations"),
        }
        for name, df in parts.items():
            one = one.join(df.agg(F.count(F.lit(1)).alias(name)))  # single rows
        return one

    def sources(self) -> DataFrame:
        """(agent, doc_count, last_version)."""
        return self.table("documents").groupBy("agent").agg(F.count(F.lit(1)).alias("doc_count"), F.max("updated").alias("last_version"))

    def query(self, kind: str, text: str, n: int = 10) -> DataFrame:
        """The first n matches: keywords by frequency, entities of each type by count, documents by id, relations by weight. Relations' ids are compared as they are, all else without case."""
        has = lambda c: F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
        if kind == "keywords":
            return I.search(I.keyword_totals(self.table("keywords")), "keyword", text, [F.desc("frequency"), "keyword"], n)
        if kind == "entities":
            from pyspark.sql import Window

            found = self.table("entities").where(has("name")).groupBy("type", "name").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("document_count"))
            return found.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("count"), "name"))).where(F.col("rank") <= n)
        if kind == "documents":
            return self.table("documents").where(has("title") | has("doc_id")).select("doc_id", "title", "agent").orderBy("doc_id").limit(n)
        if kind == "relations":
            at = lambda c: F.contains(F.col(c).cast("string"), F.lit(text))
            return self.table("relations").where(at("source") | at("target")).orderBy(F.desc("weight"), "source", "target", "type").limit(n)
        raise ValueError(f"unknown kind: {kind}")
