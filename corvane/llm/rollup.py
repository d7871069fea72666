"""Token counts: additive totals by source, language and tokenizer version, maintained by signed deltas in idempotent batches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table

KEYS = ["source", "lang", "tokenizer_version"]
#: Tokenizer versions counted by SQL functions; a count from a vocabulary file may come as a column of the events instead.
COUNTERS: dict[str, str] = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"}


def signed(events: DataFrame) -> DataFrame:
    """events(event_id, op, source, lang, tokenizer_version, n_tokens, old_tokens) -> additive rows (event_id, keys, n_docs, n_tokens), one an event.

    op: insert adds a document and its tokens, delete takes them off, revise replaces old_tokens by n_tokens. Null
    counts are 0; unknown ops are an error, raised when the batch is summed.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    return events.select("event_id", *KEYS, sign.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class Rollup:
    """A folder of committed batches: of each its sums by key and the ids of its events. A batch is visible once its folder has its final name.

    Committing a batch id again changes nothing: a batch is written aside and renamed, and a rename onto a committed
    batch is refused. An event id counts once in the whole rollup, in the batch that was committed first; of unlike
    events with one id in a batch the smallest counts. Events without an id cannot be told apart, so each of them counts,
    once for its batch. Batches with events in common must not be committed at the same time. A lost executor or driver
    leaves a folder that nothing reads.

    keep_ids: without it no ids are kept or compared, and ids count once a batch.
    """

    def __init__(self, spark: SparkSession, path: str, keep_ids: bool = True):
        self.spark, self.path, self.keep_ids = spark, path, keep_ids
        self.jvm = spark.sparkContext._jvm
        self.fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, head: str) -> list[str]:
        """What follows head= in the names of the folder's finished parts."""
        if not self.fs.exists(self._p("")):
            return []
        return [n[len(head) + 1 :] for n in (s.getPath().getName() for s in self.fs.listStatus(self._p(""))) if n.startswith(f"{head}=")]

    def committed(self, batch: str) -> bool:
        return self.fs.exists(self._p(f"batch={batch}"))

    def _publish(self, aside: str, name: str) -> bool:
        """Rename without overwriting: of several writers of one part one succeeds."""
        fs = self.jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        flags = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(self._p("").makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), conf).rename(self._p(aside), self._p(name), flags)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.fs.delete(self._p(aside), True)
            return False
        return True

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Whether the batch was new."""
        if self.committed(batch):
            return False
        rows = signed(events)
        least = F.min(F.struct(*KEYS, "n_docs", "n_tokens")).alias("e")
        named = rows.where("event_id is not null").groupBy("event_id").agg(least).select("event_id", "e.*")
        rows = named.unionByName(rows.where("event_id is null"))
        aside = f"_aside-{batch}-{uuid.uuid4().hex}"
        if self.keep_ids:
            if self._names("batch"):
                before = self.spark.read.schema("event_id string").parquet(f"{self.path}/batch=*/ids").where("event_id is not null")
                rows = rows.join(before, "event_id", "left_anti")
            rows.write.parquet(f"{self.path}/{aside}/rows")
            rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{aside}/rows")
            rows.select("event_id").where("event_id is not null").write.parquet(f"{self.path}/{aside}/ids")
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.path}/{aside}/sums")
        self.fs.delete(self._p(f"{aside}/rows"), True)
        return self._publish(aside, f"batch={batch}")

    def _sums(self) -> tuple[DataFrame | None, set[str]]:
        """All sums, those of the newest snapshot and of the batches that it does not hold; and the names of all these batches."""
        batches, snapshots = set(self._names("batch")), sorted(map(int, self._names("snapshot")))
        held: set[str] = set()
        paths = []
        if snapshots:
            at = f"{self.path}/snapshot={snapshots[-1]}"
            held = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{at}/batches").collect()}  # a row a batch, never a row an event
            paths.append(f"{at}/sums")
        paths += [f"{self.path}/batch={b}/sums" for b in sorted(batches - held)]
        return self.spark.read.schema(SUMS).parquet(*paths) if paths else None, batches | held

    def totals(self) -> DataFrame:
        """(keys, n_docs, n_tokens) over all committed batches; keys whose sums are all zero are gone."""
        rows, _ = self._sums()
        if rows is None:
            return self.spark.createDataFrame([], SUMS)
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Add all sums up in a snapshot, so that totals() reads it and later batches alone; whether this writer's snapshot counts.

        Batches keep their folders, and so their idempotency; totals of any moment see each batch once.
        """
        rows, batches = self._sums()
        if rows is None:
            return False
        number = max(map(int, self._names("snapshot")), default=0) + 1
        aside = f"_aside-snapshot-{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{self.path}/{aside}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").coalesce(1).write.parquet(f"{self.path}/{aside}/batches")
        return self._publish(aside, f"snapshot={number}")


def count_tokens(text: Column, pattern: str) -> Column:
    """Matches of the pattern in the whole text; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def vocabulary_counts(text: Column, path: str | None = None) -> Column:
    """Number of ids of the whole text by a vocabulary file, the closing id not counted; null and empty: 0. path: as tokens.encoder has it."""

    @F.pandas_udf("long")
    def count(texts):
        import pandas as pd
        import pyarrow as pa

        from .tokens import encoder

        return pd.Series([len(x) - 1 for x in encoder(path)(pa.array(texts, pa.large_string(), from_pandas=True))], dtype="int64")

    return count(text)


def document_name(docs: DataFrame) -> Column:
    """Tells rows apart by id, source, language and text; equal rows have one name."""
    parts = [F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-")) for c in ("doc_id", "source", "lang")]
    return F.md5(F.concat_ws("\u001f", *parts, F.xxhash64(docs["text"]).cast("string")))


def inserts(docs: DataFrame, counters: dict[str, str] = COUNTERS, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text, source, lang) -> an insert a row and tokenizer version; equal rows have the same event ids, so they count once.

    counters: SQL pattern by version; vocabularies: path of a vocabulary file by version.
    """
    counts = {v: count_tokens(F.col("text"), p) for v, p in counters.items()} | {v: vocabulary_counts(F.col("text"), p) for v, p in (vocabularies or {}).items()}
    rows = docs.select(document_name(docs).alias("_doc"), "source", "lang", *[n.alias(f"_n{k}") for k, n in enumerate(counts.values())])
    per = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(f"_n{k}").alias("n_tokens")) for k, v in enumerate(counts)])
    rows = rows.select("_doc", "source", "lang", F.inline(per))
    return rows.select(F.concat_ws(":", "_doc", "tokenizer_version").alias("event_id"), F.lit("insert").alias("op"), "source", "lang", "tokenizer_version", "n_tokens", F.lit(None).cast("long").alias("old_tokens"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; then those without a word are deleted, and pieces-1 counts are revised to pieces without marks; every batch is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counts = {"words": COUNTERS["words-1"], "pieces": COUNTERS["pieces-1"], "letters": r"[A-Za-z]+|[0-9]"}
    docs = materialise(docs.select(document_name(docs).alias("doc"), "source", "lang", *[count_tokens(F.col("text"), p).alias(c) for c, p in counts.items()]), "counts")

    def events(rows: DataFrame, op: str, versions: dict[str, tuple[str, str | None]]) -> DataFrame:
        per = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(n).alias("n_tokens"), (F.col(o) if o else F.lit(None).cast("long")).alias("old_tokens")) for v, (n, o) in versions.items()])
        rows = rows.select("doc", "source", "lang", F.inline(per))
        return rows.withColumn("event_id", F.concat_ws(":", "doc", "tokenizer_version", F.lit(op))).withColumn("op", F.lit(op))

    both = {"words-1": ("words", None), "pieces-1": ("pieces", None)}
    first, gone = events(docs, "insert", both), events(docs.where("words = 0"), "delete", both)
    revised = events(docs.where("words > 0"), "revise", {"pieces-1": ("letters", "pieces")})
    rollup = Rollup(spark, f"{shared_dir(spark)}/corvane-rollup-{uuid.uuid4().hex}")
    for batch, rows in (("1", first), ("2", gone), ("1", first), ("3", revised), ("3", revised)):
        rollup.commit(batch, rows)
    return rollup.totals()


OP8_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, source, lang, text FROM documents),
c AS (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
  coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]')), 0) AS letters FROM d)
SELECT source, lang, v.tokenizer_version, count(*) AS n_docs, CAST(sum(CASE WHEN v.tokenizer_version = 'words-1' THEN words ELSE letters END) AS BIGINT) AS n_tokens
FROM c, (VALUES ('words-1'), ('pieces-1')) AS v(tokenizer_version) WHERE words > 0 GROUP BY source, lang, v.tokenizer_version
"""
