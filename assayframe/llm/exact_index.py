"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest.  A batch of new rows
is reduced to one row for each digest first (so that a group of copies, however
large, costs one row a task), and a sort-merge anti-join with the index, whose
side needs neither exchange nor broadcast, tells the digests that are new; those
are appended.

Jobs may be lost at any time, so batches are idempotent.  What is appended
carries its attempt, and is invisible until the attempt is committed by creating
one file, which a file system does once or not at all.  A batch that is
committed already adds nothing: run again, it gets the answer of the first time.
A batch is named by the caller or, without a name, by its rows (ids and texts).
One writer at a time is assumed; readers see whole batches only.

Defined results: a null text counts as empty; texts are equal when their UTF-8
bytes are; of equal texts in a batch the row with the largest id stays (a null
id is less than any other; of rows repeated with one id, one stays); a text that
an earlier batch has brought stays with that batch's row, so every row of the
new batch that equals it goes.  Columns beyond the two that are named are not
read, so their names can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, stored, with_row_key

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("batch", T.StringType()),
        T.StructField("attempt", T.StringType()),
    ]
)
#: Rows for each bucket of an index made for a table, and the least and the largest number of buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 16, 65_536
#: Folders beside the table's files, whose names its readers pass over: commits, and the index's own facts.
COMMITS, FACTS = "_commits", "_index.json"


def text_digest(text: Column) -> Column:
    """The 32 bytes of SHA-256 over the text's UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def bucket_count(rows: int) -> int:
    """Buckets, a power of two, for an index of so many rows."""
    n = LEAST_BUCKETS
    while n < MOST_BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


class DigestIndex:
    """Digests of all texts that were kept so far, as a bucketed and sorted table.

    ``path`` is where the files lie (in storage that all executors see).  A later
    session that names the same path goes on with the index, whatever it calls
    the table; the bucket count is that with which the index was made.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 64):
        self.spark, self.table, self.path = spark, table, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._create(FACTS, json.dumps({"buckets": buckets})):
            buckets = json.loads(self._read(FACTS))["buckets"]
        self.buckets = buckets
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in INDEX_SCHEMA)
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (path '{path}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
            )

    # ---- files beside the table's ----

    def _create(self, name: str, text: str) -> bool:
        """Makes a file with all its text, or tells that it is there already: it is written aside and renamed."""
        final, draft = self._hadoop(f"{self.path}/{name}"), self._hadoop(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        if self._fs.exists(final):
            return False
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        done = self._fs.rename(draft, final)
        if not done:
            self._fs.delete(draft, False)
        return done

    def _read(self, name: str) -> str:
        stream = self.spark._jvm.java.io.InputStreamReader(self._fs.open(self._hadoop(f"{self.path}/{name}")), "UTF-8")
        lines = self.spark._jvm.java.io.BufferedReader(stream)
        text = lines.readLine()
        lines.close()
        return text

    def commits(self) -> dict[str, str]:
        """The attempt that counts of each committed batch: one small file a batch."""
        where = self._hadoop(f"{self.path}/{COMMITS}")
        if not self._fs.exists(where):
            return {}
        # a commit's name holds all it says, so that a listing is enough
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(where))
        return {unquote(n.rsplit("@", 1)[0]): n.rsplit("@", 1)[1] for n in names}

    def rows(self) -> DataFrame:
        """What committed batches brought, those of other sessions among them."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).where(F.col("attempt").isin(list(self.commits().values())))

    # ---- batches ----

    def dedupe(self, new: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Adds the texts of ``new`` that the index lacks to it and tells of every row of ``new`` whether it stays.

        Returns doc_id, digest, keep_id, group_size (equal texts in this batch), kept.
        """
        keyed = new.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
        return self.dedupe_digests(keyed, batch).drop("row")

    def dedupe_digests(self, keyed: DataFrame, batch: str | None = None) -> DataFrame:
        """As ``dedupe``, of rows (doc_id, digest, and ``row``, distinct, if it is there, which is returned)."""
        if "row" not in keyed.columns:
            keyed = keyed.withColumn("row", F.monotonically_increasing_id())
        rows = stored(keyed, "digests")
        groups = stored(
            rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("top.doc_id").alias("top_id"), F.col("top.row").alias("top_row"), "group_size"),
            "digest-groups",
        )
        batch = batch or _name(rows)
        if batch not in self.commits():
            attempt = uuid.uuid4().hex
            fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
            self._append(fresh.select("digest", F.col("top_id").alias("keep_id"), F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt")))
            self._create(f"{COMMITS}/{quote(batch, safe='')}@{attempt}", "")
        # Which of several rows equal in id and text is kept is told by this run's numbers: they are interchangeable.
        settled = stored(groups.join(self.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size", "top_row", "batch"), "digest-settled")
        kept = (F.col("batch") == batch) & (F.col("row") == F.col("top_row"))
        return rows.join(settled.hint("merge"), "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"), "row")

    def _append(self, fresh: DataFrame) -> None:
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )

    def drop(self) -> None:
        """Forgets the table; its files, as those of any external table, stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _name(rows: DataFrame) -> str:
    """A batch's name from its rows, in any order: their number and two sums of hashes."""
    sums = [F.sum(F.xxhash64(F.lit(k), "doc_id", "digest").cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]
    told = rows.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return f"rows-{told['n']}-{told['h0'] or 0}-{told['h1'] or 0}"


def fresh_index(spark: SparkSession, rows: int = 0) -> DigestIndex:
    """An index of its own for one job over about so many rows, in the shared folder."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", new_path(spark, "digest-index"), bucket_count(rows))


def keep_first_of_equal(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``index.dedupe`` keeps.

    Rows are told apart by their places in files and found again by these, so
    copies of one text spread over all tasks whatever their ids.
    """
    numbered, row = with_row_key(docs)
    keyed = numbered.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.col(row).alias("row"))
    kept = index.dedupe_digests(keyed, batch).where("kept").select(F.col("row").alias(row))
    return numbered.join(kept.hint("merge"), row, "left_semi").drop(row)
