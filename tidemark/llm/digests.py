"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by the digest of the normalised text. A new batch is reduced to
one row per digest, anti-joined with the index by sort-merge (the index side is not shuffled, the batch
is dealt into the same buckets), and what is new is appended to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, sized, stored, stored_path

SCHEMA = "digest binary, keep_id long, keep_row long, n long, batch string"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 after each run of white space became one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " ").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, one row per digest, in a table bucketed and sorted by digest.

    ``buckets`` is fixed when the table is made; take one bucket per some hundred MB of digests expected.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    @classmethod
    def create(cls, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        table = table or f"digest_index_{uuid.uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        empty = spark.createDataFrame([], SCHEMA)
        writer = empty.write.bucketBy(buckets, "digest").sortBy("digest").format("parquet")
        writer.option("path", path or stored_path(spark, table)).saveAsTable(table)
        index = cls(spark, table)
        index.buckets = buckets
        return index

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _bucket_count(self) -> int:
        if not hasattr(self, "buckets"):
            described = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").filter("col_name = 'Num Buckets'").collect()
            self.buckets = int(described[0]["data_type"])
        return self.buckets

    def add(self, digests: DataFrame) -> str:
        """Append the digests that are new and return the name of the batch.

        ``digests`` (doc_id, row, digest) must be a stored table. The smallest (doc_id, row) of equal
        digests is kept, null ids last. Adding the same batch again appends nothing.
        """
        batch = uuid.uuid4().hex
        first = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "row"))
        groups = digests.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
        fresh = groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", F.col("f.doc_id").alias("keep_id"), F.col("f.row").alias("keep_row"), "n", F.lit(batch).alias("batch"))
            .repartition(self._bucket_count(), "digest")
            .sortWithinPartitions("digest")
            .write.mode("append").format("parquet").bucketBy(self._bucket_count(), "digest").sortBy("digest").saveAsTable(self.table)
        )
        return batch

    def lookup(self) -> DataFrame:
        """The index without its buckets: a plain scan, so adaptive execution may split a hot digest of a join."""
        location = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").filter("col_name = 'Location'").collect()[0]["data_type"]
        return self.spark.read.schema(SCHEMA).parquet(location)


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, digest) of every document, stored; ``row`` tells repeated rows apart."""
    return stored(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_digest(F.col(text)).alias("digest")),
        "digests",
    )


def dedupe_groups(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Without an index, a new one takes the documents. Of equal texts the smallest doc_id stays: the earlier
    batch's where the index knew the text, and then no row of this batch. ``group_size`` counts the rows of the
    batch that first brought the text. A null text equals an empty one; a null id loses to any id; of rows
    that repeat an id one stays. Columns other than the two named are ignored. No rows give no rows.
    """
    index = index or DigestIndex.create(docs.sparkSession)
    rows = digest_rows(docs, doc_id, text)
    batch = index.add(rows)
    found = index.lookup().withColumnRenamed("digest", "__digest")
    kept = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
    return rows.join(found, F.col("digest") == F.col("__digest")).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def dedupe(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is new to the index, one row per text, all columns as they were.

    What goes is named by id and digest and taken out by an anti-join, so no text moves while that is a small
    table. Rows that repeat both id and text cannot be told apart so; of those, if any, one is picked.
    """
    index = index or DigestIndex.create(docs.sparkSession)
    rows = digest_rows(docs, doc_id, text)
    batch = index.add(rows)
    found = index.lookup().withColumnRenamed("digest", "__digest")
    kept = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
    pairs = rows.join(found, F.col("digest") == F.col("__digest")).groupBy("doc_id", "digest").agg(
        F.count_if(kept).alias("kept"), F.count(F.lit(1)).alias("n")
    )
    marked = stored(
        pairs.filter("kept = 0 or n > 1").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), (F.col("kept") > 0).alias("again")),
        "marked",
    )
    tagged = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("id"), text_digest(F.col(text)).alias("digest"))
    match = (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__id"))
    out = tagged.join(sized(marked), match, "left_anti").select("doc.*")
    again = marked.filter("again")
    if not again.isEmpty():
        one = tagged.join(again, match, "left_semi").dropDuplicates(["digest", "id"])
        out = out.unionByName(one.select("doc.*"))
    return out
