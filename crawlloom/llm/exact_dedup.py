"""Exact dedup by a keyed streaming state that lives on disk and never expires.

The texts' digests run as a stream into an aggregation whose state, one row for each digest, is held by RocksDB and
checkpointed to a folder: digest -> stable identifier of the row that stays, locator of its content (the file that it
was read from, by number), the content's length and the size of the group. Spark sums up each task's rows before they
are dealt by digest, so a text that a third of the rows hold costs one row a task. The state's changes are written batch
by batch under the batch's number; a batch that is run again after a failure overwrites its own files, and a state is
taken up again by another process from its folder. As a feed's hits arrive, their whole bytes are compared with the
content that stays; texts that share a digest but differ (a collision) are grouped anew by their whole bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


STATE = "digest string, keep_id long, place long, n_bytes long, group_size long, batch long"
SPOOL = "id long, digest string, n_bytes long, place long"


class ExactDedup:
    """A streaming dedup in a folder that all executors see. feed() takes one more table of rows; state() and groups()
    tell what all tables so far have come to. A later process goes on with the same folder.

    id_column: a stable integer identifier; of equal texts the row with the largest stays. Rows that repeat an
    identifier and text count as rows of the group. known: the tables fed before, by earlier processes, from which kept
    contents are fetched. files_per_trigger bounds a micro-batch.
    """

    def __init__(self, ws: Workspace, id_column: str = "doc_id", text_column: str = "text", files_per_trigger: int = 1000, known: Iterable[DataFrame] = ()):
        self.ws, self.id, self.text, self.files = ws, id_column, text_column, files_per_trigger
        self.tables = [self.texts(t) for t in known]

    def texts(self, docs: DataFrame) -> DataFrame:
        norm = ascii_lower(F.col(self.text))
        return docs.select(F.col(self.id).cast("long").alias("id"), F.sha2(norm, 256).alias("digest"), norm.alias("body"), F.input_file_name().alias("file"))

    def feed(self, docs: DataFrame, name: str | None = None) -> None:
        """Run the rows through the state, and compare the bytes of hits. name: a name of this table's own, under which a
        feed that was cut short can be run again; what it has spooled then counts once. The spool holds identifier,
        digest, length and locator, not the texts."""
        name = name or uuid.uuid4().hex
        own, before = self.texts(docs), self.state() if self.ws.exists("changes") else None
        if not self.ws.exists(f"spool/{name}/_SUCCESS"):
            rows = own.select("id", "digest", F.octet_length("body").cast("long").alias("n_bytes"), F.xxhash64("file").alias("place"))
            rows.write.mode("overwrite").parquet(self.ws.at(f"spool/{name}"))
            own.select(F.xxhash64("file").alias("place"), "file").distinct().write.mode("overwrite").parquet(self.ws.at(f"files/{name}"))
        self._drain()
        self._compare(own, before, name)
        self.tables.append(own)

    def _drain(self) -> None:
        session = self.ws.spark.newSession()  # the stream's settings stay out of the caller's session
        for key, value in {
            "spark.sql.shuffle.partitions": self.ws.spark.conf.get("spark.sql.shuffle.partitions"),
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
            "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's logs take up disk ahead of need
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.session.timeZone": "UTC",
        }.items():
            session.conf.set(key, value)
        rows = session.readStream.schema(SPOOL).options(maxFilesPerTrigger=self.files, recursiveFileLookup="true").parquet(self.ws.at("spool"))
        state = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.max_by("place", "id").alias("place"), F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("group_size"))
        log = self.ws.at("changes")

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", self.ws.at("stream")).trigger(availableNow=True).start()
        query.awaitTermination()

    def state(self) -> DataFrame:
        """(digest, keep_id, place, group_size) as the state holds them: a digest's last change, the largest group. place
        is the number of the file that the row that stays was read from; see files()."""
        changes = self.ws.spark.read.schema(STATE).parquet(self.ws.at("changes"))
        return changes.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max_by("place", "group_size").alias("place"), F.max("group_size").alias("group_size"))

    def files(self) -> DataFrame:
        """(place, file) of the locators; file is empty where a table was read from no files."""
        return self.ws.spark.read.schema("place long, file string").option("recursiveFileLookup", "true").parquet(self.ws.at("files")).distinct()

    def _compare(self, own: DataFrame, before: DataFrame | None, name: str) -> None:
        """Write the digests under which this feed has brought other bytes than the content that stays has."""
        state = self.ws.save(self.state(), f"state-{name}")
        many = state.where("group_size > 1")
        hits = own.join(many, "digest").select("digest", "id", "body", "keep_id")
        if before is not None:  # contents that stayed so far, fetched by locator and identifier
            held = many.join(own.select("digest"), "digest", "left_semi").join(before.select("digest", F.col("keep_id").alias("was"), F.col("place").alias("at")), "digest")
            for t in self.tables:
                known = t.withColumn("own", F.xxhash64("file"))
                hits = hits.unionByName(known.join(held, "digest").where((F.col("own") == F.col("at")) & F.col("id").eqNullSafe(F.col("was"))).select("digest", "id", "body", "keep_id"))
        hits = self.ws.save(hits, f"hits-{name}")
        stays = hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("body").alias("kept_body"))
        stays = self.ws.save(stays, f"contents-{name}")  # a table on either side of the join, so that Spark can split a large group
        if before is not None:  # or else the content that stays came earlier: any of the feed's will do, as that is among the hits
            rest = hits.join(stays, "digest", "left_anti").groupBy("digest").agg(F.max("body").alias("kept_body"))
            stays = self.ws.save(stays.unionByName(rest), f"all-contents-{name}")
        # Written before it is made distinct: a distinct on the join's own key would keep Spark from splitting the join.
        self.ws.save(hits.join(stays, "digest").where("body <> kept_body").select("digest"), f"clashes/{name}")
        self.ws.drop(f"hits-{name}", f"contents-{name}", f"all-contents-{name}")

    def groups(self) -> DataFrame:
        """(id, keep_id, group_size, digest) of every row fed so far."""
        spark = self.ws.spark
        spool = spark.read.schema(SPOOL).option("recursiveFileLookup", "true").parquet(self.ws.at("spool")).select("id", "digest")
        state = self.ws.save(self.state().select("digest", "keep_id", "group_size"), "state")
        clash = spark.read.schema("digest string").option("recursiveFileLookup", "true").parquet(self.ws.at("clashes")).distinct()
        clash = self.ws.save(clash, "clash")
        if clash.isEmpty():
            return spool.join(state, "digest").select("id", "keep_id", "group_size", "digest")
        # Two texts under one digest: those are grouped by their whole bytes.
        parts = reduce(DataFrame.unionByName, self.tables).select("digest", "id", "body").join(clash, "digest", "left_semi")
        true = parts.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        mixed = parts.join(true, ["digest", "body"]).select("id", "keep_id", "group_size", "digest")
        return spool.join(clash, "digest", "left_anti").join(state, "digest").select(*mixed.columns).unionByName(mixed)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "exact") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Equal: identical after lower-casing A-Z; a null text counts as empty. The largest identifier stays (a null
    identifier is the smallest); if it is repeated with the same text, each of those rows is marked kept. An empty
    table gives no rows. Other columns are ignored, so clashing names don't matter.
    """
    dedup = ExactDedup(Workspace(docs.sparkSession, name), id_column, text_column)
    dedup.feed(docs)
    return dedup.groups().select(
        F.col("id").alias(id_column), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )
