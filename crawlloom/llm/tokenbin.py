"""Token ids in ORC: run-length coded stripes, row indexes and Bloom filters on the document id.

Documents are dealt by ranges of doc_id, sorted, encoded and written; a file is one range, so files in the order of
their part number hold the documents in ascending order. A row holds up to PIECE_IDS ids of one document together with
its place in the part, so a document is found by its stripe's statistics and Bloom filter, stripes can be read in
parallel in any order, and a document's place in the whole follows from its part's total, of which there are as many
as parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, text_buffer, tokenizer_path
from .encode import encoder, list_array, with_end

#: Ids in one row at most: longer documents are written as several rows.
PIECE_IDS = 1 << 18
SCHEMA = "doc_id long, part int, ordinal long, piece int, n_pieces int, start_in_part long, n_tokens long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every whole text, append end_id and write the ids in ascending order of the identifier.

    A null or empty text gives just end_id. Rows with equal identifiers are ordered by their texts; a null identifier
    comes first. An empty table writes no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, start, ordinal = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in slices(batch, "text"):
                ids, offs = with_end(*code.encode(*text_buffer(some.column("text"))), end_id)
                lengths = np.diff(offs)
                begins = start + offs[:-1]
                n_pieces = -(-lengths // PIECE_IDS)
                row = np.repeat(np.arange(len(lengths)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                cuts = np.concatenate([offs[:-1][row] + piece * PIECE_IDS, offs[-1:]])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(pa.array(row)), pa.array(np.full(len(row), part), pa.int32()), pa.array(ordinal + row, pa.int64()),
                        pa.array(piece, pa.int32()), pa.array(n_pieces[row], pa.int32()), pa.array(begins[row], pa.int64()), pa.array(lengths[row], pa.int64()),
                        list_array(ids, cuts),
                    ],
                    names=["doc_id", "part", "ordinal", "piece", "n_pieces", "start_in_part", "n_tokens", "ids"],
                )
                start += int(offs[-1])
                ordinal += len(lengths)

    options = {"orc.compress": "ZSTD", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.mapInArrow(run, SCHEMA).write.mode("overwrite").options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; a filter on doc_id is answered by stripe statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _crc(data: bytes, so_far: int = 0) -> int:
    return zlib.crc32(data, so_far)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""
    rows = read_token_orc(spark, path)
    sizes = rows.where("piece = 0").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a part
    base, total = {}, 0
    for r in sizes:
        base[r["part"]], total = total, total + r["n"]

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, offs = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            crc = [_crc(flat[offs[k] : offs[k + 1]].tobytes()) for k in range(b.num_rows)]
            start = [base[p] + s for p, s in zip(b.column("part").to_pylist(), b.column("start_in_part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(start, pa.int64()), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def long(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, crc = pdf.sort_values("piece"), 0
        for ids in pdf["ids"]:
            crc = _crc(np.asarray(ids, "<u4").tobytes(), crc)
        one = pdf.iloc[:1]
        return pd.DataFrame({"doc_id": one["doc_id"], "start": one["start_in_part"] + base[int(one["part"].iloc[0])], "n_tokens": one["n_tokens"], "ids_crc32": [crc]})

    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    whole = rows.where("n_pieces = 1").select("doc_id", "part", "start_in_part", "n_tokens", "ids").mapInArrow(short, out)
    return whole.unionByName(rows.where("n_pieces > 1").groupBy("part", "ordinal").applyInPandas(long, out))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; only stripes whose Bloom filters may hold them are decoded."""
    return read_token_orc(spark, path).where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "piece", "ids").orderBy("doc_id", "piece")


def token_orc(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write docs in the format and give the index that is read back from the files."""
    ws = Workspace(docs.sparkSession, "tokenbin")
    write_token_orc(docs, ws.at("orc"), tokenizer or tokenizer_path(), end_id)
    ws.release()
    return document_index(docs.sparkSession, ws.at("orc"))
