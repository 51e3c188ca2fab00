"""Token counts of flat, unindexed token files by a scan for separators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm._storage import shared_folder
from trackloom.llm._tokens import piece_tokens

_FILE_BYTES = 4 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 2, file_bytes: int | None = None) -> None:
    """Tokenise ``docs(doc_id, text)`` into flat files of little-endian unsigned 16-bit ids, each text's ids closed by ``end``.

    Written by Spark's text sink, a file a record, so its commit protocol decides which files
    count; the last separator of a file is the one that the sink adds. A file is closed by the first
    text to end beyond ``file_bytes``, so that none grows with a partition. Each token file, of even
    number, is followed by one of odd number that lists the doc_ids of its texts in their order: token
    files themselves know no documents. A null or empty text is just its separator. ``end`` must never
    be an id within a text and be below 128.
    """
    limit = file_bytes or _FILE_BYTES

    def run(batches):
        encode = piece_tokens(tokenizer)
        ids_held, names_held, held = [], [], 0

        def close():
            names = pa.chunked_array(names_held).combine_chunks()
            listed = names.fill_null(0).to_numpy().astype("<i8").tobytes() + names.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            tokens = np.concatenate(ids_held)[:-1].tobytes()
            return pa.RecordBatch.from_arrays([pa.array([tokens, listed], pa.binary())], ["value"])

        for batch in batches:
            names = batch.column("doc_id")
            for row, ids, ends in encode.blocks(batch.column("text")):
                ids_held.append(np.insert(ids.astype("<u2"), ends[1:], end))
                names_held.append(names.slice(row, len(ends) - 1))
                held += ids_held[-1].nbytes
                if held >= limit:
                    yield close()
                    ids_held, names_held, held = [], [], 0
        if ids_held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", int(end).to_bytes(2, "little").decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def scan_separators(block: np.ndarray, end: int) -> tuple[int, int, np.ndarray]:
    """Of one block: ids before the first separator, ids after the last, and the places of all separators."""
    at = np.flatnonzero(block == end)
    if not len(at):
        return len(block), len(block), at
    return int(at[0]), len(block) - 1 - int(at[-1]), at


def file_place(name: Column) -> tuple[Column, Column]:
    """Number of the task that wrote a file, and of the file among that task's; the job's id between them may look like either."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)(?:\.[^.]+)*$", 1).cast("long")


_BLOCK = "name string, block long, size long, closed long, head long, tail long, inner array<long>, ends array<long>, listed array<long>"


def _scanned(spark: SparkSession, path: str, end: int, block_ids: int) -> DataFrame:
    """A row for each block of each token file, and one for each list of doc_ids."""
    fields = [("block", pa.int64()), *[(c, pa.int64()) for c in ("size", "closed", "head", "tail")], *[(c, pa.list_(pa.int64())) for c in ("inner", "ends", "listed")]]
    nothing = (None,) * 6

    def run(batches):
        for batch in batches:
            for name, odd, data in zip(batch.column("name").to_pylist(), batch.column("odd").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                if odd:
                    n = (len(raw) - 2) // 9
                    listed = pa.array(raw[: 8 * n].view("<i8"), mask=raw[8 * n : 9 * n] == 0)
                    rows = [(None, *nothing, listed)]
                else:
                    ids, rows = raw.view("<u2"), []
                    for k in range(0, max(1, len(ids)), block_ids):
                        block = ids[k : k + block_ids]
                        head, tail, at = scan_separators(block, end)
                        rows.append((k // block_ids, len(block), len(at), head, tail, np.diff(at) - 1, at[1:] - at[:1], None))
                columns = [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *columns], ["name", *[f for f, _ in fields]])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    files = files.select("name", (file_place(F.col("name"))[1] % 2 == 1).alias("odd"), "content")
    return files.mapInArrow(run, _BLOCK)


def scan_token_files(spark: SparkSession, path: str, end: int = 2, block_ids: int = 1 << 16) -> DataFrame:
    """doc_id, stream, ordinal, start and n_tokens of every closed document of the files that ``write_token_files`` wrote.

    Files of one writing task form a stream, in the order of their numbers; a document may run over
    any number of blocks. Each block is scanned on its own, vectorised; then a prefix scan over a
    stream's blocks gives each block the number of documents closed and the ids left open before
    it, which stitches the documents that cross a boundary. The k-th separator of a file closes the
    k-th doc_id of its list; where their numbers differ the query fails.
    """
    blocks = _scanned(spark, path, end, block_ids)
    stream, file = file_place(F.col("name"))
    blocks = blocks.withColumn("stream", stream).withColumn("file", F.floor(file / 2))
    one = W.partitionBy("stream", "file")
    blocks = blocks.withColumn("listed", F.first("listed", ignorenulls=True).over(one)).withColumn("in_file", F.sum("closed").over(one)).where("block is not null")
    listed = F.when(F.col("in_file") == F.coalesce(F.size("listed"), F.lit(0)), F.col("listed")).when(F.col("in_file") > 0, F.raise_error(F.lit("doc_ids and token files differ")).cast("array<bigint>"))
    before, before_here = W.partitionBy("stream").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1), one.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    scanned = blocks.withColumn("names", F.slice(listed, (F.coalesce(F.sum("closed").over(before_here), zero) + 1).cast("int"), F.col("closed").cast("int"))).drop("listed")
    scanned = scanned.withColumn("begin", F.coalesce(F.sum("size").over(before), zero)).withColumn("closed_before", F.coalesce(F.sum("closed").over(before), zero))
    last = F.when(F.col("closed") > 0, F.col("begin") + F.col("size") - F.col("tail"))
    scanned = scanned.withColumn("last", last).withColumn("open_from", F.coalesce(F.max("last").over(before), zero)).where("closed > 0")
    first = F.col("begin") + F.col("head") - F.col("open_from")
    zipped = F.arrays_zip("names", F.concat(F.array(first), "inner").alias("n"), F.concat(F.array(zero), "ends").alias("ends"))
    counts = scanned.select("stream", "closed_before", "open_from", (F.col("begin") + F.col("head")).alias("first_sep"), zipped.alias("counts"))
    told = counts.select("stream", "closed_before", "open_from", "first_sep", F.posexplode("counts").alias("k", "of")).select("*", "of.*")
    start = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("first_sep") + F.col("ends") - F.col("n"))
    return told.select(F.col("names").alias("doc_id"), F.col("n").alias("n_tokens"), "stream", (F.col("closed_before") + F.col("k")).alias("ordinal"), start.alias("start"))


def count_tokens(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id, n_tokens, stream, ordinal and start of every row of ``docs(doc_id, text)``, counted from its token files.

    Each row's doc_id is written beside the file that holds its ids, by the same task, so the order in
    which rows arrive, shuffled or not, does not matter. Null texts count 0 ids, null and repeated
    doc_ids are rows like others, no rows give no rows, other columns are not read.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    write_token_files(docs, path, tokenizer, end)
    return scan_token_files(spark, path, end)
