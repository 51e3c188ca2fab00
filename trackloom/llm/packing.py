"""Packing tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._storage import settle
from trackloom.llm._tokens import word_tokens


class TournamentTree:
    """Free space of open bins, each inner node holding the larger of its children.

    ``first_fit(size)`` walks down from the root to the leftmost bin with room for ``size``,
    takes the room and repairs the path: O(log bins) instead of a scan.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """(bin, free space before)."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        free = best[node]
        at = node
        best[at] = free - size
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return node - self.leaves, free


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every size, none above ``capacity``; the largest are placed first, equals in the given order."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    tree = TournamentTree(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], free = tree.first_fit(int(sizes[i]))
        offsets[i] = capacity - free
    return bins, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` and cut each into pieces of ``length`` ids and a rest.

    A null or empty text is just the end id. ``draw`` is a pseudo-random number of the piece's
    document row, from its place in the input, so that repeated rows spread too.
    """

    def cut(batches):
        from pyspark import TaskContext

        encode = word_tokens(tokenizer)
        random = np.random.Generator(np.random.PCG64([17, TaskContext.get().partitionId()]))
        stop = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            names = batch.column("doc_id")
            for row, ids, ends in encode.blocks(batch.column("text")):
                ids = ids.astype("<u4")
                out = []
                for i, draw in enumerate(random.integers(0, 1 << 62, size=len(ends) - 1).tolist()):
                    own, total = ids[ends[i] : ends[i + 1]].tobytes() + stop, int(ends[i + 1] - ends[i]) + 1
                    for start in range(0, total, length):
                        size = min(length, total - start)
                        out.append((row + i, start, size, zlib.crc32(own[4 * start : 4 * (start + size)]), total, draw))
                if out:
                    at, *rest = (np.array(c, dtype=np.int64) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at)).cast(pa.int64()), *map(pa.array, rest)], PIECE_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, group_rows: int = 8192) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids (its text's by ``tokenizer``, then ``end``) lie in exactly one piece each.
    Whole pieces of ``length`` ids are sequences of their own; the rests are dealt at random into
    groups of about ``group_rows``, and each group packs its own by first-fit decreasing with a
    tournament tree, so groups need nothing of one another and more data makes more groups.
    A sequence is filled without gaps from offset 0; what it lacks of ``length`` is padding,
    little in all but each group's last. Pieces are written to the shared folder before they are
    dealt, so a lost executor costs no second tokenising. Null doc_id stays null; rows with the
    same doc_id are packed each on its own; no rows give no rows; other columns are not read.
    """
    pieces = settle(token_pieces(docs, tokenizer, length, end), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("start", "ascending")])
        group = table.column("group")[0].as_py()
        sizes = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(sizes, length)
        table = table.append_column("sequence_id", pa.array((np.int64(group) << 32) + bins))
        return table.append_column("offset", pa.array(offsets)).select(PACKED_NAMES)

    dealt = pieces.withColumn("group", F.pmod("draw", F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, PACKED)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]
