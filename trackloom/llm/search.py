"""Ranked lexical search for many queries at once, which share what they have in common."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm._storage import settle
from trackloom.llm._text import ALNUM, Words, row_blocks, same_words

#: A block of items ends beyond so many bytes of text or so many items; the documents are read once a block.
_BLOCK_BYTES, _BLOCK_ITEMS = 4 << 20, 4096
#: Of an item's nodes those held by most items take part in the search for shared pairs.
_WIDE = 32
#: Cells of the table of accumulators that a task holds.
_CELLS = 1 << 21


class Terms:
    """Different terms of some texts, numbered, found in other texts by hash and then by their bytes."""

    def __init__(self, texts: list[str | None]):
        _, data, offsets = next(row_blocks(pa.array(texts, pa.string()), 1 << 62))
        words = Words(data, offsets, ALNUM)
        self.keys, sample = np.unique(words.hashes, return_index=True)
        self.data, self.starts, self.ends = words.data, words.starts[sample], words.ends[sample]
        numbers = self.numbers(words)
        self.items = [numbers[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for others."""
        if not len(self.keys):
            return np.full(len(words.hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, words.hashes), len(self.keys) - 1)
        some = np.flatnonzero(self.keys[at] == words.hashes)
        same = same_words(words.data, words.starts[some], words.ends[some], self.data, self.starts[at[some]], self.ends[at[some]])
        out = np.full(len(words.hashes), -1, dtype=np.int64)
        out[some[same]] = at[some[same]]
        return out


class SharedSums:
    """A DAG of sums: leaves are (term, repeats), an inner node adds two nodes, an item adds its last nodes.

    Pairs of nodes that several items hold are mined round by round, most widely held first and each
    node in one pair a round; a pair becomes a node and takes the place of both in every item that
    holds them. So a set of terms that items share is added up once for all of them. Which pairs are
    mined changes the work, never a sum: an item's leaves below its nodes are always its own terms.
    """

    def __init__(self, items: list[np.ndarray]):
        leaves: dict[tuple[int, int], int] = {}
        held: list[set[int]] = []
        for item in items:
            terms, repeats = np.unique(item, return_counts=True)
            held.append({leaves.setdefault(leaf, len(leaves)) for leaf in zip(terms.tolist(), repeats.tolist(), strict=True)})
        self.leaves = np.array(list(leaves), dtype=np.int64).reshape(-1, 2)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = len(leaves)
        while shared := self._mine(held):
            for k, (a, b) in enumerate(shared):
                for item in held:
                    if a in item and b in item:
                        item -= {a, b}
                        item.add(nodes + k)
            nodes += len(shared)
            left, right = np.array(shared).T
            self.levels.append((left, right))
        self.nodes = nodes
        sizes = np.array([len(h) for h in held], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.filled = sizes > 0
        self.tops = np.array([n for h in held for n in sorted(h)], dtype=np.int64)

    @staticmethod
    def _mine(held: list[set[int]]) -> list[tuple[int, int]]:
        """Pairs that two items or more hold, no node in two of them."""
        support: dict[int, int] = {}
        for item in held:
            for n in item:
                support[n] = support.get(n, 0) + 1
        keys = []
        for item in held:
            wide = np.array(sorted(sorted((n for n in item if support[n] > 1), key=lambda n: (-support[n], n))[:_WIDE]), dtype=np.int64)
            i, j = np.triu_indices(len(wide), 1)
            keys.append(wide[i] << 32 | wide[j])
        found, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        taken: set[int] = set()
        out = []
        for k in np.argsort(-counts, kind="stable").tolist():
            if counts[k] < 2:
                break
            a, b = int(found[k] >> 32), int(found[k] & 0xFFFFFFFF)
            if a not in taken and b not in taken:
                taken |= {a, b}
                out.append((a, b))
        return out

    def totals(self, of_terms: np.ndarray) -> np.ndarray:
        """Each item's sum for each document: ``of_terms`` holds a row of values for each term."""
        values = np.empty((self.nodes, of_terms.shape[1]), dtype=np.int64)
        at = len(self.leaves)
        np.multiply(of_terms[self.leaves[:, 0]], self.leaves[:, 1:], out=values[:at])
        for left, right in self.levels:
            np.add(values[left], values[right], out=values[at : at + len(left)])
            at += len(left)
        out = np.zeros((len(self.filled), of_terms.shape[1]), dtype=np.int64)
        if len(self.tops):
            out[self.filled] = np.add.reduceat(values[self.tops], self.first[self.filled], axis=0)
        return out


def postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """doc_id, size (its terms with repeats), and which of ``terms`` each row of ``docs(doc_id, text)`` holds, how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # one block's, so a few megabytes

    def run(batches):
        terms = shared.value
        for batch in batches:
            names = batch.column("doc_id")
            for row, data, offsets in row_blocks(batch.column("text"), 1 << 20):
                words = Words(data, offsets, ALNUM)
                n = len(offsets) - 1
                number, of = terms.numbers(words), np.repeat(np.arange(n), np.diff(words.first))
                key, times = np.unique((of * max(1, len(terms)) + number)[number >= 0], return_counts=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, len(terms)), minlength=n))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key % max(1, len(terms))).astype(np.int32), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([names.slice(row, n), pa.array(np.diff(words.first).astype(np.int64)), *lists], ["doc_id", "size", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, terms array<int>, times array<long>")


def _best(scored: tuple[np.ndarray, ...], items: int, k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Of (item, score, missing, doc_id) rows each item's k first, and each item's k-th score, 0 if it has fewer."""
    item, score, missing, doc = scored
    order = np.lexsort((doc, missing, -score, item))
    begins = np.searchsorted(item[order], np.arange(items))
    order = order[np.arange(len(order)) - begins[item[order]] < k]
    kept = tuple(x[order] for x in scored)
    counts = np.bincount(kept[0], minlength=items)
    last = np.zeros(items, dtype=np.int64)
    full = counts >= k
    last[full] = kept[1][(np.cumsum(counts) - 1)[full]]
    return kept, last


def _ranked(found: DataFrame, sums: SharedSums, weights: np.ndarray, count: int, total: int, k: int) -> DataFrame:
    """(place, doc_id, score): the k best of each item within each partition of ``found``, which hold the k best of all."""
    shared = found.sparkSession.sparkContext.broadcast((sums, weights))
    items = len(sums.filled)

    def run(batches):
        sums, weights = shared.value
        width = max(1, min(1024, _CELLS // max(1, sums.nodes + items + len(weights))))
        kept, last = tuple(np.zeros(0, dtype=np.int64) for _ in range(4)), np.zeros(items, dtype=np.int64)
        for batch in batches:
            lists, names = batch.column("terms"), batch.column("doc_id")
            for at in range(0, batch.num_rows, width):
                terms, times = lists.slice(at, width), batch.column("times").slice(at, width).flatten().to_numpy()
                n = len(terms)
                size = batch.column("size").slice(at, width).to_numpy()
                of = np.repeat(np.arange(n), terms.value_lengths().to_numpy())
                term = terms.flatten().to_numpy()
                norm = 100 - 25 + (25 * size * count) // total
                values = np.zeros((len(weights), n), dtype=np.int64)
                values[term, of] = weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * norm[of]))
                scores = sums.totals(values)
                item, column = np.nonzero((scores > 0) & (scores >= last[:, None]))
                own = names.slice(at, width)
                missing, doc = own.is_null().to_numpy(zero_copy_only=False).astype(np.int64), own.fill_null(0).to_numpy()
                more = (item, scores[item, column], missing[column], doc[column])
                kept, last = _best(tuple(np.concatenate(x) for x in zip(kept, more, strict=True)), items, k)
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[3], mask=kept[2] == 1), pa.array(kept[1])], ["place", "doc_id", "score"])

    return found.where(F.size("terms") > 0).mapInArrow(run, "place long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of ``items`` in blocks of bounded size, so that neither the driver nor a task holds more."""
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        held += len(row.text or "")
        if held >= _BLOCK_BYTES or len(block) >= _BLOCK_ITEMS:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` rows of ``docs(doc_id, text)`` that score highest for each row of ``items(item_id, text)``.

    Terms are runs of digits, letters and non-ASCII signs, A-Z lower-cased. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), its value in a document weight * (10^9 tf div (1000 tf + 12 m))
    with m = 75 + 25 n N div L, in 64-bit integers; N counts the documents with terms, L all terms, n the
    document's, df the documents that hold the term. A score sums the values of an item's terms, repeats
    included. Scores of 0 are left out; equal ones go by doc_id, null last, so repeated rows rank beside
    each other. Null and empty texts have no terms: such items have no rows, such documents no rank.
    Repeated items are ranked each; without documents or items there are no rows; other columns are not read.

    Items come to the driver in blocks of bounded size. For a block the documents are read once, and the
    terms that they share with it are written to the shared folder; from there come the counts and the
    scores. Each partition adds up shared sets of terms once for all items of the block and hands on its k
    best of each item, so the shuffle carries at most k rows an item and partition, ranked in two steps.
    """
    spark = docs.sparkSession
    schema = f"place long, item_id {dict(items.dtypes)['item_id']}"
    out, told = spark.createDataFrame([], schema + ", rank int, doc_id long, score long").drop("place"), None
    for block in _blocks(items.select("item_id", F.col("text").cast("string").alias("text"))):
        terms = Terms([r.text for r in block])
        found = settle(postings(docs, terms), "postings")
        if told is None:
            told = found.where("size > 0").agg(F.count("*").alias("count"), F.sum("size").alias("total")).first()
        if not told["count"]:
            return out
        holders = np.zeros(len(terms), dtype=np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # as many rows as the block has terms
            holders[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * told["count"] + 2) / (2 * df + 1))) for df in holders.tolist()], dtype=np.int64)
        best = _ranked(found, SharedSums(terms.items), weights, told["count"], told["total"], k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = best.withColumn("salt", F.spark_partition_id() % 32)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("place", "salt").orderBy(*order))).where(F.col("rank") <= k)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], schema)
        out = out.union(best.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score"))
    return out
