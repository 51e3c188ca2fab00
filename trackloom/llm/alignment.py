"""Which tokens of two tokenizers cover the same bytes, by products of sparse incidence matrices."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm._storage import settle
from trackloom.llm._text import row_blocks
from trackloom.llm._tokens import piece_tokens
from trackloom.llm.byte_pairs import byte_pair_tokens


class CSR:
    """A sparse matrix by rows: row i has ``data`` at the columns ``indices[indptr[i]:indptr[i+1]]``."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, columns: int, data: np.ndarray | None = None):
        self.indptr, self.indices, self.columns = indptr, indices, columns
        self.data = np.ones(len(indices), dtype=np.int64) if data is None else data

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    @classmethod
    def of_ranges(cls, starts: np.ndarray, ends: np.ndarray, columns: int) -> CSR:
        """Row i is one at the columns from starts[i] to before ends[i]."""
        sizes = ends - starts
        indptr = np.concatenate([[0], np.cumsum(sizes)])
        return cls(indptr, np.arange(indptr[-1]) + np.repeat(starts - indptr[:-1], sizes), columns)

    @classmethod
    def of_one(cls, columns_of: np.ndarray, columns: int) -> CSR:
        """Row i is one at columns_of[i] only."""
        return cls(np.arange(len(columns_of) + 1), columns_of, columns)

    def transpose(self) -> CSR:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return CSR(indptr, self.row_of()[order], self.rows, self.data[order])

    def product_terms(self, other: CSR) -> np.ndarray:
        """The symbolic half of a product: how many terms each row of ``self @ other`` adds up."""
        terms = np.concatenate([[0], np.cumsum(np.diff(other.indptr)[self.indices])])
        return terms[self.indptr[1:]] - terms[self.indptr[:-1]]

    def __matmul__(self, other: CSR) -> CSR:
        """Gustavson's product: row i adds up the rows of ``other`` that row i's columns name, a run of rows at a time."""
        terms = np.concatenate([[0], np.cumsum(self.product_terms(other))])
        parts, sizes = [], np.zeros(self.rows, dtype=np.int64)
        at = 0
        while at < self.rows:
            end = max(at + 1, int(np.searchsorted(terms, terms[at] + _TERMS, side="right")) - 1)
            lo, hi = self.indptr[at], self.indptr[end]
            named = self.indices[lo:hi]
            counts = other.indptr[named + 1] - other.indptr[named]
            begins = np.cumsum(counts) - counts
            entry = np.arange(int(counts.sum())) + np.repeat(other.indptr[named] - begins, counts)
            row = np.repeat(np.repeat(np.arange(at, end), np.diff(self.indptr[at : end + 1])), counts)
            values = np.repeat(self.data[lo:hi], counts) * other.data[entry]
            keys = row * max(1, other.columns) + other.indices[entry]
            if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            sums = np.add.reduceat(values, first) if len(first) else values
            found = keys[first] // max(1, other.columns)
            sizes += np.bincount(found, minlength=self.rows)
            parts.append((keys[first] - found * max(1, other.columns), sums))
            at = end
        indices = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        data = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        return CSR(np.concatenate([[0], np.cumsum(sizes)]), indices, other.columns, data)


#: So many terms of a product are held at a time, unless one row has more.
_TERMS = 1 << 21


class Alignment:
    """Tokens of one stretch of bytes by two tokenizers, which both cover without gaps.

    ``overlaps`` is A times the transpose of B over bytes, its data the shared bytes; ``cuts`` are
    the offsets where tokens of both end, ``group_a`` and ``group_b`` the groups that they make.
    """

    def __init__(self, sizes_a: np.ndarray, sizes_b: np.ndarray):
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        n = int(ends_a[-1]) if len(ends_a) else 0
        self.bytes_a = CSR.of_ranges(ends_a - sizes_a, ends_a, n)
        self.bytes_b = CSR.of_ranges(ends_b - sizes_b, ends_b, n)
        self.overlaps = self.bytes_a @ self.bytes_b.transpose()
        ended = np.zeros(n + 1, dtype=bool)
        ended[ends_a] = True
        self.cuts = ends_b[ended[ends_b]]
        self.group_a, self.group_b = np.searchsorted(self.cuts, ends_a), np.searchsorted(self.cuts, ends_b)
        self.in_groups_a = CSR.of_one(self.group_a, len(self.cuts))
        self.in_groups_b = CSR.of_one(self.group_b, len(self.cuts))

    def shared_groups(self) -> CSR:
        """Links of all A and B tokens of a group, as a product; their number is a product of a group's sizes."""
        return self.in_groups_a @ self.in_groups_b.transpose()

    def shared_group_counts(self) -> np.ndarray:
        """The number of such links of each A token, without making them."""
        return self.in_groups_a.product_terms(self.in_groups_b.transpose())


class PieceBytes:
    """The bytes of each piece of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
        self.flat = np.frombuffer(b"".join(own), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in own], dtype=np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def token_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.places[ids] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Decimals:
    """Decimal texts of ids below ``n``, each with room for one sign behind it."""

    def __init__(self, n: int):
        own = [b"%d " % i for i in range(n)]
        self.flat = np.frombuffer(b"".join(own), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in own], dtype=np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def joined(self, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each with its sign, and where each begins."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.places[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
        out[ends[1:] - 1] = signs
        return out, ends


class Aligner:
    """Both tokenizers, and what a block of texts gives."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.pieces = byte_pair_tokens(path_a, specials=False), piece_tokens(path_b), PieceBytes(path_b)
        self.n_b = len(self.pieces.lengths)
        self.decimals = Decimals(max(self.a.n_ids, self.n_b))

    def block(self, texts: pa.Array) -> dict[str, list]:
        """Columns of ``aligned`` for some texts."""
        n = len(texts)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()))
        (_, want, at), (_, ids_a, of_a), (_, ids_b, of_b) = next(row_blocks(spaced, _ALL)), next(self.a.blocks(spaced, _ALL)), next(self.b.blocks(texts, _ALL))
        (raw_a, bytes_a), (raw_b, bytes_b) = self.a.token_bytes(ids_a), self.pieces.token_bytes(ids_b)
        want, raw_a, raw_b = want.tobytes(), raw_a.tobytes(), raw_b.tobytes()
        cut_a, cut_b, at = bytes_a[of_a].tolist(), bytes_b[of_b].tolist(), at.tolist()
        equal = [at[i + 1] - at[i] > 1 and raw_a[cut_a[i] : cut_a[i + 1]] == want[at[i] : at[i + 1]] == raw_b[cut_b[i] : cut_b[i + 1]] for i in range(n)]
        equal = np.array(equal, dtype=bool)
        n_a, n_b = np.where(equal, np.diff(of_a), 0), np.where(equal, np.diff(of_b), 0)
        keep_a, keep_b = np.repeat(equal, np.diff(of_a)), np.repeat(equal, np.diff(of_b))
        ids_a, ids_b = ids_a[keep_a].astype(np.int64), ids_b[keep_b].astype(np.int64)
        doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        found = Alignment(np.diff(bytes_a)[keep_a], np.diff(bytes_b)[keep_b])

        links = found.overlaps
        row = links.row_of()
        key = doc_a[row] * (self.a.n_ids * self.n_b) + ids_a[row] * self.n_b + ids_b[links.indices]
        key, times = np.unique(key, return_counts=True)
        pair_doc = key // (self.a.n_ids * self.n_b)
        pairs = key - pair_doc * (self.a.n_ids * self.n_b)
        ends = np.concatenate([[0], np.cumsum(np.bincount(pair_doc, minlength=n))]).astype(np.int32)
        total = lambda values, docs: np.bincount(docs, weights=values, minlength=n).astype(np.int64)
        first_of = np.searchsorted(found.group_a, np.arange(len(found.cuts)))
        return {
            "n_a": pa.array(n_a.astype(np.int64)),
            "n_b": pa.array(n_b.astype(np.int64)),
            "n_groups": pa.array(np.bincount(doc_a[first_of], minlength=n).astype(np.int64)),
            "n_links": pa.array(total(np.diff(links.indptr), doc_a)),
            "n_group_links": pa.array(total(found.shared_group_counts(), doc_a)),
            "groups_sha256": pa.array(self._digests(found, ids_a, ids_b, doc_a, doc_b, equal)),
            "pairs": pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs)),
            "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
        }

    def _digests(self, found: Alignment, ids_a, ids_b, doc_a, doc_b, equal) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text's groups, digested."""
        part = np.concatenate([2 * found.group_a, 2 * found.group_b + 1])
        order = np.argsort(part, kind="stable")
        ids, part, doc = np.concatenate([ids_a, ids_b])[order], part[order], np.concatenate([doc_a, doc_b])[order]
        signs = np.full(len(ids), ord(","), dtype=np.uint8)
        turn = np.flatnonzero(part[1:] != part[:-1])
        signs[turn] = np.where(part[turn] % 2 == 0, ord("|"), ord(";"))
        text, ends = self.decimals.joined(ids, signs)
        text, ends = text.tobytes(), ends[np.searchsorted(doc, np.arange(len(equal) + 1))].tolist()
        return [hashlib.sha256(text[a : b - 1]).hexdigest() if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], equal.tolist(), strict=True)]


_ALL = 1 << 62


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, kept from task to task."""
    return Aligner(path_a, path_b)


ALIGNED = "doc_id long, place long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, path_a: str, path_b: str, block: int = 1 << 20) -> DataFrame:
    """Each row of ``docs(doc_id, text, place)`` with its counts, the digest of its groups, the different id pairs that it links and how often.

    A pair of ids a, b is the number a * (ids of B) + b.
    """
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches):
        align = _aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column("text")
            for at, _, offsets in row_blocks(texts, block):
                size = len(offsets) - 1
                found = align.block(texts.slice(at, size))
                own = {"doc_id": batch.column("doc_id").slice(at, size), "place": batch.column("place").slice(at, size)} | found
                yield pa.RecordBatch.from_arrays([own[c] for c in names], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "place").mapInArrow(run, ALIGNED)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, heavy: int = 500_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best and count_sum.

    A encodes a space and the text, B, which adds a space, the text; both as plain text. Tokens
    whose bytes overlap are linked; an id pair counts in as many rows as link it. n_best are links
    whose pair counts most of its A id's pairs, ties included, and count_sum adds up the counts of
    all links. Null and empty texts, and those whose tokens do not give their bytes, have zeros and
    an empty digest. Repeated rows count each; null doc_ids are rows like others; other columns are
    not read; no rows give no rows.

    Each text is tokenised once; its different pairs are written to the shared folder. Counts are
    summed before the shuffle and are bounded by the vocabularies, not by the texts. At most
    ``heavy`` pairs of the highest counts are broadcast; links of all others meet their counts in a
    shuffled join.
    """
    n_b = _pieces_of(path_b)
    places = settle(aligned(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")), path_a, path_b), "aligned")
    counts = places.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    most = F.max("count").over(W.partitionBy(F.floor(F.col("pair") / n_b)))
    counts = settle(counts.select("pair", "count", (F.col("count") == most).alias("best")), "pairs")

    steps = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("step")).count().collect()  # at most 63 rows
    least, held = None, 0
    for step in sorted(steps, key=lambda r: -r.step):
        if held + step["count"] > heavy:
            break
        least, held = 2**step.step, held + step["count"]
    links = places.select("place", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("place", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    told = [F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    if held == sum(s["count"] for s in steps):
        met = links.join(F.broadcast(counts), "pair")
    else:
        top = counts.where(F.col("count") >= least) if least else counts.limit(0)
        met = links.join(F.broadcast(top), "pair", "left")
        rest = met.where("count is null").select("place", "pair", "times").join(counts.where(F.col("count") < (least or 1 << 62)), "pair")
        met = met.where("count is not null").select("place", "times", "count", "best").union(rest.select("place", "times", "count", "best"))
    sums = met.groupBy("place").agg(*told)
    out = places.drop("pairs", "times").join(sums, "place", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def _pieces_of(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
