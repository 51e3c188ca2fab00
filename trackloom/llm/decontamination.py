"""Benchmark decontamination: training shards indexed, test phrases searched backwards."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm._storage import settle
from trackloom.llm._text import ALNUM, LOWER, Words, hash_words, row_blocks
from trackloom.llm.fm_index import FMIndex

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_CAPITALS = {c: c + 32 for c in range(65, 91)}


class Phrases:
    """The windows of ``size`` words of some benchmark items; an item with fewer words is one window."""

    def __init__(self, items: list[tuple[object, str]], size: int):
        windows: dict[tuple[str, ...], set[str]] = {}
        for name, text in items:
            words = _WORD.findall((text or "").translate(_CAPITALS))
            for at in range(max(1, len(words) - size + 1) if words else 0):
                windows.setdefault(tuple(words[at : at + size]), set()).update([] if name is None else [str(name)])
        vocabulary = sorted({w for window in windows for w in window})
        hashes = hash_words(vocabulary, ALNUM) if vocabulary else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [vocabulary[i].encode() for i in order]
        ids = {vocabulary[i]: k + 1 for k, i in enumerate(order)}
        self.patterns, self.items = [], []
        for length in sorted({len(w) for w in windows}):
            same = [w for w in windows if len(w) == length]
            self.patterns.append(np.array([[ids[x] for x in w] for w in same], dtype=np.int64))
            self.items.append([sorted(windows[w]) for w in same])
        self.shortest = min((p.shape[1] for p in self.patterns), default=0)
        self.longest = max((p.shape[1] for p in self.patterns), default=0)
        self.filter = np.zeros(1 << 18, dtype=bool)
        self.filter[self.hashes & np.uint64((1 << 18) - 1)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the words that occur in a phrase, 0 for all others."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.filter[hashes & np.uint64((1 << 18) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == hashes[maybe], at + 1, 0)
        return out


def _occurrences(symbols: np.ndarray, first: np.ndarray, phrases: Phrases, shard: int):
    """(word position, length, names of items) of all occurrences, by one FM-index for each ``shard`` symbols.

    A phrase consists of known words, so unknown words are breaks, and runs of known words
    shorter than the shortest phrase are left out of the index text: they can hold no occurrence, so
    this loses none and keeps the index small. The index is therefore of one block of phrases.
    """
    known = np.zeros(len(symbols) + 2, dtype=bool)
    known[1:-1] = symbols > 0
    cuts = np.unique(first)
    cuts = cuts[(cuts > 0) & (cuts < len(symbols))]
    joined = cuts[known[cuts] & known[cuts + 1]]
    points = np.flatnonzero(known[1:] != known[:-1])
    points = np.sort(np.concatenate([points, joined, joined]))
    starts, ends = points[::2], points[1::2]
    keep = ends - starts >= phrases.shortest
    runs = []
    for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
        while b - a > shard:  # a longer run goes to several shards that overlap by a phrase less one word
            runs.append((a, a + shard))
            a += shard - phrases.longest + 1
        runs.append((a, b))
    at = 0
    while at < len(runs):
        end, total = at, 0
        while end < len(runs) and (end == at or total + runs[end][1] - runs[end][0] < shard):
            total += runs[end][1] - runs[end][0] + 1
            end += 1
        place = np.concatenate([np.arange(a, b + 1) for a, b in runs[at:end]])
        text = symbols[np.minimum(place, len(symbols) - 1)]
        text[np.cumsum([b - a + 1 for a, b in runs[at:end]]) - 1] = 0
        index = FMIndex(text)
        for patterns, items in zip(phrases.patterns, phrases.items, strict=True):
            low, high = index.search(patterns)
            count = high - low
            which = np.repeat(np.arange(len(patterns)), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]
            yield place[index.locate(rows)], patterns.shape[1], which, items
        at = end


def _search_block(data, offsets, phrases: Phrases, shard: int):
    words = Words(data, offsets, ALNUM)
    symbols, first = phrases.symbols(words.hashes), words.first
    n = len(symbols)
    edge = np.zeros(n + 1, dtype=np.int64)
    names: dict[int, set[str]] = {}
    checked: dict[int, bool] = {}

    def same(i: int) -> bool:  # equal hashes, equal words?
        if i not in checked:
            checked[i] = LOWER[data[words.starts[i] : words.ends[i]]].tobytes() == phrases.words[symbols[i] - 1]
        return checked[i]

    if n and phrases.patterns:
        for places, length, which, items in _occurrences(symbols, first, phrases, shard):
            docs = np.searchsorted(first, places, side="right") - 1
            for p, k, d in zip(places.tolist(), which.tolist(), docs.tolist(), strict=True):
                if all(same(i) for i in range(p, p + length)):
                    edge[p] += 1
                    edge[p + length] -= 1
                    names.setdefault(d, set()).update(items[k])
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    return words, hit, total[first[1:]] - total[first[:-1]], names


def _spans(data, offset: int, words: Words, hit: np.ndarray, a: int, b: int) -> list[dict]:
    """Merged runs of hit words of one text, in code points."""
    at = np.flatnonzero(hit[a:b]) + a
    breaks = np.flatnonzero(np.diff(at) > 1)
    begins, ends = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
    end = int(words.ends[ends[-1]])
    points = np.concatenate([[0], np.cumsum((data[offset:end] & 0xC0) != 0x80)])
    return [{"start": int(points[words.starts[i] - offset]), "end": int(points[words.ends[j] - offset])} for i, j in zip(begins, ends, strict=True)]


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.LongType())]))),
])


def _blocks_of(benchmark: DataFrame, limit: int):
    """Items in blocks of at most ``limit`` characters, fetched partition by partition as they are asked for."""
    block, size = [], 0
    for name, text in benchmark.select("item_id", "text").toLocalIterator():
        if block and size + len(text or "") > limit:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text or "")
    yield block


def find_phrases(docs: DataFrame, benchmark: DataFrame, size: int = 13, shard: int = 1 << 18, block_chars: int = 8 << 20, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns n_words, n_hit, n_items, items, items_sha256, contaminated and spans.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A phrase is ``size``
    consecutive words of an item, or the whole item if it has fewer. Each task indexes its texts in
    shards of at most ``shard`` words with an FM-index, searches all phrases at once and merges the
    hit words into removal spans (code points, end exclusive). contaminated: n_hit > 0 and
    20 * n_hit >= n_words. Null and empty texts have no words; null item texts no phrases; repeated
    rows each get their result; the phrases of a null item_id are hit, but there is no id to list; no items
    flag nothing; other columns stay, and a column of the same name as one of these is replaced.

    Without ``keep_text`` the text does not come back from the Python workers.
    The phrases are broadcast in blocks of ``block_chars`` characters. A benchmark of several blocks is
    searched block after block, the findings so far written to the shared folder in between, so that
    the driver and a task hold one block at a time whatever the benchmark's size.
    """
    own = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"]
    docs = docs.drop(*own)
    columns = docs.columns if keep_text else [c for c in docs.columns if c != "text"]
    rest = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"], F.lit(0).alias("_")).alias("_row"), F.lit(None).cast(_FOUND).alias("_found"))
    blocks = _blocks_of(benchmark, block_chars)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, size))
        rest = _search(rest, shared, shard, keep_text or following is not None)
        if following is not None:
            rest = settle(rest, "findings")
            shared.unpersist()
        block = following
    found = rest.select(*(["text"] if keep_text else []), "_row.*", "_found.*")
    items = F.array_join(F.array_sort("items"), ",")
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        *[F.col(c) for c in columns], "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(items, 256).alias("items_sha256"), ((hits > 0) & (20 * hits >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def _search(rest: DataFrame, shared, shard: int, keep_text: bool) -> DataFrame:
    schema = T.StructType([f for f in rest.schema if keep_text or f.name != "text"])
    found_type = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])))])

    def run(batches):
        phrases = shared.value
        for batch in batches:
            text = batch.column("text")
            before = batch.column("_found").to_pylist() if batch.column("_found").null_count < batch.num_rows else [None] * batch.num_rows
            out = []
            for row, data, offsets in row_blocks(text, 4 << 20):
                words, hit, n_hit, names = _search_block(data, offsets, phrases, shard)
                counts = np.diff(words.first)
                for i in range(len(offsets) - 1):
                    spans = []
                    if n_hit[i]:
                        a, b = words.first[i], words.first[i + 1]
                        spans = _spans(data, int(offsets[i]), words, hit, a, b)
                        runs = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                        for s, w in zip(spans, runs[1::2] - runs[::2], strict=True):
                            s["words"] = int(w)
                    found = {"n_words": int(counts[i]), "items": sorted(names.get(i, ())), "spans": spans}
                    out.append(found if before[row + i] is None else _merge(before[row + i], found, data, offsets, words, i))
            found = pa.array(out, type=found_type)
            kept = [text] if keep_text else []
            yield pa.RecordBatch.from_arrays([*kept, batch.column("_row"), found], schema.names)

    return rest.mapInArrow(run, schema)


def _merge(a: dict, b: dict, data, offsets, words: Words, i: int) -> dict:
    """Findings of two blocks of phrases for the same text."""
    first, last = int(words.first[i]), int(words.first[i + 1])
    points = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
    begins, ends = points[words.starts[first:last] - offsets[i]], points[words.ends[first:last] - offsets[i]]
    hit = np.zeros(last - first, dtype=bool)
    for s in [*a["spans"], *b["spans"]]:
        hit[np.searchsorted(begins, s["start"]) : np.searchsorted(ends, s["end"], side="right")] = True
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans = [{"start": int(begins[p]), "end": int(ends[q - 1]), "words": int(q - p)} for p, q in zip(runs[::2], runs[1::2], strict=True)]
    return {"n_words": b["n_words"], "items": sorted({*a["items"], *b["items"]}), "spans": spans}


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the given spans of code points."""
    if text is None:
        return None
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])
