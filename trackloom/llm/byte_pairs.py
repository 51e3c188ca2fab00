"""Byte-level BPE: pretokens, merge rounds and decoding as whole-array steps.

The symbols of many words lie in one flat array. A round finds each word's pair of lowest rank,
by binary search over sorted pair keys, and merges all its places at once; words without a pair
that merges leave the array. Nothing is done per word or per symbol in Python.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm._text import Words, hashed, padded, row_blocks
from trackloom.llm._tokens import MemoTokens

_NONE = np.int32(np.iinfo(np.int32).max)
#: Words of more symbols than this are merged rank by rank, since a round over all their symbols for each rank would be quadratic.
_LONG = 1024
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: Endings that a pretoken of their own begins with an apostrophe: `'s|'t|'m|'d|'re|'ve|'ll`.
_ONE, _TWO = [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself where it is one, else the next sign from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class CodePointKinds:
    """Letter, number, white space or other, for arrays of code points, as ``split`` itself tells them apart.

    Unicode versions differ in what is a letter; so a code point that was not met before is put
    between signs of each kind, and which of them it joins says its kind.
    """

    def __init__(self, split: Callable[[str], list[tuple[str, tuple[int, int]]]]):
        self.split = split
        self.table = np.full(0x110000, _UNKNOWN, dtype=np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        if (kinds == _UNKNOWN).any():
            fresh = np.unique(points[kinds == _UNKNOWN])
            found = np.full(len(fresh), _SPACE, dtype=np.uint8)
            for sign, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
                begun = {a for _, (a, _) in self.split("".join(f"{sign}{chr(c)}\n\n" for c in fresh.tolist()))}
                found[[4 * k + 1 not in begun for k in range(len(fresh))]] = kind
            self.table[fresh] = found
            kinds = self.table[points]
        return kinds


def pretoken_starts(points: np.ndarray, kinds: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where a pretoken begins. ``edge`` marks the first code point of each text.

    Runs of one kind are pretokens. Of white space before something else in a text the last sign
    stands apart, and joins what follows if it is a plain space. A contraction ends a pretoken.
    """
    n = len(points)
    start = edge.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~edge[1:])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    marks = np.flatnonzero(start & (points == 39))
    marks = marks[marks + 1 < n]
    marks = marks[~edge[marks + 1]]
    next_one = points[marks + 1]
    one = marks[np.isin(next_one, _ONE)]
    two = marks[marks + 2 < n]
    two = two[~edge[two + 2]]
    pairs = points[two + 1].astype(np.int64) << 32 | points[two + 2]
    two = two[np.isin(pairs, [a << 32 | b for a, b in _TWO])]
    for at, size in ((one, 2), (two, 3)):
        for k in range(1, size):
            start[at + k] = False
        ends = at + size
        start[ends[ends < n]] = True
    return start


class Merges:
    """Pairs of ids that merge, by rank, over sorted pair keys."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray, n_ids: int):
        keys = pairs[:, 0].astype(np.int64) * n_ids + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.n_ids, self.keys, self.order, self.made = n_ids, keys[order], order.astype(np.int32), made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, a very large number for those that do not merge."""
        keys = left.astype(np.int64) * self.n_ids + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], _NONE)

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose first symbols lie one after another, and how many ids each word has."""
        long = np.flatnonzero(sizes > _LONG)
        if len(long):
            first = np.cumsum(sizes) - sizes
            parts = {int(k): self.by_rank(symbols[first[k] : first[k] + sizes[k]]) for k in long}
            rest = sizes <= _LONG
            ids, counts = self.rounds(symbols[np.repeat(rest, sizes)], sizes[rest])
            out_sizes = np.empty(len(sizes), dtype=np.int64)
            out_sizes[rest] = counts
            for k, own in parts.items():
                out_sizes[k] = len(own)
            out = np.empty(int(out_sizes.sum()), dtype=np.uint32)
            out[np.repeat(rest, out_sizes)] = ids
            first = np.cumsum(out_sizes) - out_sizes
            for k, own in parts.items():
                out[first[k] : first[k] + len(own)] = own
            return out, out_sizes
        return self.rounds(symbols, sizes)

    def rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round after another over all words; a word has as many rounds as different pairs merge in it."""
        symbols, left = symbols.astype(np.int32), sizes.astype(np.int64)
        words = np.arange(len(sizes))
        of = np.repeat(words, left)
        rank = np.full(len(symbols), _NONE, dtype=np.int32)
        if len(symbols) > 1:
            inner = np.flatnonzero(of[1:] == of[:-1])
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        done_words, done_ids = [], []
        while len(symbols):
            held = left > 0
            words, left = words[held], left[held]
            first = np.cumsum(left) - left
            best = np.minimum.reduceat(rank, first)
            place = np.repeat(np.arange(len(left)), left)
            best_here = best[place]
            over = best_here == _NONE
            hit = np.flatnonzero((rank == best_here) & ~over)
            if over.any():
                done_words.append(words[place[over]])
                done_ids.append(symbols[over])
            if not len(hit):
                break
            beside = np.flatnonzero(hit[1:] == hit[:-1] + 1)
            if len(beside):  # a pair of one symbol twice, in a run of it: every other place, from the left
                begins = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
                hit = hit[(hit - hit[np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))]) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            left = left - np.bincount(place[hit], minlength=len(left))
            left[best == _NONE] = 0
            at = np.cumsum(keep)[hit] - 1
            symbols, rank, place = symbols[keep], rank[keep], place[keep]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed] = _NONE
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[place[changed] == place[changed + 1]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        found = np.concatenate(done_words) if done_words else np.zeros(0, dtype=np.int64)
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, dtype=np.int32)
        order = np.argsort(found, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(found, minlength=len(sizes))

    def by_rank(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one long word: all places of the lowest rank left, rank after rank, in a linked list."""
        symbols, n = symbols.astype(np.int32), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, _NONE, dtype=np.int32)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[rank[places] != _NONE]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            own = rank[places]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, some in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(some)

        add(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[alive[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            begins = np.concatenate([[True], after[hit[:-1]] != hit[1:]])
            if not begins.all():
                count = np.arange(len(hit))
                hit = hit[(count - np.maximum.accumulate(np.where(begins, count, 0))) % 2 == 0]
            gone = after[hit]
            symbols[hit] = self.made[r]
            alive[gone], rank[gone] = False, _NONE
            after[hit] = after[gone]
            inner = hit[after[hit] < n]
            before[after[inner]] = inner
            changed = np.concatenate([hit, before[hit]])
            changed = np.unique(changed[changed >= 0])
            rank[changed] = _NONE
            changed = changed[after[changed] < n]
            rank[changed] = self.ranks(symbols[changed], symbols[after[changed]])
            add(changed)
        return symbols[alive].astype(np.uint32)


class BytePairTokens(MemoTokens):
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them without special tokens added.

    ``specials`` says whether the strings of special tokens within texts stand for their ids, as they
    do by that library's default, or are plain text. The memo of words is only a saving.
    """

    def __init__(self, path: str, specials: bool = True, limit: int = 24 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        super().__init__(self._without_memo, None, False, lambda raw, a, b: False, limit)
        self.kinds = CodePointKinds(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        signs = byte_signs()
        vocabulary = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.n_ids = max([*vocabulary.values(), *added.values()]) + 1
        strings = [b""] * self.n_ids
        for word, i in vocabulary.items():
            strings[i] = bytes(signs[c] for c in word)
        for word, i in added.items():
            strings[i] = bytes(signs[c] for c in word) if all(c in signs for c in word) else word.encode()
        self.strings = strings
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        self.merges = Merges(np.array([(vocabulary[a], vocabulary[b]) for a, b in pairs], dtype=np.int64), made, self.n_ids)
        self.byte_id = np.zeros(256, dtype=np.int32)
        for c, b in signs.items():
            self.byte_id[b] = vocabulary[c]
        self.specials = {w.encode(): i for w, i in added.items()} if specials else {}
        self.special = re.compile(b"|".join(re.escape(w) for w in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def _without_memo(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            words = self.words(data, np.array([0, len(data)]))
            raw = words.data.tobytes()
            out.append(self._ids([raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)])[0].tolist())
        return out

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Pretokens and special tokens in place of words."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
        leads = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
        edge = np.zeros(len(points) + 1, dtype=bool)
        found = [m.span() for m in self.special.finditer(raw)] if self.special is not None else []
        cuts = set(offsets.tolist())
        found = [(a, b) for a, b in found if not any(c in cuts for c in range(a + 1, b))]
        spans = np.array(found, dtype=np.int64).reshape(-1, 2)
        edge[np.searchsorted(leads, np.concatenate([offsets, spans.ravel()]))] = True
        start = pretoken_starts(points, self.kinds.of(points), edge[:-1]) if len(points) else np.zeros(0, dtype=bool)
        for a, b in np.searchsorted(leads, spans).tolist():
            start[a + 1 : b] = False
        words = Words.__new__(Words)
        words.starts = leads[start]
        words.ends = np.append(words.starts[1:], len(data))[: len(words.starts)]
        words.first = np.searchsorted(words.starts, offsets)
        words.data = padded(data)
        words.hashes = hashed(words.data, words.starts, words.ends)
        return words

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        held = [k for k, w in enumerate(words) if w in self.specials] if self.specials else []
        if held:
            plain = np.ones(len(words), dtype=bool)
            plain[held] = False
            ids, counts = self.merges.apply(symbols[np.repeat(plain, sizes)], sizes[plain])
            out_sizes = np.ones(len(words), dtype=np.int64)
            out_sizes[plain] = counts
            out = np.empty(int(out_sizes.sum()), dtype=np.uint32)
            out[np.repeat(plain, out_sizes)] = ids
            out[(np.cumsum(out_sizes) - 1)[held]] = [self.specials[words[k]] for k in held]
            return out, out_sizes
        return self.merges.apply(symbols, sizes)

    def token_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each begins; an id that is not in the vocabulary has none."""
        known = ids < self.n_ids
        safe = np.where(known, ids, 0)
        sizes = np.where(known, self.lengths[safe], 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.places[safe] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each slice ``ids[offsets[i]:offsets[i+1]]``, specials included; bytes that are no UTF-8 become U+FFFD."""
        data, ends = self.token_bytes(ids)
        raw, at = data.tobytes(), ends[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=4)
def byte_pair_tokens(path: str, specials: bool = True) -> BytePairTokens:
    """One per Python worker, kept from task to task."""
    return BytePairTokens(path, specials)


def encode_texts(docs: DataFrame, tokenizer: str, specials: bool = True) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole ``text``.

    Null and empty texts have an empty list; repeated rows are encoded each; no rows give no rows;
    other columns stay, but one named ids is replaced. Equal words of a batch are merged once.
    """
    kept = [c for c in docs.columns if c != "ids"]
    asked = docs.select(F.struct(*kept).alias("row"))
    schema = T.StructType([asked.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        encode = byte_pair_tokens(tokenizer, specials)
        for batch in batches:
            rows = batch.column("row")
            for at, ids, ends in encode.blocks(rows.field("text")):
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(ends) - 1), lists], ["row", "ids"])

    return asked.mapInArrow(run, schema).select("row.*", "ids")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` stand for, special tokens included.

    Null lists, and ids that are null, negative or beyond the vocabulary, stand for nothing; a column
    named decoded is replaced.
    """
    kept = [c for c in encoded.columns if c != "decoded"]
    asked = encoded.select(F.struct(*kept).alias("row"))
    schema = T.StructType([asked.schema["row"], T.StructField("decoded", T.StringType(), False)])

    def run(batches):
        tokens = byte_pair_tokens(tokenizer)
        for batch in batches:
            rows = batch.column("row")
            lists = rows.field("ids").cast(pa.list_(pa.int64()))
            for at in range(0, len(lists), 256):
                some = lists.slice(at, 256)
                ids = some.flatten().fill_null(-1).to_numpy()
                sizes = some.value_lengths().fill_null(0).to_numpy()
                texts = tokens.decode(np.where(ids < 0, tokens.n_ids, ids), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(some)), pa.array(texts, pa.string())], ["row", "decoded"])

    return asked.mapInArrow(run, schema).select("row.*", "decoded")
