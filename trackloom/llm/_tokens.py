"""Token ids by public tokenizers, with a bounded memo of words.

Words are found and hashed with numpy; each distinct word of a block is looked up once
and only unknown ones reach the tokenizer, so its cost follows the vocabulary, not the text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from trackloom.llm._text import NON_SPACE, Words, byte_class, row_blocks, same_words

_NOT_BLANK = byte_class(lambda b: b != 32)
#: ASCII signs that a run of letters never joins; the apostrophe, which it may, is left out.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class MemoTokens:
    """``encode(texts)`` word by word. ``table`` and ``fold`` say what a word is and whether A-Z count as a-z;
    ``whole(bytes, a, b)`` says whether the text from a to b must be encoded as it is. The memo is a few sorted
    arrays; it is dropped when they hold more than ``limit`` bytes. Words are looked up by a hash and compared
    byte by byte; a text with a word whose hash another word has is encoded as it is.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], table: np.ndarray | None, fold: bool, whole, limit: int = 24 << 20):
        self.encode, self.table, self.fold, self.whole, self.limit = encode, table, fold, whole, limit
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at, self.size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.pool, self.filled = np.zeros(1 << 16, dtype=np.uint32), 0
        self.word_at, self.word_size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.word_pool, self.word_filled = np.zeros(1 << 16, dtype=np.uint8), 0

    def _held(self) -> int:
        return 28 * len(self.keys) + 4 * self.filled + self.word_filled

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Add ``keys``, which are sorted and new."""
        ids, sizes = self._ids(words)
        self.pool = _with_room(self.pool, self.filled, len(ids))
        self.pool[self.filled : self.filled + len(ids)] = ids
        lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.word_pool = _with_room(self.word_pool, self.word_filled, len(raw) + 8)
        self.word_pool[self.word_filled : self.word_filled + len(raw)] = raw
        place = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, place, self.filled + np.cumsum(sizes) - sizes)
        self.word_at = np.insert(self.word_at, place, self.word_filled + np.cumsum(lengths) - lengths)
        self.size, self.word_size = np.insert(self.size, place, sizes), np.insert(self.word_size, place, lengths)
        self.keys = np.insert(self.keys, place, keys)
        self.filled += len(ids)
        self.word_filled += len(raw)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        ids = self._listed([w.decode() for w in words])
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _listed(self, words: list[str]) -> list[list[int]]:
        return self.encode(words)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        return Words(data, offsets, self.table, self.fold)

    def blocks(self, column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets): row i of the block has ``ids[offsets[i]:offsets[i+1]]``."""
        for row, data, offsets in row_blocks(column, target):
            ids, ends, clashing = self._block(data, offsets)
            raw = data.tobytes()
            ends_of = offsets.tolist()
            odd = {i for i, (a, b) in enumerate(zip(ends_of[:-1], ends_of[1:], strict=True)) if self.whole(raw, a, b)}
            if odd := sorted(odd.union(clashing.tolist())):
                parts = np.split(ids, ends[1:-1])
                texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in odd]
                for i, own in zip(odd, self.encode(texts), strict=True):
                    parts[i] = np.array(own, dtype=np.uint32)
                ids = np.concatenate(parts)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield row, ids, ends

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their offsets by row, and the rows with a word whose hash is another word's too."""
        words = self.words(data, offsets)
        if not len(words.hashes):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys, sample, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if self._held() > self.limit:
            self._forget()
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys
        if not known.all():
            first = sample[~known]
            raw = words.data.tobytes()
            self._learn(keys[~known], [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)])
        slot = np.searchsorted(self.keys, keys)[inverse]
        length = words.ends - words.starts
        some = np.flatnonzero((length > 7) | (self.word_size[slot] != length))  # shorter ones have hashes of their own
        at = self.word_at[slot[some]]
        same = same_words(words.data, words.starts[some], words.ends[some], self.word_pool, at, at + self.word_size[slot[some]])
        clashing = np.unique(np.searchsorted(words.first, some[~same], side="right") - 1)
        sizes = self.size[slot]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.at[slot] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[words.first], clashing


def _with_room(pool: np.ndarray, filled: int, more: int) -> np.ndarray:
    """``pool``, or a longer copy of it if ``more`` do not fit behind the filled part."""
    if filled + more <= len(pool):
        return pool
    return np.concatenate([pool, np.zeros(max(more, len(pool) // 2), dtype=pool.dtype)])


class WordTokens(MemoTokens):
    """Ids of ``Tokenizer.from_file(path)`` without special tokens added.

    That tokenizer lower-cases, drops white space and never joins across it, nor letters with
    signs; so each run of non-space bytes, and its leading letters, stand for themselves.
    Texts that may hold a special token's string are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        super().__init__(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], NON_SPACE, True, lambda raw, a, b: raw.find(b"<|", a, b) >= 0)
        self.parts: dict[str, list[int]] = {}
        self.letters_held = 0
        vocabulary = tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _letters(self, words: list[str]) -> list[list[int]]:
        """Runs of letters, encoded together and cut after each token that ends a word."""
        ids = np.array(self.encode([" ".join(words)])[0])
        found = np.split(ids, np.flatnonzero(self.word_end[ids]) + 1)[:-1]
        return [x.tolist() for x in found] if len(found) == len(words) else self.encode(words)

    def _listed(self, words: list[str]) -> list[list[int]]:
        if self.letters_held > self.limit // 64:
            self.parts, self.letters_held = {}, 0
        cut = []
        for w in words:
            head = w.rstrip(_SIGNS)
            cut.append((head.lower(), w[len(head) :]) if head.isascii() and head.isalpha() or head.isalpha() and head.islower() else (w, ""))
        parts = self.parts
        fresh = [p for p in {p for pair in cut for p in pair} if p not in parts]
        self.letters_held += sum(map(len, fresh))
        for kind, encode in ((True, self._letters), (False, self.encode)):
            same = [p for p in fresh if p.isalpha() == kind]
            for at in range(0, len(same), 1_000):
                some = same[at : at + 1_000]
                parts.update(zip(some, encode(some), strict=True))
        return [parts[a] + parts[b] if b else parts[a] for a, b in cut]


class PieceTokens(MemoTokens):
    """Ids of a sentencepiece model.

    No piece of it joins letters across a space, so a text of single spaces is encoded word
    by word; any other text is encoded as a whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__(lambda texts: model.encode(texts, num_threads=1), _NOT_BLANK, False, _not_single_spaced)


def _not_single_spaced(raw: bytes, a: int, b: int) -> bool:
    return raw.find(b"  ", a, b) >= 0 or raw.find("▁".encode(), a, b) >= 0 or raw[a : a + 1] == b" " or raw[max(a, b - 1) : b] == b" "


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    """One per Python worker, kept from task to task."""
    return WordTokens(path)


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> PieceTokens:
    """One per Python worker, kept from task to task."""
    return PieceTokens(path)
