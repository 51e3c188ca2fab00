"""URL filters: all glob rules simulated at once by a bit-parallel automaton."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains, where a URL's path starts with ``path``, which begins with `/` or is empty. No sign of either is a wildcard."""

    verdict: str
    host: str
    path: str

    def __post_init__(self):
        if self.path and not self.path.startswith("/"):
            raise ValueError(f"a rule's path begins with a slash: {self.path}")

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        """What host + path of a fitting URL matches; without a path the host must end where the rule's does."""
        own = re.sub(r"([*?\\])", r"\\\1", self.name)
        ends = ["**"] if self.path else ["", "/**"]
        return [f"{lead}{own}{end}" for lead in ("", "*.") for end in ends]


class GlobAutomaton:
    """Globs over bytes, packed into masks of 64-bit words and matched against whole strings.

    `*` stands for any run without `/`, `**` for any run, `?` for one byte other than `/`, and a
    backslash before any of them (or another) for that sign itself.
    A glob of m bytes owns m + 1 neighbouring bits, bit j saying that j bytes are matched.
    One step is Shift-And with loops: D = ((D << 1) & B[c]) | (D & L[c]), the shift carrying
    from word to word; no byte leads into a first bit, so globs do not run into each other.
    """

    def __init__(self, globs: list[str]):
        steps = [self._parse(g) for g in globs]
        total = sum(len(s) for s, _ in steps) + len(steps)
        self.words = max(1, -(-total // 64))
        take = np.zeros((256, 64 * self.words), dtype=bool)
        loop = np.zeros((256, 64 * self.words), dtype=bool)
        begin = np.zeros(64 * self.words, dtype=bool)
        ends, at = [], 0
        slash = np.arange(256) == ord("/")
        for symbols, loops in steps:
            begin[at] = True
            for j, symbol in enumerate(symbols):
                take[:, at + j + 1] = ~slash if symbol is None else np.arange(256) == symbol
            for j, kind in loops.items():
                loop[:, at + j] = True if kind == "**" else ~slash
            ends.append(at + len(symbols))
            at += len(symbols) + 1
        self.begin, self.take, self.loop = self._pack(begin), self._pack(take), self._pack(loop)
        self.end_word, self.end_bit = np.array(ends, dtype=np.int64) // 64, np.array(ends, dtype=np.uint64) % np.uint64(64)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, str]]:
        raw, symbols, loops, i = glob.encode(), [], {}, 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                loops[len(symbols)] = "**"
                i += 2
            elif raw[i] == ord("*"):
                loops.setdefault(len(symbols), "*")
                i += 1
            elif raw[i] == ord("\\") and i + 1 < len(raw):
                symbols.append(raw[i + 1])
                i += 2
            else:
                symbols.append(None if raw[i] == ord("?") else raw[i])
                i += 1
        return symbols, loops

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8").astype(np.uint64)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(strings, globs) flags for the strings ``data[offsets[i]:offsets[i+1]]``."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.begin, (len(sizes), 1))
        starts, live, t = offsets[:-1][order], int(np.count_nonzero(sizes)), 0
        sorted_sizes = -sizes[order]
        while live:
            d = state[:live]
            c = data[starts[:live] + t]
            moved = d << _ONE
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            moved &= self.take[c]
            state[:live] = moved | (d & self.loop[c])
            t += 1
            live = int(np.searchsorted(sorted_sizes, -t, side="left"))
        out = np.empty((len(sizes), len(self.end_word)), dtype=bool)
        out[order] = (state[:, self.end_word] >> self.end_bit) & _ONE
        return out


def canonical(url) -> tuple:
    """Host (A-Z lower-cased) and path columns of a URL column; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return host, path


def judge_urls(pages: DataFrame, rules: list[Rule], blocked: list[str], column: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict of every row's URL.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    fitting rule decides (ties: the one listed first). Where none fits, the verdict is block if
    one of the globs ``blocked`` matches host + path, else allow. Rules become globs too, so one
    pass over a URL's bytes decides all. Null URLs and URLs without `://` have an empty host and
    path; repeated rows are each judged; other columns stay, those named like a new one are replaced.
    """
    own = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in own]
    host, path = canonical(F.coalesce(F.col(column), F.lit("")))
    ordered = sorted(rules, key=lambda r: -len(r.name))
    ruled_globs = [(k, g) for k, r in enumerate(ordered) for g in r.globs()]
    firsts = [next(j for j, (k, _) in enumerate(ruled_globs) if k == i) for i in range(len(ordered))]
    automaton = GlobAutomaton([g for _, g in ruled_globs] + list(blocked))
    names, verdicts = [r.name for r in ordered] + [None], [r.verdict for r in ordered]

    def run(batches):
        for batch in batches:
            subject = batch.column("subject").cast(pa.large_string())
            offsets = np.frombuffer(subject.buffers()[1], dtype=np.int64)[subject.offset : subject.offset + len(subject) + 1]
            data = np.frombuffer(subject.buffers()[2] or b"", dtype=np.uint8)
            found = automaton.match(data, offsets)
            ruled = np.logical_or.reduceat(found[:, : len(ruled_globs)], firsts, axis=1) if ordered else found[:, :0]
            some = ruled.any(axis=1)
            which = np.where(some, ruled.argmax(axis=1), len(ordered)) if ordered else np.zeros(len(found), dtype=np.int64)
            bad = found[:, len(ruled_globs) :].any(axis=1)
            rule = [names[k] for k in which.tolist()]
            verdict = [verdicts[k] if k < len(ordered) else ("block" if b else "allow") for k, b in zip(which.tolist(), bad.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["row", *own])

    asked = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path")).withColumn("subject", F.concat("host", "path"))
    schema = T.StructType([asked.schema["row"], *[T.StructField(c, T.StringType()) for c in own]])
    return asked.mapInArrow(run, schema).select("row.*", *own)
