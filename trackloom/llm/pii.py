"""Personal data: patterns, and a semi-Markov conditional random field over candidate spans."""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm._text import byte_class, row_blocks

KINDS = ["email", "ip", "card", "phone", "secret"]
_BASE = KINDS[:4]
_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?:token|secret|api_?key|password)[\x20]?[=:][\x20]?[\"']?([A-Za-z0-9_+/-]{16,128})")
_TRIGGER = byte_class(lambda b: 48 <= b <= 57 or b == 64)
_NOT_DIGIT = re.compile("[^0-9]+")
_NUMBERS = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    free = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        if at < free or (end := _DOMAIN.match(text, at + 1)) is None:
            continue
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, end.end()
            free = end.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, leftmost and non-overlapping for each kind; failing ones are dropped."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


# --- the field -------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_SPAN = re.compile(r"[A-Za-z0-9+].*[A-Za-z0-9]|[A-Za-z0-9]", re.DOTALL)
_KEY = re.compile(r"(?i)(?:token|secret|key|password|pass|auth)[\x20]?[=:][\x20]?[\"']?$")
_CALL = re.compile(r"(?i)(?:tel|phone|call|mobile|fax)[\x20:.]*$")
FEATURES = [
    "bias", "at_and_dots", "local_and_host", "four_octets", "octets_in_range", "card_digits", "luhn", "plus", "phone_digits", "only_digits_and_separators",
    "long_mixed_word", "hex_word", "after_key", "after_call", "inner_space", "cut_word", "cut_number", "letters", "other_signs", "length",
    "grouped_card", "trunk_prefix", "spaced_address",
]
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LONGEST = 16  #: tokens in a candidate span


def _features(text: str, a: int, b: int) -> list[float]:
    """What the whole span text[a:b] looks like, and what it is cut from."""
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    signs = len(span) - digits - letters
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    local, _, host = span.partition("@")
    dialled = not letters and signs == sum(c in " ().-+" for c in span) and span.count("+") == (span[:1] == "+")
    carded = not letters and signs == sum(c in " -" for c in span)
    grouped = not letters and 12 <= digits <= 19 and signs == sum(c in " -._/" for c in span)
    valid = grouped and luhn(_NOT_DIGIT.sub("", span))
    trunk = dialled and span[:2] == "00" and 11 <= digits <= 17
    word = signs == 0
    before, after = text[a - 1 : a], text[b : b + 1]
    return [
        1.0,
        float(span.count("@") == 1 and "." in host),
        float(bool(local) and bool(host) and all(c in _LOCAL for c in local) and _DOMAIN.fullmatch(host) is not None),
        float(octets),
        float(octets and all(len(p) < 4 and int(p) <= 255 for p in parts)),
        float(carded and 12 <= digits <= 19),
        float(valid),
        float(span[:1] == "+"),
        float(dialled and 9 <= digits <= 15),
        float(dialled),
        float(word and len(span) >= 16 and digits >= 3 and letters >= 3),
        float(word and len(span) >= 32 and all(c in "0123456789abcdefABCDEF" for c in span)),
        float(word and _KEY.search(text, max(0, a - 16), a) is not None),
        float(dialled and _CALL.search(text, max(0, a - 12), a) is not None),
        float(" " in span),
        float((before.isalnum() or before == "_") and span[:1].isalnum() or (after.isalnum() and span[-1:].isalnum())),
        float(before[:1] in (".", "-", "@", "+") and before != "" or (after in (".", "-", "@") and text[b + 1 : b + 2].isalnum())),
        letters / max(1, len(span)),
        0.0 if valid else float(signs - sum(c in " ().-+@_%" for c in span)),
        min(len(span), 64) / 64,
        float(valid and not carded),
        float(trunk),
        float(" " in span and "@" in span and _ADDRESS.fullmatch(span) is not None),
    ]


def tokens_of(text: str, a: int = 0, b: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, a, len(text) if b is None else b)]


def candidates(text: str, tokens: list[tuple[int, int]] | None = None, first: int = 0, last: int | None = None) -> tuple[list[int], list[tuple[int, int, int, int]], np.ndarray]:
    """Token starts, spans (first token, end token, start, end) of at most LONGEST tokens and their features.

    A span begins and ends with a letter or digit (or begins with +), stays on its line and holds a digit or @.
    Only spans that begin with the tokens from ``first`` up to ``last`` are given.
    """
    tokens = tokens_of(text) if tokens is None else tokens
    spans, rows = [], []
    for i in range(first, len(tokens) if last is None else min(last, len(tokens))):
        a = tokens[i][0]
        if not (text[a].isascii() and (text[a].isalnum() or text[a] == "+")):
            continue
        spaces = 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            b = tokens[j][1]
            last_sign = text[b - 1]
            if last_sign == "\n" or not last_sign.isascii():
                break
            spaces += last_sign == " "
            if spaces > 4:
                break
            if last_sign.isalnum() and _NUMBERS.search(text, a, b):
                spans.append((i, j + 1, a, b))
                rows.append(_features(text, a, b))
    return [a for a, _ in tokens], spans, np.array(rows).reshape(-1, len(FEATURES))


def _start_weights() -> np.ndarray:
    """Where learning starts, and what is kept where nothing is seen: shapes count for their kind, cuts against all, and forms that no pattern knows for nothing."""
    w = np.zeros((len(KINDS), len(FEATURES)))
    at = {name: i for i, name in enumerate(FEATURES)}
    w[:, at["bias"]] = -6
    w[:, at["cut_word"]] = w[:, at["cut_number"]] = w[:, at["other_signs"]] = -4
    for kind, names in {"email": ["at_and_dots", "local_and_host"], "ip": ["four_octets", "octets_in_range"], "card": ["card_digits", "luhn"], "phone": ["phone_digits", "plus"], "secret": ["hex_word", "after_key", "long_mixed_word"]}.items():
        w[KINDS.index(kind), [at[n] for n in names]] = 4
    return w


@dataclass
class SegmentField:
    """Semi-Markov conditional random field: a labelling is a set of disjoint typed spans, its score their sum."""

    weights: np.ndarray

    def decode(self, text: str, a: int = 0, b: int | None = None, starts: int = 256) -> list[tuple[int, int, str]]:
        """The best labelling of text[a:b]: for every token end the best way to get there, by a span of any type or none.

        Spans are bounded, so one pass over the tokens with the features of ``starts`` tokens at a time
        finds the best labelling of a stretch of any length.
        """
        tokens = tokens_of(text, a, b)
        n = len(tokens)
        best, back = [0.0] + [-np.inf] * n, [(-1, -1)] * (n + 1)
        for first in range(0, n, starts):
            _, spans, x = candidates(text, tokens, first, first + starts)
            scores = x @ self.weights.T
            kind, value = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
            k = 0
            for i in range(first, min(n, first + starts)):
                while k < len(spans) and spans[k][0] == i:
                    j = spans[k][1]
                    if value[k] > 0 and best[i] + value[k] > best[j]:
                        best[j], back[j] = best[i] + value[k], (i, kind[k])
                    k += 1
                if best[i] >= best[i + 1]:
                    best[i + 1], back[i + 1] = best[i], (-1, -1)
        out, j = [], n
        while j > 0:
            i, kind = back[j]
            if i < 0:
                j -= 1
            else:
                out.append((tokens[i][0], tokens[j - 1][1], KINDS[kind]))
                j = i
        return out[::-1]


def _likelihood(n: int, spans, scores: np.ndarray, gold: dict[tuple[int, int], int]) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold spans and, for each span and kind, gold minus expected count."""
    by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    top = scores.max(axis=1, keepdims=True)
    whole = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
    for k, (i, j, _, _) in enumerate(spans):
        by_end[j].append(k)
        by_start[i].append(k)
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        terms = [forward[j - 1], *(forward[spans[k][0]] + whole[k] for k in by_end[j])]
        forward[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [backward[i + 1], *(backward[spans[k][1]] + whole[k] for k in by_start[i])]
        backward[i] = np.logaddexp.reduce(terms)
    starts, ends = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    expected = np.exp(np.minimum(0, (forward[starts] + backward[ends] - forward[n])[:, None] + scores))
    told, score = -expected, 0.0
    for k, (_, _, a, b) in enumerate(spans):
        if (a, b) in gold:
            told[k, gold[a, b]] += 1
            score += scores[k, gold[a, b]]
    return score - forward[n], told


def _gold(text: str) -> list[tuple[int, int, str]]:
    return [*base_spans(text), *((m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text))]


def perturbed(text: str, random: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]] | None:
    """``text`` with one of its values written in a way that the patterns do not know, and all its labels; None if it has none.

    Cards get other separators, phone numbers a trunk prefix for their +, addresses spaces around
    the @. Other labels that the changed value touches are left out.
    """
    gold = _gold(text)
    able = [g for g in gold if g[2] in ("card", "phone", "email")]
    if not able:
        return None
    a, b, kind = able[int(random.integers(len(able)))]
    own = text[a:b]
    if kind == "card":
        digits, sign = _NOT_DIGIT.sub("", own), "._/"[int(random.integers(3))]
        new = sign.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    elif kind == "phone":
        new = "00" + own[1:]
    else:
        new = own.replace("@", (" @ ", " @", "@ ")[int(random.integers(3))])
    shift = len(new) - len(own)
    kept = [(i, j, k) if j <= a else (i + shift, j + shift, k) for i, j, k in gold if (j <= a or i >= b)]
    return text[:a] + new + text[b:], [*kept, (a, a + len(new), kind)]


def fit_field(windows: list[str], rounds: int = 4, rate: float = 0.5, ridge: float = 0.02, seed: int = 3) -> SegmentField:
    """Maximum likelihood by adaptive gradient steps.

    Gold are the pattern matches and keyed secrets of each window, and of a copy of each window in
    which a value is written as the patterns do not know it, so that the field learns what they miss.
    """
    start, random = _start_weights(), np.random.Generator(np.random.PCG64(seed))
    examples = []
    for text in windows:
        for own, gold in filter(None, ((text, _gold(text)), perturbed(text, random))):
            tokens, spans, x = candidates(own)
            if spans:
                examples.append((len(tokens), spans, x, {(a, b): KINDS.index(k) for a, b, k in gold}))
    w, power = start.copy(), np.full_like(start, 1e-6)
    for _ in range(rounds):
        for n, spans, x, gold in examples:
            _, told = _likelihood(n, spans, x @ w.T, gold)
            gradient = told.T @ x - ridge * (w - start)
            power += gradient**2
            w += rate * gradient / np.sqrt(power)
    return SegmentField(w)


# --- in Spark --------------------------------------------------------------------------------

_RUNS = re.compile("[0-9@]+")
_BARRIER = re.compile("[\n\x80-\U0010ffff]")
_WORD_END = re.compile("[A-Za-z0-9]*")
_TRAINED = 400  #: characters of a training window, more or less


def _left_of(text: str, at: int, floor: int) -> int:
    """Where the LONGEST tokens before the one at ``at`` begin, or what bounds them: a line's start, a sign beyond ASCII, ``floor``."""
    size = 128
    while True:
        low = max(floor, at - size)
        piece = text[low:at]
        barrier = max((m.end() for m in _BARRIER.finditer(piece)), default=0) if "\n" in piece or not piece.isascii() else 0
        tokens = tokens_of(piece, barrier)
        if len(tokens) > LONGEST + 1:
            return low + tokens[-LONGEST - 1][0]
        if barrier or low == floor:
            return low + barrier
        size *= 4


def _right_of(text: str, at: int, ends: list[int]) -> bool:
    """Add to ``ends`` the ends of the tokens from ``at`` on until they are LONGEST; False if a line's end or a sign beyond ASCII stops them."""
    while len(ends) < LONGEST:
        m = _TOKEN.match(text, at)
        if m is None or text[at] == "\n" or text[at] >= "\x80":
            return False
        at = m.end()
        ends.append(at)
    return True


def windows_of(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and @ outside which no token of a candidate span can lie, in whole tokens.

    The ends of the tokens behind the last digit or @ are kept, so each token is read once.
    """
    out: list[list[int]] = []
    ends: list[int] = []
    goes_on = True
    for m in _RUNS.finditer(text):
        floor = out[-1][1] if out else 0
        end = _WORD_END.match(text, m.end()).end()
        if end <= floor:
            if goes_on:
                ends = ends[bisect.bisect_right(ends, end) :]
                goes_on = _right_of(text, floor, ends)
                out[-1][1] = max(floor, ends[-1] if ends else floor)
            continue
        a = m.start() if m.start() < floor else _left_of(text, m.start(), floor)
        ends = []
        goes_on = _right_of(text, end, ends)
        b = ends[-1] if ends else end
        if out and a <= floor:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _texts_with_triggers(column: pa.Array) -> np.ndarray:
    found = np.zeros(len(column), dtype=bool)
    for row, data, offsets in row_blocks(column, 1 << 20):
        sums = np.concatenate([[0], np.cumsum(_TRIGGER[data])])
        found[row : row + len(offsets) - 1] = sums[offsets[1:]] > sums[offsets[:-1]]
    return found


def _pieces(text: str, a: int, b: int):
    """text[a:b] in pieces of about _TRAINED characters that end at white space."""
    while a < b:
        end = b if b - a <= _TRAINED else text.find(" ", a + _TRAINED, b)
        end = b if end < 0 else end
        yield text[a : min(end, a + 4 * _TRAINED)]
        a = end


def train_field(docs: DataFrame, sample_windows: int = 400) -> SegmentField:
    """Fit to at most ``sample_windows`` different windows of the texts, those of least hash.

    For training only, long windows are cut into pieces of about 400 characters at white space (1600 at
    most where there is none). Each task hands on no more windows than are asked for.
    """

    def run(batches):
        least: dict[int, str] = {}
        for batch in batches:
            texts = batch.column("text").filter(pa.array(_texts_with_triggers(batch.column("text")))).to_pylist()
            for text in texts:
                for a, b in windows_of(text):
                    for own in _pieces(text, a, b):
                        least[int.from_bytes(hashlib.blake2b(own.encode(), digest_size=7).digest(), "big")] = own
                if len(least) > 8 * sample_windows:
                    least = dict(sorted(least.items())[:sample_windows])
        rows = sorted(least.items())[:sample_windows]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], ["hash", "window"])

    rows = docs.select("text").mapInArrow(run, "hash long, window string").distinct().orderBy("hash", "window").limit(sample_windows).collect()
    return fit_field([r.window for r in rows])


def all_spans(text: str, field: SegmentField) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) by start, kind: the pattern matches, and the field's spans that touch none of them.

    The field labels each window as a whole; no candidate span crosses a window's ends, so together
    that is the best labelling of the whole text.
    """
    base = base_spans(text)
    found = [(a, b, k, True) for a, b, k in base]
    taken = sorted((a, b) for a, b, _ in base)
    starts, ends = [a for a, _ in taken], list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    for a, b in windows_of(text):
        for i, j, kind in field.decode(text, a, b):
            k = int(np.searchsorted(starts, j))
            if k == 0 or ends[k - 1] <= i:
                found.append((i, j, kind, False))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))


def _joined(spans) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def mask(text: str, spans) -> str:
    """``text`` with each span, or run of spans that overlap, replaced by its first kind in brackets."""
    out, at = [], 0
    for start, end, kind, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, field: SegmentField, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans, found (the same as an array) and masked.

    The counts and base_sha256 are of the pattern matches, always kept; spans joins all spans,
    those that the field adds included, as kind:start:end in code points. Null and empty texts
    have none (a null text is masked to null); repeated rows each get their result; other columns stay and those named
    like a new one are replaced; no rows give no rows. masked is left out without ``keep_text``.
    """
    own = [*(f"n_{k}" for k in _BASE), "base_sha256", "spans", "found", "masked"]
    kept = [c for c in docs.columns if c not in own and c != "text"]
    asked = docs.select("text", F.struct(*kept, F.lit(0).alias("_")).alias("row"))
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))
    fields = [asked.schema["row"], *[T.StructField(f"n_{k}", T.LongType()) for k in _BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", span_type)]
    schema = T.StructType([*([asked.schema["text"], T.StructField("masked", T.StringType())] if keep_text else []), *fields])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field, nothing = shared.value, hashlib.sha256(b"").hexdigest()
        for batch in batches:
            text = batch.column("text")
            n = batch.num_rows
            counts = {k: np.zeros(n, dtype=np.int64) for k in _BASE}
            digests, joined, found, masked = [nothing] * n, [""] * n, [[]] * n, {}
            for i in np.flatnonzero(_texts_with_triggers(text)).tolist():
                own = text[i].as_py()
                spans = all_spans(own, field)
                base = [s for s in spans if s[3]]
                for s in base:
                    counts[s[2]][i] += 1
                digests[i], joined[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)
                found[i] = [dict(zip(("start", "end", "kind", "base"), s, strict=True)) for s in spans]
                if keep_text and spans:
                    masked[i] = mask(own, spans)
            columns = [batch.column("row"), *[pa.array(counts[k]) for k in _BASE], pa.array(digests), pa.array(joined), pa.array(found, _SPANS)]
            if keep_text:
                changed = np.zeros(n, dtype=bool)
                changed[list(masked)] = True
                new = pa.compute.replace_with_mask(text, pa.array(changed), pa.array([masked[i] for i in sorted(masked)], text.type)) if masked else text
                columns = [text, new, *columns]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    order = [c for c in docs.columns if c not in own and (keep_text or c != "text")]
    found = asked.mapInArrow(run, schema).select(*(["text", "masked"] if keep_text else []), "row.*", *own[:-1])
    return found.select(*order, *own[:-1], *(["masked"] if keep_text else []))
