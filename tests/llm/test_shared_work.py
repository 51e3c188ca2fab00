"""Search with shared sums, alignment by products and byte-pair encoding, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import PIECES, SF, WORDS, documents, table
from trackloom.llm import byte_pairs, search as search_module
from trackloom.llm._text import ALNUM, NON_SPACE, Words, hashed, padded, same_words, shingle_sets
from trackloom.llm._tokens import PieceTokens, WordTokens
from trackloom.llm.alignment import CSR, align_tokens
from trackloom.llm.byte_pairs import BytePairTokens, Merges, decode_ids, encode_texts
from trackloom.llm.queries import op12_alignment, op13_byte_pairs
from trackloom.llm.search import SharedSums, search

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# --- one word, one identity ------------------------------------------------------------------


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_mirrored_words_are_different(n):
    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    raw = (one + " " + two).encode()
    words = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), NON_SPACE)
    assert len(set(words.hashes.tolist())) == 2
    a, b = (next(iter(shingle_sets(Words(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)]), NON_SPACE), 5))) for t in (f"x y {one} z w", f"x y {two} z w"))
    assert not set(a.tolist()) & set(b.tolist())
    tokenizer = Tokenizer.from_file(WORDS)
    tokens, pieces = WordTokens(WORDS), PieceTokens(PIECES)
    texts = [one, two, f"q {two} q"]
    for encode, want in ((tokens, [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), (pieces, pieces.encode(texts))):
        (_, ids, ends), = encode.blocks(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_short_words_have_hashes_of_their_own():
    rnd = random.Random(3)
    words = {bytes(rnd.choice(b"ab\xc3\x00\xff") for _ in range(rnd.randint(1, 7))) for _ in range(20_000)}
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert len(np.unique(hashed(padded(np.frombuffer(b"".join(words), dtype=np.uint8)), starts, ends))) == len(words)


def test_words_with_one_hash_are_still_told_apart(monkeypatch):
    """Long words with one hash: the memo compares bytes, so texts with another word than the one it knows are encoded as they are."""
    from trackloom.llm import _text

    real = _text.hashed
    monkeypatch.setattr(_text, "hashed", lambda data, starts, ends: np.where(ends - starts > 7, np.uint64(1), real(data, starts, ends)))
    tokens = WordTokens(WORDS)
    texts = ["international two", "two tournaments one", "international", None, "one", "tournaments"]
    (_, ids, ends), = tokens.blocks(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_same_words_compares_all_bytes():
    rnd = random.Random(5)
    a = [bytes(rnd.choice(b"xy") for _ in range(n)) for n in (1, 7, 8, 9, 31, 32, 33, 255, 256, 257, 900)]
    b = [w[:-1] + bytes([w[-1] ^ 1]) for w in a] + [w + b"x" for w in a] + a
    a = a * 3
    place = lambda ws: (padded(np.frombuffer(b"".join(ws), dtype=np.uint8)), np.cumsum([0, *map(len, ws)])[:-1], np.cumsum([len(w) for w in ws]))
    assert same_words(*place(a), *place(b)).tolist() == [x == y for x, y in zip(a, b)]


def test_spaces_at_the_ends_of_texts_among_others():
    """A text that ends or begins with a space is encoded as it is wherever it stands in a block."""
    pieces = PieceTokens(PIECES)
    texts = ["one two", "word word ", "three", " four", "five", None, " "]
    for target in (1, 1 << 20):
        assert encoded(pieces, texts, target) == pieces.encode([t or "" for t in texts])


# --- byte pairs ------------------------------------------------------------------------------

SIGNS = ["a", "b", "the", "'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", "　", "\xa0", "1", "½", "é", "ß", "日", "!", "?!", "<|endoftext|>", "<|", "|>", "\U0001f600", "s", "d", "ᲊ", "՘", "_", "\r\n", "'S", "\x85", "​", "\x00"]


def encoded(tokens, texts, target=1 << 20):
    out = [None] * len(texts)
    for row, ids, ends in tokens.blocks(pa.array(texts, pa.string()), target):
        for i in range(len(ends) - 1):
            out[row + i] = ids[ends[i] : ends[i + 1]].tolist()
    return out


@pytest.mark.parametrize("specials", [True, False])
def test_byte_pairs_like_the_library(specials):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 30))) for _ in range(4_000)]
    texts += ["a" * n for n in range(40)] + ["ab" * 5000, "a" * 5001, "!" * 3000, " " * 3001, "".join(rnd.choice("abcdefghij") for _ in range(9_000))]
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = not specials
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    tokens = BytePairTokens(BYTES, specials)
    assert encoded(tokens, texts) == want
    assert encoded(tokens, texts, 300) == want
    assert tokens.encode(texts[:300]) == want[:300]
    ids, ends = np.concatenate([np.array(w, dtype=np.int64) for w in want]), np.cumsum([0, *map(len, want)])
    assert tokens.decode(ids, ends) == texts == [library.decode(w, skip_special_tokens=False) for w in want]
    some = [[rnd.randrange(50_257) for _ in range(9)] for _ in range(500)]
    assert tokens.decode(np.concatenate(some), np.arange(0, 4501, 9)) == [library.decode(s, skip_special_tokens=False) for s in some]


def test_merge_rounds_and_ranks_agree():
    """Random merge tables, also such in which a later merge makes a pair of an earlier rank."""
    rnd = random.Random(2)
    for _ in range(60):
        pairs, strings = [], ["a", "b", "c"]
        while len(pairs) < 25:
            a, b = rnd.randrange(len(strings)), rnd.randrange(len(strings))
            if strings[a] + strings[b] not in strings:
                pairs.append((a, b))
                strings.append(strings[a] + strings[b])
        merges = Merges(np.array(pairs), np.arange(3, 28, dtype=np.int32), 28)
        words = [[rnd.randrange(3) for _ in range(rnd.randint(1, 30))] for _ in range(40)]
        sizes = np.array([len(w) for w in words])
        ids, counts = merges.rounds(np.concatenate(words).astype(np.int32), sizes)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        for word, own in zip(words, got):
            plain = list(word)
            while True:
                ranks = [pairs.index(p) if p in pairs else 99 for p in zip(plain, plain[1:])]
                if not ranks or min(ranks) == 99:
                    break
                k = ranks.index(min(ranks))
                plain[k : k + 2] = [3 + min(ranks)]
            assert own == plain == merges.by_rank(np.array(word, dtype=np.int32)).tolist()


def test_a_long_word_is_merged_by_rank(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    assert encoded(BytePairTokens(BYTES), [text, "short", text[:2000]])[0] == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(byte_pairs, "_LONG", 4)
    texts = ["unbelievable words and short ones", "  ", "extraordinarily"]
    assert encoded(BytePairTokens(BYTES), texts) == [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]


def test_encoded_and_decoded_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in op13_byte_pairs(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_encode_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a<|endoftext|>"), (4, "word " * 50_000)]
    got = encode_texts(documents(spark, rows).withColumns({"ids": F.lit("x"), "row": F.lit(7), "decoded": F.lit("y")}), BYTES)
    assert got.columns == ["doc_id", "text", "row", "decoded", "ids"]
    back = decode_ids(got, BYTES).collect()
    assert sorted((r.doc_id or 0, r.decoded, r.row) for r in back) == sorted((a or 0, t or "", 7) for a, t in rows)
    assert encode_texts(documents(spark, []), BYTES).count() == 0
    odd = spark.createDataFrame([(1, [64, None, -3, 99_999, 65]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode_ids(odd, BYTES).collect()} == {1: "ab", 2: "", 3: ""}


# --- alignment -------------------------------------------------------------------------------


def test_products_of_sparse_matrices(monkeypatch):
    rnd = np.random.default_rng(1)

    def sparse(m):
        row, column = np.nonzero(m)
        return CSR(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=m.shape[0]))]), column, m.shape[1], m[row, column])

    for terms in (1 << 21, 3):
        monkeypatch.setattr("trackloom.llm.alignment._TERMS", terms)
        for _ in range(100):
            a = (rnd.random((rnd.integers(1, 8), rnd.integers(1, 8))) < 0.4) * rnd.integers(1, 5)
            b = (rnd.random((a.shape[1], rnd.integers(1, 8))) < 0.4) * rnd.integers(1, 5)
            product = sparse(a) @ sparse(b).transpose().transpose()
            dense = np.zeros((a.shape[0], b.shape[1]), dtype=np.int64)
            dense[product.row_of(), product.indices] = product.data
            assert (dense == a @ b).all()
            assert sparse(a).product_terms(sparse(b)).tolist() == ((a > 0).astype(int) @ (b > 0).sum(1)).tolist()


def brute_alignment(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, digest."""
    import sentencepiece

    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    signs = byte_pairs.byte_signs()
    rows, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = library.encode(" " + (text or ""), add_special_tokens=False)
        b = model.encode(text or "")
        bytes_a = [bytes(signs[c] for c in library.id_to_token(i)) for i in a.ids]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(model.id_to_piece, b)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        of_byte = [j for j, x in enumerate(bytes_b) for _ in x]
        links = [(a.ids[i], b[j]) for i, (e, x) in enumerate(zip(ends_a, bytes_a)) for j in sorted(set(of_byte[e - len(x) : e]))]
        groups, left_a, left_b = [], list(zip(ends_a, a.ids)), list(zip(ends_b, b))
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for e, i in left_a if e <= cut], [i for e, i in left_b if e <= cut]))
            left_a, left_b = [x for x in left_a if x[0] > cut], [x for x in left_b if x[0] > cut]
        rows.append((a.ids, b, groups, links))
        counts.update(set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = row
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == most[p[0]] for p in links)
        out.append((len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), best, sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest()))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  two  spaces ", "▁x", "a▁b", "tab\tand\nline", "<|endoftext|> plain", "<0x41>", "</s> <s>", "日本語 テキスト", "\U0001f600\U0001f601", "ﬁ é", "\x00", "x" * 3000, "word " * 3000, "the the the", "the the the"]


def test_alignment_of_whole_table(spark):
    rows = sorted(table(spark, "documents").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in op12_alignment(spark, SF).collect()}
    short = [r for r in rows if len(r.text or "") < 6_000]
    assert len(got) == len(rows)
    assert {got[r.doc_id][0] > 0 for r in rows if r.text} == {True}
    some = spark.createDataFrame([(r.doc_id, r.text) for r in short], "doc_id long, text string")
    found = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in align_tokens(some, BYTES, PIECES).collect()}
    for r, want in zip(short, brute_alignment([r.text for r in short])):
        assert found[r.doc_id] == want
        assert got[r.doc_id][:5] + got[r.doc_id][7:] == want[:5] + want[7:]


@pytest.mark.parametrize("heavy", [500_000, 10, 0])
def test_alignment_of_odd_texts(spark, heavy):
    docs = documents(spark, list(enumerate(ODD))).withColumns({c: F.lit("mine") for c in ("place", "pairs", "count", "best")})
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in align_tokens(docs, BYTES, PIECES, heavy).collect()}
    assert [got[i] for i in range(len(ODD))] == brute_alignment(ODD)
    if heavy == 0:
        assert align_tokens(documents(spark, []), BYTES, PIECES, heavy).count() == 0
        twice = align_tokens(documents(spark, [(None, "one two"), (None, "one two"), (5, None)]), BYTES, PIECES, heavy)
        assert sorted((r.doc_id or 0, r.n_a, r.count_sum, r.n_best) for r in twice.collect()) == [(0, 2, 4, 2), (0, 2, 4, 2), (5, 0, 0, 0)]


# --- search ----------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=20):
    words = [(i, terms_of(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    holders = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc, w in words:
            if w:
                tf, m = Counter(w), 75 + 25 * len(w) * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms_of(text) if t in tf)
                if score > 0:
                    scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if gone else doc, -score) for rank, (score, gone, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found_by(spark, docs, items, k=20):
    items = spark.createDataFrame(items, "item_id int, text string").withColumns({c: F.lit("mine") for c in ("rank", "score", "place")})
    got = search(documents(spark, docs).withColumns({c: F.lit(1) for c in ("size", "terms", "score", "item_id")}), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("blocks", [4096, 3])
def test_search_like_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(search_module, "_BLOCK_ITEMS", blocks)
    monkeypatch.setattr(search_module, "_CELLS", 3000)
    rnd = random.Random(blocks)
    some = [f"W{i}é" if i % 3 else f"w{i}" for i in range(60)]
    docs = [(i // 2 if i % 7 else None, " ".join(rnd.choice(some[: rnd.choice([5, 60])]) for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    docs += [(7, None), (8, "--- !"), docs[3], docs[3]]
    items = [(i % 9, ", ".join(rnd.choice(some) for _ in range(rnd.randint(0, 25)))) for i in range(10)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w3 w3 w6"), (53, docs[0][1])]
    for k in (1, 4, 20):
        assert found_by(spark, docs, items, k) == brute_search(docs, items, k)


def test_search_without_documents_or_items(spark):
    assert found_by(spark, [], [(1, "a")]) == found_by(spark, [(1, "a")], []) == found_by(spark, [(1, None), (2, "?")], [(1, "a")]) == []


def test_search_of_very_long_texts(spark):
    docs = [(1, "one two " * 200_000), (2, "x" * 3_000_000 + " two"), (3, "two")]
    items = [(1, "one " + "two " * 5_000), (2, "X" * 3_000_000)]
    assert found_by(spark, docs, items) == brute_search(docs, items)


def test_shared_sums_add_up_each_item():
    rnd = np.random.default_rng(7)
    for _ in range(40):
        items = [rnd.integers(0, 25, size=rnd.integers(0, 60)) for _ in range(rnd.integers(1, 30))]
        values = rnd.integers(0, 1000, size=(25, 6))
        assert SharedSums(items).totals(values).tolist() == [values[i].sum(0).tolist() for i in items]


def test_shared_terms_are_added_up_once():
    common = list(range(20))
    items = [np.array(common + [100 + i]) for i in range(50)]
    items = [np.unique(np.concatenate(items), return_inverse=True)[1][21 * i : 21 * (i + 1)] for i in range(50)]
    sums = SharedSums(items)
    adds = sum(len(left) for left, _ in sums.levels) + len(sums.tops) - 50
    assert adds <= 19 + 50 < 50 * 20
