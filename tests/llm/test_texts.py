"""SentencePiece, packing, SimHash, substrings: against libraries and brute force."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from awkward import documents, no_documents, rows  # noqa: E402

from tabscore.llm import packing, pieces, simhash, substrings  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "the", "ing", "  ", " ", "\n", "\t", "é", "ß", "中", "🙂", "▁", "1", "23", "=", ".", "<s>", "\u0000", "Ａ", "ﬁ", "'ll", "tion", "    ", "x" * 30, "<|endoftext|>", "\x1c"]


def random_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(20))) for _ in range(n)]


# ---- SentencePiece --------------------------------------------------------


def test_pieces_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.codec(MODEL)
    for text in random_texts(3_000, 1):
        ids = library.encode(text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids), repr(text)


def test_pieces_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 3)
    own, library = pieces.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "Words and more words, the memory forgets them. " * 3
    assert ",".join(own.words[w][0] for w in own.split(text)) == ",".join(map(str, library.encode(text)))


def test_pieces_of_awkward_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, pieces.encode_texts(documents(spark), MODEL).collect()), key=repr)
    want = []
    for row in rows():
        ids = library.encode(row[1] or "")
        want.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert pieces.encode_texts(no_documents(spark), MODEL).count() == 0
    kept = pieces.encode_texts(documents(spark), MODEL, keep=("doc_id", "a.b"), ids=True).filter("doc_id = 1").first()
    assert kept["decoded"].startswith("Plain") and len(kept["ids"]) == kept["n_tokens"]


def test_op8_equals_the_library(spark, sf):
    from tabscore.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# ---- packing --------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_word_ids_equal_the_tokenizer(tokenizer):
    known = packing.words(RANKS, public_tokenizers.PATTERN)
    for text in random_texts(3_000, 2):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert known.text(text) == want, repr(text)


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def check_packing(out, texts, tokenizer, length):
    want = {}
    for doc, text in texts:
        want.setdefault(doc, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sum(r.length for r in out) == sum(len(ids) for copies in want.values() for ids in copies)
    for doc, copies in want.items():
        assert sum(r.length for r in by_doc[doc]) == sum(map(len, copies))
        if len(copies) == 1:
            own = sorted(by_doc[doc], key=lambda r: r.start)
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
            assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == copies[0]
            assert {r.doc_tokens for r in own} == {len(copies[0])}
    for own in by_sequence.values():
        own = sorted(own, key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) <= length
    return by_sequence


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_of_awkward_rows(spark, tokenizer, length):
    out = packing.pack(documents(spark), RANKS, public_tokenizers.PATTERN, length=length, ids=True).collect()
    texts = [(r[0], r[1]) for r in rows()]
    packed = check_packing(out, texts, tokenizer, length)
    short = [k for k, own in packed.items() if sum(r.length for r in own) < length]
    assert len(short) <= 4  # at most one a range
    assert packing.pack(no_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op10_over_all_documents(spark, sf, tokenizer):
    from tabscore.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = packing.pack(docs, RANKS, public_tokenizers.PATTERN, ids=True).collect()
    check_packing(out, [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 2048)
    assert QUERIES["op10_packing"](spark, sf).count() == len(out)


def test_copies_have_equal_keys():
    import pyarrow as pa

    a, b, c = packing.curve_keys(pa.array(["some text here", "some text here", None])).tolist()
    assert a == b and isinstance(c, int)


# ---- SimHash --------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def plain_groups(pairs: list[tuple]) -> list[tuple]:
    """(id, fingerprint, component) by comparing all with all."""
    names = list(range(len(pairs)))

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                names[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            ids[top(i)] = min(ids.get(top(i), doc), doc)
    return sorted(((doc, f"{fp:016x}", ids.get(top(i))) for i, (doc, fp) in enumerate(pairs)), key=repr)


def test_simhash_of_awkward_rows(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    want = plain_groups([(r[0], plain_fingerprint(r[1])) for r in rows()])
    assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_simhash_over_all_documents(spark, sf):
    from tabscore.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = plain_groups([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    assert sorted(map(tuple, QUERIES["op2_simhash"](spark, sf).collect()), key=repr) == want


@pytest.mark.parametrize("tree_rows", [16, 4_096])
def test_links_between_planted_fingerprints(spark, tree_rows):
    """Chains, balls and shards far larger than a tree: the components are those of all pairs."""
    rng = np.random.default_rng(3)
    one = np.uint64(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    chain = [base[0]]
    for bit in range(0, 40, 2):
        chain.append(chain[-1] ^ (one << np.uint64(bit)) ^ (one << np.uint64(bit + 1)))
    ball = [base[1] ^ (one << np.uint64(i)) for i in range(64)]
    shard = [(base[2] & ~np.uint64(0xFFFFFF)) | np.uint64(v) for v in rng.integers(0, 1 << 24, 300)]
    fps = np.unique(np.array([*base, *chain, *ball, *shard], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(df, 2, tree_rows)).collect()}
    want = {}
    for doc, _, component in plain_groups([(i, int(x)) for i, x in enumerate(fps)]):
        want.setdefault(component, set()).add(doc)
    got = {}
    for i, x in enumerate(fps.view(np.int64).tolist()):
        got.setdefault(roots.get(x, x), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_text_has_the_plain_fingerprint():
    text = "one two three four five " * 30_000
    assert simhash.fingerprint(text) == plain_fingerprint(text)


# ---- substrings -----------------------------------------------------------


def plain_dedup(table: list[tuple]) -> list[tuple]:
    """Spans by looking every chunk up in a plain dictionary."""
    owner, cut = {}, {}
    for doc, text in table:
        if text is None:
            continue
        raw, start, out = text.encode(), 0, []
        for end in substrings.borders(np.frombuffer(raw, np.uint8)):
            out.append((start, end, raw[start:end]))
            start = end
        cut[doc, text] = out
        for _, _, chunk in out:
            owner[chunk] = min(owner.get(chunk, doc), doc, key=lambda d: (d is not None, d))
    result = []
    for doc, text in table:
        if text is None:
            result.append((doc, None, 0))
            continue
        raw, seen, spans = text.encode(), set(), []
        for start, end, chunk in cut[doc, text]:
            if chunk in seen or owner[chunk] != doc:
                if spans and spans[-1][1] == start:
                    spans[-1][1] = end
                else:
                    spans.append([start, end])
            seen.add(chunk)
        spans = [s for s in spans if s[1] - s[0] >= substrings.MIN_SPAN]
        edges = [0, *[e for s in spans for e in s], len(raw)]
        after = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
        result.append((doc, after, len(spans)))
    return sorted(result, key=repr)


def test_substrings_of_awkward_rows(spark):
    out = substrings.dedup_substrings(documents(spark))
    own = {"spans": "spans_", "n_removed": "n_removed_"}
    assert out.columns == [own.get(c, c) for c in documents(spark).columns] + ["n_removed", "n_spans", "spans"]
    assert {(r.mark, r.digest, r["a.b"], r.spans_, r._spans, r._row_doc, r.n_removed_) for r in out.collect()} == {("m", "d", 1, "s", "_s", "_r", "n")}
    got = sorted(((r.doc_id, r.text, r.n_spans) for r in out.collect()), key=repr)
    assert got == plain_dedup([(r[0], r[1]) for r in rows()])
    assert substrings.dedup_substrings(no_documents(spark)).count() == 0
    # The passage of documents 6 and 7 stays in the first only.
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[6].n_removed == 0 and by_id[7].n_removed > 300 and by_id[8].n_removed > 300 and by_id[1].n_removed == 0


def test_passages_go_and_common_lines_stay(spark):
    """Planted passages of 55 words lose the greater part of their second copy; a line that many texts share stays."""
    rng = np.random.default_rng(7)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(4_000)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    line = "A line that many texts share, of eight words."
    passages = [prose(55) for _ in range(150)]
    table = [(2 * i + j, f"{prose(90)} {p} {prose(90)}") for i, p in enumerate(passages) for j in (0, 1)]
    clean = [(1_000 + i, f"{prose(90)}\n{line}\n{prose(90)}") for i in range(150)]
    out = {r.doc_id: r for r in substrings.dedup_substrings(spark.createDataFrame(table + clean, "doc_id long, text string")).collect()}
    caught = [out[2 * i + 1].n_removed > 0 for i in range(150)]
    assert np.mean(caught) >= 0.95
    assert not any(out[2 * i].n_removed for i in range(150)) and not any(out[d].n_removed for d, _ in clean)
    cut = sum(out[2 * i + 1].n_removed for i in range(150)) / sum(len(p) for p in passages)
    assert cut > 0.5, cut


def test_substrings_over_all_documents(spark, sf):
    from tabscore.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = QUERIES["op1_substring_dedup"](spark, sf)
    assert sorted(((r.doc_id, r.text, r.n_spans) for r in got.collect()), key=repr) == plain_dedup([(r.doc_id, r.text) for r in docs])


def test_an_insertion_moves_few_borders():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate([data[:5_000], rng.integers(97, 123, 7).astype(np.uint8), data[5_000:]])
    before = {data[a:b].tobytes() for a, b in zip([0, *substrings.borders(data)], substrings.borders(data))}
    after = {moved[a:b].tobytes() for a, b in zip([0, *substrings.borders(moved)], substrings.borders(moved))}
    assert len(before - after) <= 6


@pytest.mark.parametrize("text", ["", "a" * 5_000, "é" * 3_000, "🙂" * 2_000, "ab"])
def test_borders_lie_between_characters(text):
    raw = text.encode()
    ends = substrings.borders(np.frombuffer(raw, np.uint8))
    assert (ends[-1:] or [0]) == [len(raw)]
    assert "".join(raw[a:b].decode() for a, b in zip([0, *ends], ends)) == text


