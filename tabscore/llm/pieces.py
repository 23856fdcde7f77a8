"""SentencePiece encoding and decoding over a prefix table (operator 8).

Merge-type vocabularies encode a prefix of a text to tokens whose last one is
unique: it is the only token that ends there, found in the vocabulary, and stands
after the last token of the rest without a merge across the border. So one pass
from left to right stores the last token of every prefix, and a walk backwards
reads the ids off. Matches ending at a position come from an automaton over all
pieces; whether two tokens may stand side by side is tested once per pair.

Nulls encode like empty texts: no ids, empty decoded text. Repeated rows give
repeated rows, an empty table an empty one; other columns are dropped unless kept
by name, so none can clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tabscore.llm.common import column

BLANK = "▁"
# Words, their characters and pairs remembered per Python worker; beyond it the memory starts anew. Longer words are not remembered.
WORDS_KEPT = 300_000
WORD_CHARS = 64
CHARS_KEPT = 4_000_000
PAIRS_KEPT = 400_000
# Ways to cut a text into words with their leading blanks, the finest first; a vocabulary has to allow it.
CUTS = (re.compile(" *[A-Za-zÀ-ÖØ-öø-ɏ]+| *[^A-Za-zÀ-ÖØ-öø-ɏ ]+| +"), re.compile(" *[^ ]+| +"))


class PieceCodec:
    """Encoder and decoder for one merge-type model file with byte fallback."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.pieces: list[str | bytes | None] = []
        self.byte_ids: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.pieces.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.pieces.append(None)
            else:
                self.ids[piece] = i
                self.rank[piece] = model.get_score(i)
                self.pieces.append(piece)
        self.unknown = model.unk_id()
        # Where no piece holds both sides of a border, a text falls apart there: before blanks, around letter runs.
        self.cut = next((c for c in CUTS if all(len(c.findall(p.replace(BLANK, " "))) == 1 for p in self.ids)), None)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # A piece that its own merges do not build is never the last token.
            if len(piece) > 1 and self.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts = _Memory(self.both)
        self.words = _Memory(self.parts_joined if self.cut is CUTS[0] else self.both)

    def merge(self, word: str) -> list[str]:
        """The merges themselves, best score first, leftmost on a tie."""
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (made := parts[i] + parts[j]) in self.rank:
                heapq.heappush(queue, (-self.rank[made], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def side_by_side(self, left: str, right: str) -> bool:
        """Whether the merges of both together leave them as they are."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        fits = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return fits

    def tokens(self, word: str) -> list[str]:
        """Tokens of a word by the prefix table."""
        if BLANK * 2 in word:
            # Runs of blanks share one score: their order of merging is by place, not by piece.
            return self.merge(word)
        ending: list[list[str] | None] = [None] * len(word)
        for end, piece in self.automaton.iter(word):  # the longest first
            if ending[end] is None:
                ending[end] = [piece]
            else:
                ending[end].append(piece)
        last: list[str] = []
        pairs = self.pairs
        for end, candidates in enumerate(ending):
            token = None
            for piece in candidates or ():
                rest = end - len(piece)
                if rest < 0:
                    token = piece
                    break
                fits = pairs.get((last[rest], piece))
                if fits or fits is None and self.side_by_side(last[rest], piece):
                    token = piece
                    break
            # Every character is a token of its own if nothing longer ends here.
            last.append(token or word[end])
        out, end = [], len(word) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def word_ids(self, word: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(word):
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in token.encode()]
            else:
                out.append(self.unknown)
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text, each with its leading blanks, the added first blank included."""
        text = text.replace(BLANK, " ")
        if not self.cut:
            return [" " + text]
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return CUTS[-1].findall(" " + text)
        return [" " + w for w in text.split(" ")]

    def both(self, word: str) -> tuple[str, str]:
        """Ids and decoded text of a word; bytes of one character never span words, so words decode one by one."""
        ids = self.word_ids(word.replace(" ", BLANK))
        # decode() drops the first blank of a text: one that stands before the word is dropped in its place.
        return ",".join(map(str, ids)), self.decode([self.ids[BLANK], *ids])

    def parts_joined(self, word: str) -> tuple[str, str]:
        found = [self.parts[p] for p in self.cut.findall(word)]
        return ",".join([ids for ids, _ in found]), "".join([text for _, text in found])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for w in self.split(text) for i in self.word_ids(w.replace(" ", BLANK))]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: blanks back, bytes joined to characters, the added first blank dropped."""
        out, held = [], b""
        for i in ids:
            piece = self.pieces[i]
            if isinstance(piece, bytes):
                held += piece
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = b""
            out.append(" ⁇ " if piece is None and i == self.unknown else (piece or ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if text.startswith(BLANK) else text).replace(BLANK, " ")


class _Memory(dict):
    """Comma-joined ids and decoded text by word, the bounded memory of one Python worker."""

    def __init__(self, work: Callable[[str], tuple[str, str]]):
        super().__init__()
        self.work, self.chars = work, 0

    def __missing__(self, word: str) -> tuple[str, str]:
        made = self.work(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS_KEPT or self.chars >= CHARS_KEPT:
                self.clear()
                self.chars = 0
            self[word] = made
            self.chars += len(word)
        return made


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns the columns of ``keep``, then ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``, with ``ids`` also the ids and the decoded text. Map-only.
    """
    # Kept columns travel under plain names: Arrow tasks can not take dots in them.
    source = docs.select(*[column(k).alias(f"kept_{i}") for i, k in enumerate(keep)], column(text).cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    carried = source.columns[:-1]
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        words = own.words
        for batch in batches:
            counts, id_hash, text_hash, all_ids, all_texts = [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                value = value.as_py() or ""
                parts = [words[w] for w in own.split(value)] if value else []
                joined = ",".join([ids for ids, _ in parts])
                counts.append(joined.count(",") + 1 if joined else 0)
                id_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                back = "".join([part for _, part in parts])[1:]
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    all_ids.append([int(i) for i in joined.split(",")] if joined else [])
                    all_texts.append(back)
            out = batch.columns[:-1] + [pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [*carried, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    out = source.mapInArrow(run, schema)
    return out.toDF(*keep, *out.columns[len(keep) :])
