"""Problem 7: encoding of a whole corpus with a public byte-level BPE vocabulary.

Text is cut by the vocabulary's pattern; the bytes of each piece are merged with a priority queue of merge
ranks over a doubly linked list of symbols, where entries whose symbols have since been merged are skipped.
A piece of n bytes costs O(n log n), so long runs without spaces are no trap.  Decoding concatenates the
vocabulary's byte strings.

Two exact shortcuts keep the cost per character low.  Pieces repeat, so each Python worker keeps the ids of
pieces that it has met (a bounded table that is emptied when full).  And a piece is first cut where two
neighbouring bytes stand side by side in no entry of the vocabulary: no merge can ever cross such a place.

A null or empty text has an empty list of ids.  Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies are; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
#: Pieces whose ids a worker keeps, and the length beyond which a piece is not kept.
KEPT_PIECES, KEPT_LENGTH = 300_000, 48

# Fixed value: the pattern that cuts text for these vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# The same pattern for text of Latin letters and common signs, in classes that the standard module matches faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\x0b\x0c\r\x85\xa0"
_LATIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞€™\U0001f300-\U0001faff️]*")
_LATIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of the pieces met so far; computes those of a new one."""

    def __init__(self, tokenizer: ByteTokenizer):
        super().__init__()
        self.encode_piece = tokenizer.encode_piece

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids


class ByteTokenizer:
    """A byte-level BPE vocabulary read from a tokenizers JSON file or a rank file."""

    def __init__(self, raw: bytes):
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        if raw[:1] == b"{":
            model = json.loads(raw)["model"]
            letter = _byte_letters()
            as_bytes = lambda s: bytes(letter[c] for c in s)
            special = {t["content"] for t in json.loads(raw).get("added_tokens", [])}
            vocab = {as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
            for rank, m in enumerate(model["merges"]):
                a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
                self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        else:
            vocab = {base64.b64decode(t): int(i) for t, i in (line.split() for line in raw.splitlines() if line)}
            for t, i in vocab.items():
                for k in range(1, len(t)):
                    if t[:k] in vocab and t[k:] in vocab:
                        self.merges[vocab[t[:k]], vocab[t[k:]]] = (i, i)
        self.strings = {i: t for t, i in vocab.items()}
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.joined = np.zeros((256, 256), bool)  # byte pairs that stand side by side in some entry
        for t in vocab:
            for x, y in zip(t, t[1:]):
                self.joined[x, y] = True
        self.parts: dict[bytes, list[int]] = {}
        self.pieces = _Pieces(self)

    def merge(self, part: bytes) -> list[int]:
        """Merge the bytes of a part, lowest rank first and leftmost among equals."""
        sym = [self.byte_id[b] for b in part]
        n = len(sym)
        if n < 2:
            return sym
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:  # stale: one of the two was merged meanwhile
                continue
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, new, sym[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(queue, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) < 32 and piece.isascii():
            return self.merge(piece)
        a = np.frombuffer(piece, np.uint8)
        cuts = np.flatnonzero(~self.joined[a[:-1], a[1:]]) + 1
        if not len(cuts):
            return self.merge(piece)
        out: list[int] = []
        start = 0
        for end in [*cuts.tolist(), len(piece)]:
            part = piece[start:end]
            ids = self.parts.get(part)
            if ids is None:
                ids = self.merge(part)
                if len(part) <= KEPT_LENGTH:
                    self.parts[part] = ids
            out += ids
            start = end
        return out

    def pieces_of(self, text: str) -> list[str]:
        return _LATIN_PATTERN.findall(text) if _LATIN.fullmatch(text) else PATTERN.findall(text)

    def encode(self, text: str | None) -> Iterator[int]:
        if not text:
            return iter(())
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        if len(self.parts) > KEPT_PIECES:
            self.parts.clear()
        return chain.from_iterable(map(self.pieces.__getitem__, self.pieces_of(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer(name: str, raw: bytes) -> ByteTokenizer:
    """The tokenizer of a file's content; one per name in each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = ByteTokenizer(raw)
    return _LOADED[name]


def load(vocab: str, folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{vocab}", "rb") as f:
        return f.read()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): the token ids of every row.  The vocabulary, about 2 MB whatever the corpus, is broadcast."""
    raw = df.sparkSession.sparkContext.broadcast(load(vocab, folder))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocab, raw.value)
        for b in batches:
            lists = [np.fromiter(t.encode(x), np.int32) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(one, f"id {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", vocab: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the text of every list of ids; a null list gives null, an empty one the empty text."""
    raw = df.sparkSession.sparkContext.broadcast(load(vocab, folder))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocab, raw.value)
        for b in batches:
            out = [None if x is None else t.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(one, f"id {kind}, text string")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n): the number of tokens of every row; 0 for null and empty texts."""
    raw = df.sparkSession.sparkContext.broadcast(load(vocab, folder))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocab, raw.value)
        for b in batches:
            n = [sum(map(len, map(t.pieces.__getitem__, t.pieces_of(x)))) if x else 0 for x in b.column(1).to_pylist()]
            if len(t.pieces) > KEPT_PIECES:
                t.pieces.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(one, f"id {kind}, n bigint")
