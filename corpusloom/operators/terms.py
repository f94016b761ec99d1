"""Terms of a chunk of texts as numbers: counted by sorting, kept as blocks of bytes that a fit reads again and again.

A chunk's terms are packed with the row into 64 bits, exactly, so that one sort counts them.  Between chunks a term
has a code of 64 bits: of characters below U+1000, up to five, the characters themselves; of others a hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters and rows of a chunk; a longer text is a chunk of its own.
CHUNK_CHARS, CHUNK_ROWS = 1 << 18, 1 << 13
U = np.uint64
# Odd multipliers of the hashes.
ODD = np.random.default_rng(20).integers(1 << 62, 1 << 63, 64, dtype=U) * U(2) + U(1)
HASHED = U(1 << 63)
_RANK = np.zeros(0x110000, U)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Counts:
    """Of a chunk: the codes of its terms, their spelling by position, and (term, row, tf) of each pair that occurs, by term."""

    codes: np.ndarray
    spell: object
    term: np.ndarray
    row: np.ndarray
    tf: np.ndarray


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def pairs(grams: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(terms, term, row, tf) from one entry an occurrence; rows have so many bits."""
    keys = grams << U(bits) | rows.astype(U)
    keys.sort()
    first = starts_of(keys)
    tf, keys = np.diff(np.append(first, len(keys))), keys[first]
    g = keys >> U(bits)
    new = starts_of(g)
    return g[new], np.repeat(np.arange(len(new)), np.diff(np.append(new, len(g)))), (keys & U((1 << bits) - 1)).astype(np.int64), tf


def word_counts(texts: Sequence[str]) -> list[Counts]:
    """One and two words, of texts whose words stand between blanks."""
    split = pc.split_pattern(pa.array(texts, pa.string()), " ")
    flat = split.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    rows = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    at = flat.indices.to_numpy(zero_copy_only=False).astype(U) + U(1)
    if "" in words:  # an empty text
        there = at != words.index("") + 1
        at, rows = at[there], rows[there]
    wide, bits = len(words).bit_length(), max(1, (len(texts) - 1).bit_length())
    two = rows[1:] == rows[:-1]
    g, term, row, tf = pairs(np.concatenate([at, (at[:-1] << U(wide) | at[1:])[two]]), np.concatenate([rows, rows[1:][two]]), bits)
    a, b = (g >> U(wide)).astype(np.int64), (g & U((1 << wide) - 1)).astype(np.int64)
    h = np.concatenate([np.zeros(1, U), pd.util.hash_array(np.array(words, object))])
    spell = lambda k: [f"{words[a[i] - 1]} {words[b[i] - 1]}" if a[i] else words[b[i] - 1] for i in k]
    return [Counts(word_codes(h[a], h[b]), spell, term, row, tf)]


def word_codes(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Codes from the hashes of two words; first is 0 where there is one."""
    return mixed(first * ODD[0] + last * ODD[1]) | HASHED


def codes_of(block: int, terms: Sequence[str], high: int) -> np.ndarray:
    """Codes of terms that are given as text; block 0 holds words, 1 characters."""
    if block:
        return char_codes(np.array([[ord(c) for c in reversed(t)] + [0] * (high - len(t)) for t in terms], U).reshape(len(terms), high))
    apart = [(" " + t).rsplit(" ", 1) for t in terms]
    h = lambda words: np.where([w != "" for w in words], pd.util.hash_array(np.array(words, object)), U(0)) if words else np.zeros(0, U)
    return word_codes(h([a.strip() for a, _ in apart]), h([b for _, b in apart]))


def char_codes(chars: np.ndarray) -> np.ndarray:
    """Codes of terms, a column for each character from the last on, 0 where there is none."""
    h = mixed((chars * ODD[: chars.shape[1]]).sum(axis=1, dtype=U)) | HASHED
    if chars.shape[1] > 5:
        return h
    packed = np.zeros(len(chars), U)
    for k in range(chars.shape[1]):
        packed |= chars[:, k] << U(12 * k)
    return np.where((chars < 4096).all(axis=1), packed, h)


def char_counts(texts: Sequence[str], low: int, high: int, first: int = 0) -> list[Counts]:
    """Runs of low to high characters within tokens, of texts whose tokens have a blank of their own on either side; a token shorter than low gives itself."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.unique(data)
    wide, bits = len(alphabet).bit_length(), max(1, (len(texts) - 1).bit_length())
    if wide * high + bits > 64 and len(texts) > 1:
        half = len(texts) // 2
        return char_counts(texts[:half], low, high, first) + char_counts(texts[half:], low, high, first + half)
    long = wide * high + bits > 64  # one text of very many characters: its terms are hashed at once
    _RANK[alphabet] = np.arange(1, len(alphabet) + 1)
    rank = _RANK[data]
    rows = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    blank = data == 32
    apart = ~(blank[1:] & blank[:-1])  # no token goes over two blanks
    grams, of, starts, code, inside = [], [], [], rank, np.ones(len(data), bool)
    for n in range(1, high + 1):
        if n > len(data):
            break
        if n > 1:
            inside = inside[:-1] & apart[n - 2 :]
            code = code[:-1] * ODD[2] + mixed(rank[n - 1 :]) if long else code[:-1] << U(wide) | rank[n - 1 :]
        if n >= low or n >= 3:
            at = np.flatnonzero(inside if n >= low else inside & blank[: len(inside)] & blank[n - 1 :])
            grams.append(mixed(code[at] + ODD[n]) if long else code[at])
            of.append(rows[at])
            starts.append((at, n))
    grams, of = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams, U), (of, np.int64)))
    if long:
        g, where, tf = np.unique(grams, return_index=True, return_counts=True)
        term, row = np.arange(len(g)), np.zeros(len(g), np.int64)
        at, n = np.concatenate([a for a, _ in starts])[where], np.repeat([k for _, k in starts], [len(a) for a, _ in starts])[where]
        chars = np.stack([np.where(k < n, data[np.maximum(at + n - 1 - k, 0)], 0) for k in range(high)], axis=1).astype(U)
    else:
        g, term, row, tf = pairs(grams, of, bits)
        of_rank = np.concatenate([[0], alphabet]).astype(U)
        chars = np.stack([of_rank[((g >> U(wide * k)) & U((1 << wide) - 1)).astype(np.int64)] for k in range(high)], axis=1)
    spell = lambda k: ["".join(map(chr, reversed([c for c in chars[i].tolist() if c]))) for i in k]
    return [Counts(char_codes(chars), spell, term, row + first, tf)]


def chunks(*columns: Sequence[str]) -> Iterator[slice]:
    """Slices of the rows, of bounded length."""
    start = size = 0
    for k, texts in enumerate(zip(*columns)):
        n = max(map(len, texts))
        if k > start and (size + n > CHUNK_CHARS or k - start >= CHUNK_ROWS):
            yield slice(start, k)
            start, size = k, 0
        size += n
    if columns[0]:
        yield slice(start, len(columns[0]))


class Totals:
    """Document and term frequencies of a task's terms, merged as they grow."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.waiting, self.merged = 0, 0

    def add(self, c: Counts) -> None:
        n = len(c.codes)
        self.parts.append(np.stack([c.codes, np.bincount(c.term, minlength=n).astype(U), np.bincount(c.term, c.tf, n).astype(U)]))
        self.waiting += n
        if self.waiting > max(1 << 19, self.merged):
            self.get()

    def get(self) -> np.ndarray:
        self.parts = [summed(self.parts)]
        self.waiting, self.merged = 0, self.parts[0].shape[1]
        return self.parts[0]


def summed(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Rows codes, df, tf; codes ascending, each once."""
    every = np.concatenate([np.zeros((3, 0), U), *parts], axis=1)
    if not every.shape[1]:
        return every
    every = every[:, np.argsort(every[0])]
    first = starts_of(every[0])
    return np.stack([every[0][first], np.add.reduceat(every[1], first), np.add.reduceat(every[2], first)])


@dataclass
class Vocabulary:
    """Codes of the terms, ascending, and the place of each in the vocabulary."""

    codes: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(codes: np.ndarray) -> Vocabulary:
        order = np.argsort(codes)
        return Vocabulary(codes[order], order)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each, -1 where there is none."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.place[at], -1)


@dataclass
class Rows:
    """Entries of a chunk's rows: the words' part and the characters' part of each row in turn, places ascending; starts: of each part, and the end."""

    n: int
    at: np.ndarray
    tf: np.ndarray
    starts: np.ndarray


def encode(words: Sequence[str], chars: Sequence[str], vocabularies: Sequence[Vocabulary], ngrams: tuple[int, int]) -> Rows:
    keys, tfs, offset = [], [], 0
    for b, (v, counted) in enumerate(zip(vocabularies, (word_counts(words), char_counts(chars, *ngrams)))):
        for c in counted:
            place = v.find(c.codes)[c.term]
            there = place >= 0
            keys.append((c.row[there] * 2 + b) << 32 | (place[there] + offset))
            tfs.append(c.tf[there])
        offset += len(v.codes)
    key, tf = np.concatenate(keys), np.concatenate(tfs)
    order = np.argsort(key)
    key = key[order]
    return Rows(len(words), key & 0xFFFFFFFF, tf[order], np.searchsorted(key, np.arange(2 * len(words) + 1) << 32))


def part_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x over each part; 0 of an empty one."""
    out = np.zeros(len(starts) - 1)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, starts[some])
    return out
