"""Token ids of whole texts by way of their distinct words.

The tokenizer word_bpe_49k.json drops white space and merges within words only, so a text's ids are
its white-space-separated words' ids in turn. Each distinct word is encoded once a slice of the input
and kept in a table of bounded size; texts are then gathered from the table with numpy.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WordCodes, coded_words, joined, ragged, run_sums, text_slices


def specials_of(path: str) -> dict[str, int]:
    """The tokenizer's special strings, which it takes out of a text before all else."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class TextIds:
    """ids of texts. encode_words(words by code) gives (ids one after another, ids of each word)."""

    def __init__(self, encode_words: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], specials: dict[str, int]):
        self.encode_words, self.specials = encode_words, specials
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")

    def without_specials(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(texts, the id that follows each or -1, the row each is from): texts are cut at special strings."""
        n = len(column)
        has = np.zeros(n, bool)
        for s in self.specials:
            has |= pc.match_substring(column, s).to_numpy(zero_copy_only=False).astype(bool)
        if not has.any():
            return column, np.full(n, -1), np.arange(n)
        texts, after, rows = [], [], []
        for i, t in enumerate(column.to_pylist()):
            parts = self.special.split(t) if has[i] else [t]
            texts += parts[::2]
            after += [self.specials[s] for s in parts[1::2]] + [-1]
            rows += [i] * len(parts[::2])
        return pa.array(texts, pa.string()), np.array(after), np.array(rows)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, the number of each text's ids). No nulls are expected."""
        flats, counts = [np.zeros(0, np.uint32)], np.zeros(len(column), np.int64)
        for a, b in text_slices(column):
            texts, after, rows = self.without_specials(column.slice(a, b - a))
            codes, words, distinct = coded_words(texts)
            flat, lens = self.encode_words(distinct)
            starts = (np.cumsum(lens) - lens)[codes]
            lens = lens[codes]
            flat, n = flat[ragged(starts, lens)], run_sums(lens, words)
            if (after >= 0).any():
                flat = np.insert(flat, np.cumsum(n)[after >= 0], after[after >= 0].astype(np.uint32))
                n = n + (after >= 0)
            flats.append(flat)
            counts[a:b] = np.bincount(rows, n, b - a).astype(np.int64)
        return np.concatenate(flats), counts


def byte_letters() -> dict[int, int]:
    """Byte -> the code point that stands for it in a byte-level vocabulary: printable bytes stand for themselves, the others take 256, 257, ... in order."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(itself)]
    return {b: b for b in itself} | {b: 256 + n for n, b in enumerate(others)}


def classes(end: int = 0x300) -> tuple[str, str]:
    """Letters and numbers below `end`, as inner parts of a pattern's class."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(end)}
    return tuple(re.escape("".join(chr(c) for c in range(end) if kinds[c] == k)) for k in "LN")


LETTERS, NUMBERS = classes()
# White space as the tokenizer has it, and its word pattern, here for words whose characters are all
# below U+0200; these are in normal form already, and their lower case is below U+0300.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+|\n")
BEYOND = re.compile("[^\x00-\u01ff]")
# The normal form and the word pattern that a tokenizer file must name, for PIECE to cut as it does.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Pieces:
    """Words between white space -> the tokenizer's word pieces as text, lower-cased and in normal form."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") != "</w>" or spec.get("decoder"):
            raise ValueError(f"{path}: a BPE tokenizer with word ends and no decoder is expected")
        if spec.get("normalizer") != NORMALIZER or spec.get("pre_tokenizer") != PRE_TOKENIZER:
            raise ValueError(f"{path}: another normal form or word pattern than PIECE stands for")
        self.normalize, self.cut = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.byte = {chr(v): k for k, v in byte_letters().items()}

    def __call__(self, words: pa.Array) -> list[str]:
        """All words' pieces in turn, each word's followed by a line end (which no word has)."""
        if not len(words):
            return []
        whole = joined(words)
        if not BEYOND.search(whole):
            return [*PIECE.findall(whole.lower()), "\n"]
        out: list[str] = []
        for w in words.to_pylist():
            out += [bytes(self.byte[c] for c in p).decode() for p, _ in self.cut(self.normalize(w))] if BEYOND.search(w) else PIECE.findall(w.lower())
            out.append("\n")
        return out


class PieceIds:
    """encode_words by way of distinct pieces; encode_pieces(list of pieces) gives (ids, ids of each piece).

    Pieces once encoded are kept in a table of bounded size. When it is full, pieces that occurred in one slice only go
    first, then those that occurred in fewest; frequent ones are never encoded again.
    """

    def __init__(self, pieces: Pieces, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 250_000):
        self.pieces, self.encode_pieces, self.codes = pieces, encode_pieces, WordCodes(most)
        self.codes["\n"]  # code 0, without ids
        self.lens, self.starts, self.pool, self.slices = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def trim(self) -> None:
        """Keep the pieces of several slices, at most half of the table, and halve what they have been counted."""
        order = np.argsort(-self.slices[1:], kind="stable")[: self.codes.most // 2] + 1
        kept = np.concatenate([[0], np.sort(order[self.slices[order] > 1])])
        words = [self.codes.words[k] for k in kept.tolist()]
        self.pool = self.pool[ragged(self.starts[kept], self.lens[kept])]
        self.lens, self.slices = self.lens[kept], self.slices[kept] // 2
        self.starts = np.cumsum(self.lens) - self.lens
        self.codes.reset()
        for w in words:
            self.codes[w]

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.codes.over():
            self.trim()
        found = self.pieces(words)
        c = np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found))
        if new := self.codes.words[len(self.lens) :]:
            flat, lens = self.encode_pieces(new)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
            self.lens, self.pool = np.concatenate([self.lens, lens]), np.concatenate([self.pool, flat])
            self.slices = np.concatenate([self.slices, np.zeros(len(new), np.int64)])
        here = np.zeros(len(self.lens), bool)
        here[c] = True
        self.slices += here
        lens = self.lens[c]
        ends = np.flatnonzero(c == 0)
        return self.pool[ragged(self.starts[c], lens)], run_sums(lens, np.diff(ends, prepend=-1))


def library_pieces(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """encode_pieces by the tokenizers library's own BPE model."""
    from tokenizers import Tokenizer

    tokenize, letters = Tokenizer.from_file(path).model.tokenize, byte_letters()

    def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))] for p in pieces]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    return encode_pieces


@functools.cache
def library_ids(path: str) -> TextIds:
    """TextIds as the tokenizers library encodes, with add_special_tokens=False and unused truncation and padding. A worker process has one."""
    return TextIds(PieceIds(Pieces(path), library_pieces(path)), specials_of(path))
