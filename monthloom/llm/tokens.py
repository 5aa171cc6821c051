"""Whole texts to token ids, with every distinct piece of text encoded once.

A text is cut before each ASCII space that a non-space follows.  Neither
vocabulary lets a token cross such a place, so the ids of a text are those of
its pieces in order; the pieces repeat, and the tokenizers library sees each
distinct piece once in a while instead of once per use.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core

#: Parts, and pieces of the vocabulary that normalizes, remembered by a worker; beyond it the memory is emptied, which costs time only.
CACHED, PIECES_CACHED = 300_000, 600_000

_CUT = re.compile(r" (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it can be seen, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    ``splits`` is the vocabulary's own pre-tokenization; pieces are looked up
    by these parts, as "word" and "word," share one, and a part that is new
    goes to the vocabulary's merges.  ``lower`` is for the vocabulary that
    normalizes: Latin-1 pieces are then split in lower case; others go through
    the whole tokenizer.
    """

    def __init__(self, vocabulary: str, splits: str, lower: bool):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        # texts that may hold the string of an added token go whole through the library, which finds these first
        self.plain = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.added = sorted({t.content[:2].lower() for t in self.plain.get_added_tokens_decoder().values()})
        self.tokenizer.encode_special_tokens = True  # pieces hold no such string
        self.merges = self.tokenizer.model.tokenize
        self.splits = regex.compile(splits)
        self.lower = lower
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, parts: list[str]) -> None:
        whole = [x for x in parts if self.lower and not x.isascii() and max(x) > "\xff"]
        for x, ids in zip(whole, self._library(whole)):
            self.known[x] = np.array(ids, "<u4").tobytes()
        for x in set(parts).difference(whole):
            ids = [t.id for t in self.merges(x.encode().decode("latin-1").translate(BYTE_LETTERS))]
            self.known[x] = pack(f"<{len(ids)}I", *ids)

    def _parts(self, piece: str) -> str | list[str]:
        """What the vocabulary encodes on its own: a run of letters behind one space, or the matches of its pattern."""
        if not self.lower:
            return piece if piece[1:].isalpha() else self.splits.findall(piece)
        piece = piece.removeprefix(" ")
        if not piece:
            return []
        if piece.isascii() or max(piece) <= "\xff":
            piece = piece.lower()
            return piece if piece.isalpha() else self.splits.findall(piece)
        return piece

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if not self.lower:
            return self._new_pieces(pieces)
        if len(self.pieces) > PIECES_CACHED:
            self.pieces.clear()
        new = [x for x in pieces if x not in self.pieces]
        self.pieces.update(zip(new, self._new_pieces(new)))
        return list(map(self.pieces.__getitem__, pieces))

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        """Piece by piece, from their parts."""
        known = self.known
        if len(known) > CACHED:
            known.clear()
        split = [self._parts(x) for x in pieces]
        new = {x for x in split if x.__class__ is str}.difference(known)
        new.update(*(x for x in split if x.__class__ is list))
        self._encode_new([x for x in new if x not in known])
        part = known.__getitem__
        return [part(x) if x.__class__ is str else b"".join(map(part, x)) for x in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids begin (one more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), bool)
        for begin in self.added:
            special |= pc.match_substring(texts, begin, ignore_case=True).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._by_pieces(texts)
        ids, begins = self._by_pieces(pc.if_else(pa.array(special), pa.scalar("", pa.large_string()), texts))
        whole = {int(i): np.array(self.plain.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4") for i in np.flatnonzero(special)}
        each = [whole.get(i, ids[begins[i] : begins[i + 1]]) for i in range(len(texts))]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without the strings of added tokens."""
        rows = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, r" \s| $|[\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]").to_numpy(zero_copy_only=False))
        if len(odd):
            lists = {int(i): _CUT.split(t) for i, t in zip(odd, texts.take(pa.array(odd)).to_pylist())}
            parts, counts = [], np.diff(rows.offsets.to_numpy())
            at = 0
            flat, ends = rows.flatten(), rows.offsets.to_numpy()
            for i, xs in lists.items():
                parts += [flat.slice(ends[at] - ends[0], ends[i] - ends[at]), pa.array(xs, pa.large_string())]
                counts[i] = len(xs)
                at = i + 1
            parts.append(flat.slice(ends[at] - ends[0]))
            words = pa.concat_arrays([x.cast(pa.large_string()) for x in parts])
            begins = np.concatenate([[0], np.cumsum(counts)])
        else:
            words, begins = rows.flatten(), rows.offsets.to_numpy().astype(np.int64)
            begins = begins - begins[0]
        first = np.zeros(len(words), bool)
        first[begins[:-1]] = True
        coded = words.dictionary_encode()
        firsts = words.filter(pa.array(first)).dictionary_encode()
        rest = np.unique(coded.indices.to_numpy()[~first])
        index = np.zeros(max(len(coded.dictionary), 1), np.int64)
        index[rest] = np.arange(len(rest))
        ids = self._pieces([" " + x for x in coded.dictionary.take(pa.array(rest)).to_numpy(zero_copy_only=False)])
        ids += self._pieces(firsts.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = index[coded.indices.to_numpy()]
        at[first] = len(rest) + firsts.indices.to_numpy()
        table = pa.array(ids, pa.large_binary())
        sizes = np.diff(np.frombuffer(table.buffers()[1], np.int64, len(table) + 1)) // 4 if len(table) else np.zeros(0, np.int64)
        taken = table.take(pa.array(at))
        out = np.frombuffer(taken.buffers()[2], "<u4") if len(at) and sizes.sum() else np.zeros(0, "<u4")
        ends = np.concatenate([[0], np.cumsum(sizes[at])]) if len(at) else np.zeros(1, np.int64)
        return out[: ends[-1]], ends[begins]


@lru_cache(maxsize=4)
def encoder(vocabulary: str, splits: str, lower: bool) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(vocabulary, splits, lower)


#: Fixed values of the two vocabularies: file, pre-tokenization, whether it lowers case.
BYTE_BPE = ("byte_bpe_50k.json", public_tokenizers.PATTERN, False)
WORD_BPE = ("word_bpe_49k.json", r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", True)
