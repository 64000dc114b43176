"""Token ids of whole texts from the ``tokenizers`` library, worked out once per distinct word.

Texts repeat their words, so they are cut where the library's own rules never join two pieces, each distinct word is
encoded once per worker, and the ids of a text are put together in numpy. Common punctuation behind a word of letters
is cut off and remembered apart. Vocabulary files are read by the workers, from a path that is a parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm import batches

#: Distinct words that a worker remembers; beyond that, those seen once are forgotten.
REMEMBERED = 400_000

# How the two vocabularies cut plain ASCII words into pieces before merging.
LOWER_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
SPACED_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\n")
#: Punctuation that is cut off behind letters.
ENDS = ".,;:!?"
#: Letters below are letters to every version of the character tables; the odd one's lower case ends in a mark.
LETTERS_BELOW, ODD_LETTER = "\u0250", "\u0130"

Ragged = tuple[np.ndarray, np.ndarray]


class Memory:
    """Distinct words and the ids of each, in one pool. ``encode`` gives the ids of a list of words."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.code: dict[str, int] = {}
        self.starts = self.lengths = self.seen = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def codes(self, words: pa.Array) -> np.ndarray:
        """The code of every word; new ones are encoded first."""
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        coded = words.dictionary_encode()
        indices = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.code]
        if len(self.code) + len(new) > self.most:
            self.forget()
            new = [w for w in distinct if w not in self.code]
        known = self.code
        if new:
            ids = self.encode(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
            self.starts = np.concatenate([self.starts, len(self.pool) + batches.offsets_of(lengths)[:-1]])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
            self.pool = np.concatenate([self.pool, flat])
        own = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        self.seen[own] += np.bincount(indices, minlength=len(own))
        return own[indices]

    def forget(self) -> None:
        """Keep what was seen more than once since the last time, if that is at most half."""
        keep = np.flatnonzero(self.seen > 1)
        keep = keep if len(keep) <= self.most // 2 else keep[:0]
        kept = np.full(len(self.code), -1, np.int64)
        kept[keep] = np.arange(len(keep))
        self.code = {w: int(kept[c]) for w, c in self.code.items() if kept[c] >= 0}
        self.pool = batches.gather(self.pool, self.starts[keep], self.lengths[keep])
        self.lengths = self.lengths[keep]
        self.starts = batches.offsets_of(self.lengths)[:-1]
        self.seen = self.seen[keep] // 4


class Words:
    """Words with the punctuation behind them, each remembered apart."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], encode_end: Callable[[list[str]], list[list[int]]]):
        self.memories = Memory(encode), Memory(encode_end)

    def __call__(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where the ids of each word and of its end begin, one after the other, and how many they
        are."""
        stems = pc.utf8_rtrim(words, ENDS)
        letters = pc.and_not(pc.utf8_is_alpha(stems), pc.ends_with(stems, ODD_LETTER))
        stems = pc.if_else(letters, stems, words)
        n = (pc.binary_length(words).to_numpy(zero_copy_only=False)
             - pc.binary_length(stems).to_numpy(zero_copy_only=False)).astype(np.int64)
        ended = np.flatnonzero(n)
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset:]
        signs = batches.gather(np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets[1:][ended] - n[ended], n[ended])
        ends = pa.StringArray.from_buffers(len(ended), pa.py_buffer(batches.offsets_of(n[ended]).astype(np.int32)),
                                           pa.py_buffer(signs))
        starts, lengths, pools, begin = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64), [], 0
        for place, (memory, rows, own) in enumerate(zip(self.memories, (slice(None), ended), (stems, ends))):
            codes = memory.codes(own)
            starts[rows, place], lengths[rows, place] = memory.starts[codes] + begin, memory.lengths[codes]
            begin += len(memory.pool)
            pools.append(memory.pool)
        return np.concatenate(pools), starts, lengths


class Library:
    """The library with a vocabulary. ``plain`` takes the strings of special tokens as any other text."""

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer, self.plain = load(path, plain), plain
        self.sign = {b: c for c, b in byte_of().items()}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, piece: str) -> list[int]:
        """The ids of what the library would not cut any more."""
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.sign))]

    def words(self, words: list[str], cut: re.Pattern, change: Callable[[str], str],
              whole: Callable[[str], str]) -> list[list[int]]:
        """The ids of words: of what ``cut`` cuts ``change`` of a word into, or of a word of European letters as one
        piece; all others go to the library as ``whole`` makes them."""
        out, rest = [], []
        for n, word in enumerate(words):
            if word.isascii() and word.isprintable() and (self.plain or "<|" not in word):
                out.append([i for p in cut.findall(change(word)) for i in self.piece(p)])
            elif word.isalpha() and max(word) < LETTERS_BELOW and ODD_LETTER not in word:
                out.append(self.piece(change(word)))
            else:
                out.append(None)
                rest.append(n)
        for n, ids in zip(rest, self([whole(words[n]) for n in rest])):
            out[n] = ids
        return out


class LowerWords:
    """Ids for a vocabulary that lower-cases and drops white space: words are cut at ASCII white space."""

    def __init__(self, path: str):
        self.library = Library(path)
        self.words = Words(self.encode, self.encode)

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.library.words(words, LOWER_PIECES, str.lower, str)

    def __call__(self, texts: pa.StringArray) -> Ragged:
        """All ids, and where each text's begin."""
        lists = pc.ascii_split_whitespace(texts)
        offsets = batches.offsets_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        pool, starts, lengths = self.words(lists.flatten())
        return (batches.gather(pool, starts.ravel(), lengths.ravel()),
                batches.offsets_of(batches.sums(lengths.sum(axis=1), offsets)))


class SpacedWords:
    """Ids for a byte-level vocabulary whose pieces begin with a space: texts are cut before spaces and line ends.

    No piece holds white space behind another character, so a cut between such a character and the run of white space
    behind it is safe. Words are kept with the run before them: a line end and what follows stands as it is, any other
    word has one space before it. A text's first word is looked up behind a line end, whose one id is left out. Texts
    with other spaces (double, leading, trailing, before a line end) go to the library whole. With ``spaced``, the text
    is taken as if a space stood before it.
    """

    def __init__(self, path: str, plain: bool = False, spaced: bool = False):
        self.library, self.spaced = Library(path, plain), spaced
        self.words = Words(self.encode, self.encode_end)

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None if can_cut(w) else [-1] for w in words]  # marks a text not to be cut here
        own = [n for n, ids in enumerate(out) if ids is None]
        for n, ids in zip(own, self.library.words([words[n] for n in own], SPACED_PIECES, with_run, with_run)):
            out[n] = ids
        return out

    def encode_end(self, ends: list[str]) -> list[list[int]]:
        return [self.library.piece(e) for e in ends]

    def __call__(self, texts: pa.StringArray) -> Ragged:
        """All ids, and where each text's begin."""
        runs = pc.match_substring(texts, "\n\n")
        if pc.any(runs).as_py():
            lined = pc.if_else(runs, pc.replace_substring_regex(texts, r"(\n+)", r" \1"),
                               pc.replace_substring(texts, "\n", " \n"))
        else:
            lined = pc.replace_substring(texts, "\n", " \n")
        lists = pc.split_pattern(lined, " ")
        words = batches.offsets_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        odd, cut = np.zeros(len(texts), bool), np.zeros(len(flat), np.int64)
        if not self.spaced and len(texts):
            first = words[:-1]
            own = flat.take(pa.array(first)).to_pylist()
            odd = np.array([not can_cut(w) or w[0] == "\n" for w in own], bool)
            cut[first] = 1
            flat = pc.replace_with_mask(flat, pa.array(cut == 1), pa.array(["\n" + w for w in own], pa.string()))
        pool, starts, lengths = self.words(flat)
        starts[:, 0] += cut
        lengths[:, 0] -= cut
        ids = batches.gather(pool, starts.ravel(), lengths.ravel())
        offsets = batches.offsets_of(batches.sums(lengths.sum(axis=1), words))
        whole = np.flatnonzero(odd | (batches.sums(ids < 0, offsets) > 0))
        before = " " if self.spaced else ""
        return replaced(ids, offsets, whole, self.library([before + t for t in texts.take(pa.array(whole)).to_pylist()]))


def replaced(ids: np.ndarray, offsets: np.ndarray, whole: np.ndarray, got: list[list[int]]) -> Ragged:
    """The ids with those of some texts put in place of what was there."""
    if not len(whole):
        return ids, offsets
    new, starts = np.diff(offsets), offsets[:-1].copy()
    new[whole] = list(map(len, got))
    starts[whole] = len(ids) + batches.offsets_of(new[whole])[:-1]
    return batches.gather(np.concatenate([ids, *(np.array(g, np.int32) for g in got)]), starts, new), batches.offsets_of(new)


def with_run(word: str) -> str:
    """A word with the white space before it."""
    return word if word[0] == "\n" else " " + word


def can_cut(word: str) -> bool:
    """Whether a word is more than white space, ends in another character and begins with one or a line end."""
    return bool(word) and not word[-1].isspace() and (word[0] == "\n" or not word[0].isspace())


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return {chr(b) if b in shown else chr(next(others)): b for b in range(256)}


@lru_cache(maxsize=4)
def entries(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for; a mark of a word's end stands for none."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    end, value = described["model"]["end_of_word_suffix"] or "", byte_of()
    out = [b""] * (max(described["model"]["vocab"].values()) + 1)
    for piece, n in described["model"]["vocab"].items():
        piece = piece.removesuffix(end) if end else piece
        out[n] = bytes(map(value.__getitem__, piece)) if all(c in value for c in piece) else piece.encode()
    for token in described["added_tokens"]:
        out += [b""] * (token["id"] + 1 - len(out))
        out[token["id"]] = token["content"].encode()
    return out


@lru_cache(maxsize=8)
def load(path: str, plain: bool = False):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


@lru_cache(maxsize=4)
def lower_words(path: str) -> LowerWords:
    """One per worker, so that words stay remembered from task to task."""
    return LowerWords(path)


@lru_cache(maxsize=4)
def spaced_words(path: str, plain: bool = False, spaced: bool = False) -> SpacedWords:
    return SpacedWords(path, plain, spaced)
