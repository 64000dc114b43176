"""Token counts by merging all distinct pre-tokens at once in numpy.

Texts are cut into words, words into pre-tokens, and the distinct ones of a batch are held as one ragged array
of symbols. In each round every pre-token finds its pair of the lowest rank and merges all places of that pair;
those without a pair are done, and their count is what is left of them. No library is asked for the counts.

Null texts count as empty and give 0 tokens and 0 bytes. Every row gives one row, equal ids or not; a null id stays
null. Other columns are not looked at. White space only gives 0 tokens. Very long texts are counted in whole; a long run
of letters without a break is one pre-token, whose rounds take time with its length. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm import batches
from millrace.llm.pretokens import LOWER_PIECES, Memory

# Fixed value: how the vocabulary cuts a normalised text into pre-tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x85\p{Z}\p{L}\p{N}]+"
NONE = np.iinfo(np.int64).max


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merger:
    """The merges of a vocabulary as sorted arrays."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        vocabulary, end = described["model"]["vocab"], described["model"]["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        self.size = len(vocabulary) + 1
        pairs = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        names = byte_names()
        self.inner = np.array([vocabulary[n] for n in names], np.int64)
        self.last = np.array([vocabulary[n + end] for n in names], np.int64)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in described["added_tokens"]))
        self.pieces = regex.compile(PIECES)
        self.memory = Memory(lambda words: [[n] for n in self.word_counts(words)])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def counts(self, raw: bytes, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each pre-token of ``lengths`` bytes (none is empty)."""
        out = np.zeros(len(lengths), np.int64)
        if not len(lengths):
            return out
        ends = np.cumsum(lengths)
        data = np.frombuffer(raw, np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        # rank[i]: of the pair (i, i + 1); none across pre-tokens.
        rank = np.full(len(symbols), NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            if done.any():
                out[owner[starts[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, sizes)
            # Of overlapping places (a pair of equal symbols in a run of them) every second one is merged.
            where = np.flatnonzero(hit)
            run = np.cumsum(np.concatenate([[True], np.diff(where) > 1])) - 1
            first = where[np.flatnonzero(np.concatenate([[True], np.diff(where) > 1]))]
            where = where[(where - first[run]) % 2 == 0]
            symbols[where] = self.made[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            moved = np.cumsum(keep) - 1
            rank[where] = rank[where + 1]  # what follows a merged pair; worked out anew below
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = moved[where]
            changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            inside = changed < len(symbols) - 1
            inside[inside] = owner[changed[inside]] == owner[changed[inside] + 1]
            rank[changed] = NONE
            at = changed[inside]
            rank[at] = self.rank_of(symbols[at], symbols[at + 1])
        return out

    def word_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a word has no white space but may hold special strings."""
        owner, encoded = [], []
        extra = np.zeros(len(words), np.int64)
        for n, word in enumerate(words):
            if word.isascii() and "<|" not in word:
                found = LOWER_PIECES.findall(word.lower())
            else:
                parts = self.special.split(word)
                extra[n] = len(parts) - 1
                found = [piece for part in parts for piece in self.pieces.findall(
                    "".join(c.lower() for c in unicodedata.normalize("NFC", part)))]
            for piece in found:
                owner.append(n)
                encoded.append(piece.encode())
        left = self.counts(b"".join(encoded), np.fromiter(map(len, encoded), np.int64, len(encoded)))
        return extra + np.bincount(np.array(owner, np.int64), weights=left, minlength=len(words)).astype(np.int64)

    def text_counts(self, texts: pa.StringArray) -> np.ndarray:
        lists = pc.ascii_split_whitespace(texts)
        codes = self.memory.codes(lists.flatten())
        offsets = batches.offsets_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return batches.sums(self.memory.pool[self.memory.starts[codes]], offsets)


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One per worker."""
    return Merger(path)


def count(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batches.texts(batch)
        n = merger(vocabulary).text_counts(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return batches.map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text"), counted,
                               "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
