"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

Every prefix of a word has one encoding, and the last token of that encoding is the state of
the prefix: the encoding of a longer prefix ends in the one token t for which the state of the
prefix before t and t stay apart under the merges. So the distinct words of a batch are put
into a trie, and a depth-first walk propagates the states: what words share as a prefix is
computed once. The trie is walked through the sorted words, the stack of states being the
current path. No row leaves its partition: encoding needs no shuffle.

Defined results: null and empty texts give an empty list; texts of special tokens are ordinary
text; bytes of any Unicode text are covered, so there are no unknown ids.
"""

from __future__ import annotations

import base64
import os
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: How byte-level BPE parts a text into words before merging (fixed value of the public vocabulary).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words a Python worker keeps; beyond it starts anew, which changes no result.
WORDS_KEPT = 300_000


class TrieEncoder:
    """Encodes words by last-token states along a trie of their prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes = {i: t for t, i in ranks.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, list[int]] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a followed by b is what the merges make of their bytes."""
        key = (a, b)
        if key not in self.apart:
            word = self.bytes[a] + self.bytes[b]
            parts = [word[i : i + 1] for i in range(len(word))]
            while True:
                best = min(((self.ranks.get(x + y, sys.maxsize), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(sys.maxsize, 0))
                if best[0] == sys.maxsize:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.apart[key] = parts == [self.bytes[a], self.bytes[b]]
        return self.apart[key]

    def encode_words(self, words: list[str]) -> None:
        """Put the encodings of distinct words into `kept`."""
        ranks, longest, apart = self.ranks, self.longest, self.stay_apart
        previous = b""
        states: list[int] = []  # states[i]: the last token of the prefix of i + 1 bytes
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for x, y in zip(previous, raw):
                if x != y:
                    break
                shared += 1
            del states[shared:]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(raw[start:end])
                    if token is not None and (start == 0 or apart(states[start - 1], token)):
                        states.append(token)
                        break
            previous = raw
            ids, at = [], len(raw)
            while at:
                ids.append(states[at - 1])
                at -= len(self.bytes[states[at - 1]])
            ids.reverse()
            self.kept[word] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty ones give an empty list."""
        import regex

        pattern = regex.compile(WORD_PATTERN)
        parted = [pattern.findall(t) if t else [] for t in texts]
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
            self.apart.clear()
        new = {w for p in parted for w in p} - self.kept.keys()
        if new:
            self.encode_words(list(new))
        kept = self.kept
        return [[i for w in p for i in kept[w]] for p in parted]


def read_ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(name: str, folder: str = TOKENIZER_DIR) -> TrieEncoder:
    """The worker's encoder of a vocabulary; kept between the batches and tasks of one process."""
    held = sys.modules.setdefault("_packetloom_encoders", types.ModuleType("_packetloom_encoders"))
    if (name, folder) not in held.__dict__:
        held.__dict__[(name, folder)] = TrieEncoder(read_ranks(name, folder))
    return held.__dict__[(name, folder)]


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """Token ids of a text column, as array<int>."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name, folder)
        for s in batches:
            yield pd.Series(own.encode(list(s)), index=s.index)

    return run(text)


def token_counts(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name, folder)
        for s in batches:
            yield pd.Series([len(x) for x in own.encode(list(s))], index=s.index, dtype="int64")

    return run(text)


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every document, null and empty ones included."""
    return documents.select("doc_id", token_ids(F.col("text"), name, folder).alias("ids"))
