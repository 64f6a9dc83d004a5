"""Problem 7: encode a corpus with a public byte-level BPE vocabulary.

Method: prefix-sharing trie traversal.  The distinct words of an Arrow batch go
into a byte trie; a depth-first walk gives each node the *last token* of the
encoding of its prefix, so a prefix shared by many words is encoded once.  The
last-token state is enough, because the encoding of a prefix is the encoding of
what its last token leaves over plus that token, and exactly one token that ends
at a node is compatible with the last token of the node where it starts.

No shuffle: a batch is encoded where it is read; words seen before come from a
bounded per-worker table.

Results: null text and empty text give the empty list; blank or odd text is
encoded as it stands; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.sources.tables import in_batches

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-tokenizer of the public byte_bpe_50k vocabulary, with white space spelled out.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same pattern where every character is ASCII; the standard module is several times as fast.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Words kept per worker; beyond it the table starts anew (memory bound, no effect on results).
MAX_WORDS = 400_000
#: Characters of text held as Python words at a time.
SLICE_CHARS = 2_000_000


def split_words(text: str) -> list[str]:
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)


class TrieEncoder:
    """Encodes words of a byte-level BPE whose ids are merge ranks."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.rank = {base64.b64decode(word): int(n) for word, n in pairs}
        self.bytes_of = {n: word for word, n in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._valid: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self.words: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        data = self.bytes_of[token]
        if len(data) == 1:
            return None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            ranks = [self.rank.get(x + y, 1 << 60) for x, y in zip(parts, parts[1:], strict=False)]
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The pieces that stand at one edge of a token while it is merged: bytes, rank that makes it, rank that uses it up."""
        known = self._edges[side].get(token)
        if known is None:
            known, used = [], 1 << 60
            piece = token
            while True:
                halves = self._halves(piece)
                known.append((self.bytes_of[piece], -1 if halves is None else piece, used))
                if halves is None:
                    break
                used, piece = piece, halves[side]
            self._edges[side][token] = known
        return known

    def _fits(self, before: int, after: int) -> bool:
        """Whether merging keeps the two tokens apart: no pair of edge pieces that stand side by side merges before one of them is used up."""
        known = self._valid.get((before, after))
        if known is None:
            known, rank = True, self.rank
            for a, made_a, used_a in self._edge(before, 1):
                for b, made_b, used_b in self._edge(after, 0):
                    if made_a < used_b and made_b < used_a:
                        r = rank.get(a + b)
                        if r is not None and r < used_a and r <= used_b:
                            known = False
                            break
                if not known:
                    break
            self._valid[before, after] = known
        return known

    def add(self, words: Iterable[str]) -> None:
        """Encode new words by one depth-first walk over their trie.

        The trie is kept as its words in byte order, which is its depth-first order:
        a node is a prefix, and two neighbours share the nodes of their common
        prefix, whose states are on the stack and aren't computed again.
        """
        rank, fits, longest, bytes_of = self.rank, self._fits, self.longest, self.bytes_of
        last = [-1]  # last[d]: last token of the encoding of the first d bytes of the present path
        before = b""
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            most = min(len(before), len(data))
            shared = most if data[:most] == before[:most] else next(i for i in range(most) if data[i] != before[i])
            del last[shared + 1 :]
            for n in range(shared + 1, len(data) + 1):
                for size in range(min(n, longest), 0, -1):
                    token = rank.get(data[n - size : n])
                    if token is not None and (size == n or fits(last[n - size], token)):
                        break
                last.append(token)
            out, at = [], len(data)
            while at:
                out.append(last[at])
                at -= len(bytes_of[last[at]])
            self.words[word] = tuple(reversed(out))
            before = data

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, and the number of tokens of each."""
        counts = np.zeros(len(texts), np.int64)
        pieces: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, chars, words, each = at, 0, [], []
            while to < len(texts) and (to == at or chars < SLICE_CHARS):
                own = split_words(texts[to]) if texts[to] else []
                words += own
                each.append(len(own))
                chars += len(texts[to] or "")
                to += 1
            if len(self.words) > MAX_WORDS:
                self.words.clear()
            new = set(words).difference(self.words)
            if new:
                self.add(new)
            found = [*map(self.words.__getitem__, words)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *each])]
            counts[at:to] = np.diff(ends)
            pieces.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
            at = to
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.int32)), counts


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> TrieEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary at {path}")
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row (key, ids) per input row; see the module's notes for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, counts = enc.encode_texts(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, ids])

    return in_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{ids}` array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", n: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's text; the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts = enc.encode_texts(batch.column(len(keep)).to_pylist())[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts)], names=[*keep, n])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return in_batches(df.select(*keep, text), run, f"{schema}, `{n}` bigint")
