"""Encoding texts with a public byte-level BPE vocabulary.

A partition's distinct words are encoded together with a pair occurrence index: every adjacent pair that some rank
merges is mapped to all its positions; active ranks are applied in ascending order (a heap), and each merge updates only
the lists of the neighbouring pairs. Words are kept in a table bounded by `CACHE_WORDS`, which only saves time.

Defined results: null, empty texts give an empty list, blank texts the ids of their blanks; the strings of special
tokens are ordinary text; rows are kept as they are, repeats included.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.tables import spread

#: Fixed value: the published pattern that splits text before the merges; white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_WORDS = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Vocabularies stay where they are installed: CORVANE_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    folder = os.environ.get("CORVANE_TOKENIZERS")
    if not folder:
        try:
            import public_tokenizers

            folder = os.path.dirname(public_tokenizers.__file__)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


class PairIndexEncoder:
    """Encodes many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)]
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.merges: dict[tuple[int, int], int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.pattern = regex.compile(PATTERN)

    def merged(self, a: int, b: int) -> int:
        """The id that a pair merges into, -1 if none."""
        r = self.merges.get((a, b))
        if r is None:
            r = self.merges[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. One occurrence index over all the words; -1 parts them."""
        ids: list[int] = [-1]
        starts = []
        for w in words:
            starts.append(len(ids))
            b = w.encode("utf-8", "surrogatepass")
            ids += [self.byte_id[x] for x in b]
            ids.append(-1)
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        at: dict[int, list[int]] = {}
        merged = self.merged
        for p in range(1, len(ids) - 1):
            a, b = ids[p], ids[p + 1]
            if a >= 0 and b >= 0 and (r := merged(a, b)) >= 0:
                at.setdefault(r, []).append(p)
        active = list(at)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            positions = at.pop(rank, None)
            if not positions:
                continue
            positions.sort()
            for p in positions:
                a = ids[p]
                if a < 0 or (q := after[p]) >= len(ids) or (b := ids[q]) < 0 or merged(a, b) != rank:
                    continue  # the pair went into an earlier merge
                ids[p], ids[q] = rank, -2
                n = after[q]
                after[p] = n
                before[n] = p
                if (left := ids[before[p]]) >= 0 and (r := merged(left, rank)) >= 0:
                    if r not in at:
                        heapq.heappush(active, r)
                    at.setdefault(r, []).append(before[p])
                if (right := ids[n]) >= 0 and (r := merged(rank, right)) >= 0:
                    if r not in at:
                        heapq.heappush(active, r)
                    at.setdefault(r, []).append(p)
        out = []
        for s in starts:
            own, p = [], s
            while ids[p] != -1:
                own.append(ids[p])
                p = after[p]
            out.append(own)
        return out

    def table(self, texts: list[list[str]]) -> dict[str, np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        new = list({w for t in texts for w in t if w not in self.words})
        for w, ids in zip(new, self.encode_words(new)):
            self.words[w] = np.array(ids, np.int32)
        return self.words

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.table(split)
        none = np.zeros(0, np.int32)
        return [np.concatenate([known[w] for w in t]) if t else none for t in split]

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.table(split)
        return [sum([len(known[w]) for w in t]) for t in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, part.column(column).to_pylist()


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): each row's ids. Runs inside the scan's partitions; nothing is shuffled."""
    path = path or vocabulary_path()
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part, texts in _blocks(batches, "text"):
            ids = enc.encode(texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_column, "ids"])

    return spread(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens): 0 for null and empty texts."""
    path = path or vocabulary_path()
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part, texts in _blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(enc.count(texts), pa.int64())], names=[id_column, "n_tokens"])

    return spread(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint")
