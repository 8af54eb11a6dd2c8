"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 6).

The merges are this library's own: in each slice of a partition the pieces of text not met before are laid out as one
row of byte symbols, every adjacent pair that has a merge is indexed with all its positions, and the active ranks are
applied in ascending order, each to all positions of its pair from left to right. A merge changes only its two
neighbours, whose new pairs join the index. As both parts of a merge are products of lower ranks, a pair that appears
late always has a higher rank than the one being applied, so one ascending pass is the encoding.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern by which this vocabulary splits a text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_CHARS, KEPT_PIECES, KEPT_LENGTH = 2_000_000, 150_000, 64


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Encoder:
    """Encodes texts of one partition; pieces already encoded are remembered up to a bound."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self.known: dict[str, list[int]] = {}

    @cached_property
    def tables(self) -> tuple[list[int], dict[int, int], list[int]]:
        """Ids of the bytes; rank of each pair (left << 20 | right); id made by each rank."""
        model = json.loads(self.vocabulary)["model"]
        ids = model["vocab"]
        ranks, made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(ids[a] << 20 | ids[b], rank)
            made.append(ids[a + b])
        return [ids[s] for s in byte_signs()], ranks, made

    @cached_property
    def pattern(self) -> regex.Pattern:
        return regex.compile(PIECES)

    def learn(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of each piece."""
        bytes_id, ranks, made = self.tables
        symbols: list[int] = []
        ends: list[int] = []
        for p in pieces:
            symbols += [bytes_id[b] for b in p.encode()]
            symbols.append(-1)
            ends.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            if symbols[i] >= 0 and symbols[i + 1] >= 0:
                rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
                if rank is not None:
                    where.setdefault(rank, []).append(i)
        active = list(where)
        heapq.heapify(active)
        pair_of = self.pair_of
        while active:
            rank = heapq.heappop(active)
            at, (left, right), new = sorted(where.pop(rank)), pair_of[rank], made[rank]
            for i in at:
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:
                    continue
                symbols[i], symbols[j] = new, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbols[k] >= 0 and (r := ranks.get(new << 20 | symbols[k])) is not None:
                        if r not in where:
                            where[r] = []
                            heapq.heappush(active, r)
                        where[r].append(i)
                h = before[i]
                if h >= 0 and symbols[h] >= 0 and (r := ranks.get(symbols[h] << 20 | new)) is not None:
                    if r not in where:
                        where[r] = []
                        heapq.heappush(active, r)
                    where[r].append(h)
        found, begin = {}, 0
        for p, end in zip(pieces, ends):
            found[p] = [s for s in symbols[begin : end - 1] if s >= 0]
            begin = end
        return found

    @cached_property
    def pair_of(self) -> dict[int, tuple[int, int]]:
        return {rank: (key >> 20, key & 0xFFFFF) for key, rank in self.tables[1].items()}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = {p for pieces in split for p in pieces if p not in self.known}
        if len(self.known) + len(fresh) > KEPT_PIECES:
            self.known.clear()
            fresh = {p for pieces in split for p in pieces}
        known, new = self.known, self.learn(sorted(fresh)) if fresh else {}
        out = []
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                ids += known[p] if p in known else new[p]
            out.append(ids)
        if new:
            known.update((p, ids) for p, ids in new.items() if len(p) <= KEPT_LENGTH)
        return out


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Successive ranges of at most SLICE_CHARS characters, or of one longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t or "") > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if texts:
        yield begin, len(texts)


def encode(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, an empty list for a null or empty text; one row per input row.

    No special tokens are made: text that looks like one is encoded as ordinary text. `vocabulary` is a path on the
    driver; the file, of a fixed size, is sent to the executors by broadcast. Texts are shuffled only if they arrive in fewer splits than there are cores. Repeated rows stay
    repeated; null keys are kept; other columns are not read.
    """
    spark = df.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts):
                ids = encoder.encode(texts[begin:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
