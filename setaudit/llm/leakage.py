"""Evaluation texts leaking into training text (problem 7).

Texts are compared as streams of lower-case words joined by one blank. By the q-gram lemma, a stretch of length L that
repeats a piece of an item with at most k edits shares at least L - q + 1 - k*q character q-grams with it, all of them
within k diagonals (place in the text minus place in the item). So each text's q-grams are looked up in the items'
q-grams, hits are counted per item in overlapping bands of diagonals, bands under the bound are dropped, and the others
are verified by an alignment inside the band. The items are a stated set of queries: they are broadcast in blocks of a
bounded size, and every text passes every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.session import cut, spread

WORD = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15 | 1
BITS = 22


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


def gram_codes(stream: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the q-gram that begins at each place: codes of short grams are put together to those of longer ones."""
    n = len(stream) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, part = np.uint64(BASE), 1, stream.astype(np.uint64)
        code, done, left = None, 0, q
        while left:
            if left & 1:
                code, done = (part, size) if code is None else (code[: len(stream) - done - size + 1] * power + part[done : len(stream) - size + 1], done + size)
            left >>= 1
            if left:
                part = part[: len(part) - size] * power + part[size:]
                power, size = power * power, size * 2
        code = code[:n].copy()
        code ^= code >> np.uint64(29)
        return code * np.uint64(BASE)


def points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Passages:
    """Index of one block of item texts. Only texts of at least `run` words can leak."""

    ids: np.ndarray
    streams: list[np.ndarray]
    shingles: list[set[tuple[str, ...]]]
    shortest: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray


def build(items: list[tuple[int, str]], run: int, q: int) -> Passages:
    ids, streams, shingles, shortest, codes, owner, place = [], [], [], [], [], [], []
    for item_id, text in items:
        w = words(text)
        if len(w) < run:
            continue
        ids.append(item_id)
        streams.append(points(" ".join(w)))
        shingles.append({tuple(w[i : i + run]) for i in range(len(w) - run + 1)})
        shortest.append(min(sum(map(len, w[i : i + run])) + run - 1 for i in range(len(w) - run + 1)))
        c = gram_codes(streams[-1], q)
        codes.append(c)
        owner.append(np.full(len(c), len(ids) - 1))
        place.append(np.arange(len(c)))
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    codes, owner, place = cat(codes, np.uint64), cat(owner, np.int64), cat(place, np.int64)
    order = np.argsort(codes, kind="stable")
    unique, starts = np.unique(codes[order], return_index=True)
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[(unique >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Passages(np.array(ids), streams, shingles, np.array(shortest, np.int64), unique, np.append(starts, len(codes)), owner[order], place[order], bitmap)


def bounds(p: Passages, q: int, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Per item: allowed edits k within its shortest stretch of `run` words, and the q-grams such a stretch must share."""
    k = np.minimum((p.shortest * budget).astype(np.int64), np.maximum(0, (p.shortest - q) // (q + 1)))
    return k, np.maximum(1, p.shortest - q + 1 - k * q)


def hits(stream: np.ndarray, p: Passages, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place in the text, place in the item) of each q-gram that both have."""
    codes = gram_codes(stream, q)
    at = np.flatnonzero(p.bitmap[(codes >> np.uint64(64 - BITS)).astype(np.int64)])
    row = np.searchsorted(p.codes, codes[at])
    ok = row < len(p.codes)
    ok[ok] = p.codes[row[ok]] == codes[at[ok]]
    at, row = at[ok], row[ok]
    many = p.starts[row + 1] - p.starts[row]
    flat = np.repeat(p.starts[row] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(row) else np.zeros(0, np.int64)
    return p.owner[flat], np.repeat(at, many), p.place[flat]


def regions(item: np.ndarray, at: np.ndarray, place: np.ndarray, p: Passages, k: np.ndarray, least: np.ndarray, q: int) -> list[tuple[int, int, int, int, int]]:
    """(item, first and last diagonal, first and last place in the item) of each region that meets the bound.

    Bands are 2(k+1) diagonals wide and begin every k+1, so a stretch whose diagonals differ by at most k lies whole in
    one. A region is where a band has enough q-grams within the length of the shortest stretch; such windows that
    overlap are one region. A place of the item counts once in a band, however often the text repeats its q-gram there.
    """
    found = []
    step = k[item] + 1
    for shift in (0, 1):
        band = (at - place + shift * step) // (2 * step)
        low = band.min()
        n_bands, n_places = int(band.max() - low) + 1, int(place.max()) + 1
        packed = np.sort((item * n_bands + (band - low)) * n_places + place)
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
        name, where = packed // n_places, packed % n_places
        who = name // n_bands
        last = np.arange(len(packed)) + least[who] - 1
        ok = last < len(packed)
        first = np.flatnonzero(ok)
        last = last[ok]
        good = (name[first] == name[last]) & (where[last] - where[first] <= p.shortest[who[first]] - q + k[who[first]])
        open_name, begin, end = -1, 0, 0
        for f, e in zip(first[good].tolist(), last[good].tolist()):
            if name[f] == open_name and where[f] <= end + q:
                end = int(where[e])
                continue
            if open_name >= 0:
                found.append((open_name, shift, begin, end, low, n_bands))
            open_name, begin, end = int(name[f]), int(where[f]), int(where[e])
        if open_name >= 0:
            found.append((open_name, shift, begin, end, low, n_bands))
    out = []
    for n, shift, begin, end, low, n_bands in found:
        w = n // n_bands
        s = int(k[w]) + 1
        d = (n % n_bands + int(low)) * 2 * s - shift * s
        out.append((w, d, d + 2 * s - 1, begin, end + q - 1))
    return out


def band_score(text: np.ndarray, item: np.ndarray, low: int, high: int, begin: int, end: int, enough: int) -> int:
    """Best local alignment score within diagonals low..high of the item's places begin..end: 1 for a match, -1 for a
    mismatch or gap. Ends as soon as the score is `enough`."""
    width = high - low + 1
    best, prev = 0, np.zeros(width + 2, np.int64)
    ramp = np.arange(width)
    for i in range(begin, end + 1):
        left = i + low
        window = text[max(0, left) : max(0, left + width)]
        same = np.full(width, -1, np.int64)
        offset = max(0, -left)
        same[offset : offset + len(window)][window == item[i]] = 1
        score = np.maximum(prev[1:-1] + same, prev[2:] - 1)
        np.maximum(score, 0, out=score)
        # gaps along the row: the running maximum of what a cell to the left leaves after the distance
        score = np.maximum.accumulate(score + ramp) - ramp
        best = max(best, int(score.max()))
        if best >= enough:
            break
        prev[1:-1] = score
    return best


def repeats(joined: str, begin: int, end: int, shingles: set[tuple[str, ...]], run: int) -> bool:
    """Whether the words that the stretch begin..end of a text touches hold one of the runs."""
    begin = joined.rfind(" ", 0, max(0, begin) + 1) + 1
    end = joined.find(" ", min(len(joined), end + 1))
    w = joined[begin : end if end >= 0 else len(joined)].split(" ")
    return any(tuple(w[i : i + run]) in shingles for i in range(len(w) - run + 1))


def leaked(text: str | None, p: Passages, k: np.ndarray, least: np.ndarray, run: int, q: int) -> list[tuple[int, int, bool]]:
    """(item, alignment score, whether a run of `run` words is repeated exactly in an aligned stretch) of each verified item text."""
    joined = " ".join(words(text))
    stream = points(joined)
    item, at, place = hits(stream, p, q)
    if not len(item):
        return []
    enough = np.bincount(item, minlength=len(p.ids)) >= least
    keep = enough[item]
    if not keep.any():
        return []
    found: dict[int, tuple[int, bool]] = {}
    for who, low, high, begin, end in regions(item[keep], at[keep], place[keep], p, k, least, q):
        score, exact = found.get(who, (0, False))
        if score < p.shortest[who] or not exact:
            here = band_score(stream, p.streams[who], low, high, begin, end, int(p.shortest[who]))
            if here >= p.shortest[who] - 2 * k[who]:
                found[who] = max(score, here), exact or repeats(joined, begin + low, end + high, p.shingles[who], run)
    return [(who, s, exact) for who, (s, exact) in found.items()]


def leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", parts: tuple[str, ...] = ("passage", "question"),
    run: int = 12, q: int = 8, budget: float = 0.02, block_chars: int = 4_000_000,
) -> DataFrame:
    """(key, item_id, part, score, exact): each document with each item text of which it repeats a stretch.

    A stretch is `run` successive words of the item text with at most `budget` edits per character; `exact` says whether
    some `run` successive words are repeated without any edit, `score` is the best alignment's, counted up to the length of the
    item's shortest stretch. Case and all that stands
    between words are disregarded. Null, empty and short texts on either side have no rows; a document row that is
    repeated gives repeated rows; whole texts are searched. Item texts are split by hash into blocks of about
    `block_chars` characters; the driver holds and sends one block at a time, and the texts are read once per block.
    """
    spark = documents.sparkSession
    name = F.array(*(F.struct(F.lit(i).alias("part"), F.col(c).alias("text")) for i, c in enumerate(parts)))
    texts = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), F.explode(name).alias("p")).select("item", "p.part", "p.text").where(F.length("text") > 0)
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n_blocks = max(1, -(-total // block_chars))
    texts = cut(texts.withColumn("block", F.pmod(F.xxhash64("item", "part"), F.lit(n_blocks))))
    docs = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0))
    kind = documents.schema[key].dataType.simpleString()
    out = None
    for n in range(n_blocks):
        shared = spark.sparkContext.broadcast([tuple(r) for r in texts.where(F.col("block") == n).select("item", "part", "text").distinct().collect()])

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            p = build([(i, t) for i, (_, _, t) in enumerate(block)], run, q)
            k, least = bounds(p, q, budget)
            for pdf in frames:
                found = []
                if len(p.ids):
                    for doc, t in zip(pdf["key"], pdf["text"]):
                        found += [(doc, block[p.ids[who]][0], parts[block[p.ids[who]][1]], int(s), exact) for who, s, exact in leaked(t, p, k, least, run, q)]
                yield pd.DataFrame(found, columns=["key", "item_id", "part", "score", "exact"])

        part = docs.mapInPandas(search, f"key {kind}, item_id bigint, part string, score bigint, exact boolean")
        out = part if out is None else out.unionAll(part)
    return out.withColumnRenamed("key", key)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that repeat a run of twelve words of an item's passage or question exactly."""
    return leaks(documents, items).where("exact").select("doc_id", "item_id").distinct()
