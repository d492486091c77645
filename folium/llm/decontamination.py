"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is the set of its runs of SHINGLE words. Items are partitioned by size into classes of twice the size each. For
a class of items of up to s runs, documents are covered by windows of 2 s runs, s apart, so an item that stands in a
document lies in one window of like size, whatever the document's length, and a containment of T means a Jaccard similarity
of at least T / (5 - T) or so between item and window. HASHES least values are kept for items and windows; a window that
has one in common with an item makes the document a candidate for it. Least values of a class come from those of the class
below. Candidates are verified by the exact share of the item's runs, as words, that the document holds.

The items are the query set: they are held by every task in blocks whose index takes at most BLOCK_BYTES, and every block
sees all documents. With several blocks, the matches of one are written to the shared folder and its index is let go before
the next is built, so that driver and workers hold one at a time. Documents are neither moved nor collected.

Words are lower-cased runs of letters and digits (all characters beyond ASCII count as letters). Defined cases: null or
empty text and items without words match nothing; an item of fewer than SHINGLE words is one run of all of them; repeated
items are reported each; an item without an id counts like others and is a null in `items`, after the ids; rows without a
doc_id are searched like others; repeated documents each give a row; without items no document is contaminated, and an empty
table of documents gives none; very long texts and items are taken whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm import hashing as H
from folium.llm.arrow import over, pieces
from folium.session import cut, forget

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
BLOCK_BYTES = 32_000_000
#: What an item takes in the index beside three times its text: HASHES least values of 8 bytes with an item number of 4, and the item itself.
ITEM_BYTES = 300
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FILTER = 1 << 16


def _multipliers(n: int) -> np.ndarray:
    return H.mix(np.arange(1, n + 1, dtype=np.uint64) * H.BASE) | H.U(1)


def exact_runs(text: str, k: int) -> set[bytes]:
    """The runs of k words of a text, as words."""
    words = WORD.findall(text.lower().encode())
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


class Index:
    """Items of one block: for each run length the classes, and for each class and hash the least values."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int = SHINGLE, hashes: int = HASHES) -> None:
        self.a = _multipliers(hashes)
        self.ids, self.texts, self.run = [], [], []
        #: run length -> class size -> per hash (sorted least values, items)
        self.classes: dict[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]] = {}
        grouped: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words, _ = H.words([(text or "").lower().encode()], H.NOT_ALNUM)
            k = min(shingle, len(words))
            if not k:
                continue
            runs = np.unique(H.Sums(words).runs(k))
            size = 1 << max(0, int(len(runs) - 1).bit_length())
            grouped[k][size].append((len(self.ids), (runs[:, None] * self.a).min(axis=0)))
            self.ids.append(item_id)
            self.texts.append(text)
            self.run.append(k)
        for k, sizes in grouped.items():
            self.classes[k] = {}
            for size, found in sizes.items():
                index, least = np.array([i for i, _ in found], np.int32), np.array([m for _, m in found])
                order = np.argsort(least, axis=0)
                seen = np.zeros((hashes, min(FILTER, 1 << (64 * len(found)).bit_length())), bool)
                seen[np.arange(hashes), (least & H.U(seen.shape[1] - 1)).astype(np.int64)] = True
                self.classes[k][size] = [(np.ascontiguousarray(least[order[:, j], j]), index[order[:, j]], seen[j]) for j in range(hashes)]

    def candidates(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text, item) pairs with a least value in common."""
        out: set[tuple[int, int]] = set()
        hashes, starts = H.words([t.lower().encode() for t in texts], H.NOT_ALNUM)
        for k, sizes in self.classes.items():
            ok = H.within(starts, len(hashes), k)
            runs = H.Sums(hashes).runs(k)[ok]
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(ok)][ok]
            if not len(runs):
                continue
            self._level(runs, np.bincount(owner, minlength=len(texts)), sizes, out)
        return out

    def _level(self, runs: np.ndarray, counts: np.ndarray, sizes: dict, out: set[tuple[int, int]]) -> None:
        blocks: list[tuple[int, np.ndarray, np.ndarray]] = []  # (size, block starts in the level below, owner of a block)
        below, size = counts, 1
        for want in sorted(sizes):
            step = want // size
            n = -(-below // step)
            first = np.r_[0, np.cumsum(below)[:-1]]
            owner = np.repeat(np.arange(len(n)), n)
            begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)) * step
            blocks.append((want, begin, owner))
            below, size = n, want
        for j, a in enumerate(self.a):
            least = runs * a
            for want, begin, owner in blocks:
                least = np.minimum.reduceat(least, begin)
                window = least.copy()
                pair = owner[1:] == owner[:-1]
                window[:-1][pair] = np.minimum(least[:-1], least[1:])[pair]
                values, items, seen = sizes[want][j]
                near = np.flatnonzero(seen[(window & H.U(len(seen) - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(values, window[near], "left"), np.searchsorted(values, window[near], "right")
                for i, a, b in zip(owner[near].tolist(), lo.tolist(), hi.tolist()):
                    if a < b:
                        out.update((i, x) for x in items[a:b].tolist())

    def search(self, texts: list[str], threshold: float) -> list[list[tuple[int, float]]]:
        """For every text the (item id, containment) pairs that reach the threshold."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        by_text: dict[int, list[int]] = defaultdict(list)
        for t, i in self.candidates(texts):
            by_text[t].append(i)
        for t, found in by_text.items():
            held: dict[int, set[bytes]] = {}
            for i in sorted(found):
                k = self.run[i]
                if k not in held:
                    held[k] = exact_runs(texts[t], k)
                own = exact_runs(self.texts[i], k)
                share = len(own & held[k]) / len(own)
                if share >= threshold:
                    out[t].append((self.ids[i], share))
        return out


def _blocks(benchmark: DataFrame, hashes: int, block_bytes: int) -> Iterator[tuple[int, list[tuple[int | None, str]]]]:
    """The number of blocks and the items of one after another, each of about block_bytes of index."""
    total, rows = benchmark.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = -(-(3 * (total or 0) + rows * (ITEM_BYTES + 12 * hashes)) // block_bytes) or 1
    for b in range(n):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield n, [(r.item_id, r.text) for r in own.orderBy("item_id", "text").select("item_id", "text").collect()]


def _matches(docs: DataFrame, held: Broadcast, id_col: str, text_col: str, threshold: float, every: bool) -> DataFrame:
    """doc_id, mark (tells texts apart), items, containment of the rows that hold an item, or of every row, then without marks."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.string()), ("items", pa.list_(pa.int64())), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts, out = [t or "" for t in piece.column("text").to_pylist()], []
            for i, t, found in zip(piece.column("doc_id").to_pylist(), texts, held.value.search(texts, threshold)):
                if found or every:
                    out.append((i, None if every else hashlib.md5(t.encode()).hexdigest(), [x for x, _ in found], max((c for _, c in found), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return over(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, mark string, items array<long>, containment double")


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, hashes: int = HASHES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids ascending, nulls last) and containment (of the best) for every row."""
    out, parts = None, []
    for n, items in _blocks(benchmark, hashes, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Index(items, shingle, hashes))  # block_bytes or so
        some = _matches(docs, held, id_col, text_col, threshold, n == 1)
        if n == 1:
            out = some
        else:
            parts.append(cut(some).dropDuplicates(["doc_id", "mark"]))
            held.destroy()
    if out is None:
        found = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("items")).alias("items"), F.max("containment").alias("containment"))
        found = found.withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
        out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left")
    found = F.coalesce("items", F.array().cast("array<long>"))
    return out.select("doc_id", (F.size(found) > 0).alias("contaminated"), F.size(found).cast("long").alias("n_items"), F.array_sort(found).alias("items"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no item; a block of items after another, and what is left between two lies in the shared folder."""
    out, found = docs, None
    for n, items in _blocks(benchmark, HASHES, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches, held=held):
            for piece in pieces(batches, text_col):
                clean = [not f for f in held.value.search([t or "" for t in piece.column(text_col).to_pylist()], threshold)]
                yield piece.filter(pa.array(clean, pa.bool_()))

        out = over(out, run, docs.schema)
        if n > 1:
            was, out = found, cut(out)
            held.destroy()
            if was is not None:
                forget(was)
            found = out
    return out
