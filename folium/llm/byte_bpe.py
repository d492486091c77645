"""Byte-level BPE in matrices.

Distinct pieces of text are put, by length, into padded matrices of token numbers, a row for each. A round finds every
row's leftmost pair of least rank, merges it and shifts the rest of the row left by one; rows without a pair leave the
matrix, which is compacted. Ranks of pairs come from an open-addressing hash table in numpy arrays. Pieces longer than
`LONG` bytes, for which a round for each merge would cost the square of their length, go through a heap of pairs instead,
with the same order of merges.

Pieces already seen are kept in a table of bounded size for each Python worker.

Defined cases: null text = empty, no tokens, hashes of the empty string; repeated rows each give a row; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.arrow import mapped, over

LONG = 96
TABLE_PIECES = 400_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of a merged pair of token numbers, NONE where the pair makes no token; open addressing, keys a << 32 | b."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(k)
        while len(k):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = k[free]  # of those that want the same slot, the last gets it
            won = self.keys[slot] == k
            self.values[slot[won]] = v[won]
            k, v, slot = k[~won], v[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self._slot(k)
        held = self.keys[slot]
        out = np.where(held == k, self.values[slot], NONE)
        todo = np.flatnonzero((held != k) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == k[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, table_pieces: int = TABLE_PIECES) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.table: dict[str, str] = {}
        self.table_pieces = table_pieces

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token numbers of each piece (none empty)."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self._heap(p)
            else:
                buckets.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, rows in buckets.items():
            for at in range(0, len(rows), 20_000):
                self._matrix(pieces, rows[at : at + 20_000], width, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list[list[int]]) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        n = np.array([len(pieces[i]) for i in rows])
        m = self.single[raw]
        row = np.array(rows)
        inside = np.arange(width - 1) < (n - 1)[:, None]
        r = np.where(inside, self.pairs(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(rows), width - 1), NONE)
        while True:
            at = r.argmin(axis=1) if r.shape[1] else np.zeros(len(row), np.int64)
            least = r[np.arange(len(row)), at] if r.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            if done.any():
                for i, ids, k in zip(row[done].tolist(), m[done].tolist(), n[done].tolist()):
                    out[i] = ids[:k]
                keep = ~done
                row, m, r, n, at, least = row[keep], m[keep], r[keep], n[keep], at[keep], least[keep]
            if not len(row):
                return
            w = m.shape[1] - 1
            cols = np.arange(w)
            m = np.where(cols <= at[:, None], m[:, :-1], m[:, 1:])
            line = np.arange(len(row))
            m[line, at] = least
            n = n - 1
            if w == 1:
                r = np.empty((len(row), 0), np.int32)
                continue
            r = np.where(cols[:-1] < at[:, None], r[:, :-1], r[:, 1:])
            right = at < n - 1
            r[line[right], at[right]] = self.pairs(m[line[right], at[right]], m[line[right], at[right] + 1])
            left = at > 0
            r[line[left], at[left] - 1] = self.pairs(m[line[left], at[left] - 1], m[line[left], at[left]])

    def _heap(self, piece: bytes) -> list[int]:
        """Leftmost least pair first, over a linked list."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        get = lambda a, b: self.ranks.get(self.token[ids[a]] + self.token[ids[b]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (q := get(x, y)) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Adds pieces to the table, whose values are token numbers as decimals with commas."""
        if len(self.table) + len(pieces) > self.table_pieces:
            self.table.clear()
        new = list(pieces)
        self.table.update(zip(new, (",".join(map(str, ids)) for ids in self.encode_pieces([p.encode() for p in new]))))

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Token numbers of every text, as decimals with commas; a piece is looked up once."""
        found = [self.pattern.findall(t) for t in texts]
        shown = [list(map(self.table.get, got)) for got in found]
        missing = {p for got, ids in zip(found, shown) if None in ids for p, x in zip(got, ids) if x is None}
        if missing:
            self.learn(missing)
            for i, ids in enumerate(shown):
                if None in ids:
                    shown[i] = [x or self.table[p] for p, x in zip(found[i], ids)]
        return [",".join(ids) for ids in shown]

    def encode(self, text: str) -> list[int]:
        return numbers(self.encode_batch([text])[0]).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean"


def numbers(shown: str) -> np.ndarray:
    return np.fromstring(shown, np.int32, sep=",") if shown else np.empty(0, np.int32)


def _mapped(work, schema: pa.Schema, path: str, pattern: str):
    """mapped(), and the table of pieces let go when a task ends, so that no worker holds it through later stages."""

    def run(batches):
        yield from mapped(work, schema)(batches)
        load(path, pattern).table.clear()

    return run


def _encoded(batch: pa.RecordBatch, path: str, pattern: str) -> tuple[Encoder, list[str], list[str]]:
    encoder = load(path, pattern)
    texts = [t or "" for t in batch.column("text").to_pylist()]
    return encoder, texts, encoder.encode_batch(texts)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (the token numbers of every whole text) and the SHA-256 of the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def work(batch: pa.RecordBatch) -> dict:
        encoder, _, shown = _encoded(batch, path, pattern)
        ids = [numbers(x) for x in shown]
        return {"doc_id": batch.column(0), "n_tokens": [len(x) for x in ids], "ids": ids, "decoded_sha256": [hashlib.sha256(encoder.decode(x.tolist())).hexdigest() for x in ids]}

    return over(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _mapped(work, schema, path, pattern), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every whole text's token numbers and of the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("same", pa.bool_())])

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "same": []}
        encoder, texts, shown = _encoded(batch, path, pattern)
        for text, ids in zip(texts, shown):
            held = numbers(ids).tolist()
            raw = encoder.decode(held)
            out["n_tokens"].append(len(held))
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["same"].append(raw == text.encode())
        return {"doc_id": batch.column(0)} | out

    return over(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _mapped(work, schema, path, pattern), SCHEMA)
