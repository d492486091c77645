"""Documents in bundles, and look-ups between bundles and parts.

A bundle holds the documents whose id and text hash to it, a few megabytes of text; ids that many rows share are spread. Texts move to their bundles in one exchange,
which all steps of a query share. A step looks at a whole bundle and sends what others must know of it to parts: a part
holds the entries whose key hashes to it. An entry is sent once for each bundle, however many of its documents have it, so
a passage that very many documents share costs a part one entry for each bundle and no more. A part answers each bundle
separately. Numbers of bundles and parts grow with the bytes of text, up to BUNDLES bundles, which then grow themselves, so
that a key of all bundles stays a few megabytes for its part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from folium.session import parallelism

BUNDLE_BYTES = 4_000_000
#: Bundles at most while they are below LARGEST bytes each.
BUNDLES, LARGEST = 1 << 18, 64_000_000
PART_BYTES = 8_000_000
#: Bundles or parts that a task takes at most, on average.
A_TASK = 8
SEND = "part long, bundle long, payload binary"
ANSWER = "bundle long, payload binary"
SEND_ARROW = pa.schema([("part", pa.int64()), ("bundle", pa.int64()), ("payload", pa.binary())])
ANSWER_ARROW = pa.schema([("bundle", pa.int64()), ("payload", pa.binary())])


def bundled(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> tuple[DataFrame, int]:
    """(bundle, doc_id, text) dealt by bundle, and the number of parts. carry: with `rest`, all columns of a row but its text."""
    n = parallelism(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = min(LARGEST, max(BUNDLE_BYTES, total // BUNDLES))
    bundles, parts = max(4 * n, total // size), max(n, total // PART_BYTES)
    n = max(n, bundles * size // BUNDLE_BYTES // A_TASK)
    out = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(bundles)).alias("bundle"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        *([F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("rest")] if carry else []),
    )
    return out.repartition(n, "bundle"), parts


def in_order(table: pa.Table) -> list[int]:
    """The rows of a bundle by id, then text."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))


def rows(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a bundle, by id."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    order = in_order(table)
    return [ids[i] for i in order], [texts[i] for i in order]


def sliced(ids: list[int], texts: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[list[int], list[bytes]]]:
    """The same in slices of about `limit` bytes."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield ids[start:i], texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(ids):
        yield ids[start:], texts[start:]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, one after the other."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    n = len(payload) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(payload, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def to_parts(bundle: int, keys: np.ndarray, parts: int, make: Callable[[np.ndarray], bytes]) -> pa.Table:
    """A row for each part that has keys: make gives the payload of the chosen indices."""
    where = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    groups = np.split(order, cuts) if len(order) else []
    return pa.Table.from_pydict({"part": [int(where[g[0]]) for g in groups], "bundle": [bundle] * len(groups), "payload": [make(g) for g in groups]}, schema=SEND_ARROW)


def answers(found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_pydict({"bundle": [b for b, _ in found], "payload": [p for _, p in found]}, schema=ANSWER_ARROW)


def first(column: pa.ChunkedArray) -> int:
    return column[0].as_py()


def payloads(table: pa.Table) -> list[bytes]:
    return [x for x in table.column("payload").to_pylist() if x is not None]


def by_part(sent: DataFrame, parts: int) -> GroupedData:
    """sent, grouped by part, over as many tasks as the parts need."""
    n = parts // A_TASK
    return (sent.repartition(n, "part") if n > parallelism(sent.sparkSession) else sent).groupBy("part")


def shared_keys(sent: DataFrame, parts: int) -> DataFrame:
    """Of sent (key uint64, many uint8) entries: for each bundle the keys that another bundle has too, or that it has many times."""

    def work(table: pa.Table) -> pa.Table:
        bundles, data = table.column("bundle").to_pylist(), table.column("payload").to_pylist()
        got = [unpack(p, "<u8", "u1") for p in data]
        keys, many = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[fresh, len(ordered)])
        hit = (counts > 1) | (np.maximum.reduceat(many[order], fresh) > 0)
        shared = np.empty(len(keys), bool)
        shared[order] = np.repeat(hit, counts)
        out, at = [], 0
        for b, g in zip(bundles, got):
            mine = g[0][shared[at : at + len(g[0])]]
            at += len(g[0])
            if len(mine):
                out.append((b, pack(mine)))
        return answers(out)

    return by_part(sent, parts).applyInArrow(work, ANSWER)


def member(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among keys (sorted), and where."""
    if not len(keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at


def distinct_many(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least owner of each, and whether a key has different owners; owners must ascend."""
    if not len(keys):
        return keys, owner, np.empty(0, np.uint8)
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owner[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    end = np.r_[begin[1:], len(k)] - 1
    return k[begin], o[begin], (o[begin] != o[end]).astype(np.uint8)
