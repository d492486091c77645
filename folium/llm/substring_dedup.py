"""Substring dedup on words, with anchors at difference-cover positions.

A window is `WINDOW` words. Anchors are runs of WINDOW - PERIOD + 1 words that start at a position whose remainder by
PERIOD is in COVER, a difference cover: for any two positions some shift below PERIOD moves both onto the cover, so two
equal windows share an anchor, equal in hash, at the same place inside both. Step one finds the anchors that two documents
share. Step two extends them: only windows that contain such an anchor are hashed, and the least document of each window's
words is found. Step three removes, in every document, the words of windows that start in a smaller one.

Windows are compared by 96 bits of hash over their words.

Defined cases: null text = empty, no words; fewer than WINDOW words are never removed; rows with equal doc_id do not count
as smaller than one another; rows whose doc_id is null come before all others and count as one id, which the least long is
too; repeated rows each give a row; very long texts are taken whole, in a bundle of their own size; an empty table gives no
rows; other columns are ignored. Bytes that are not white space are part of words, whatever their encoding.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folium.llm import bundles as B
from folium.llm import hashing as H

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
LEAST = -(1 << 63)


def _ids(ids: list[int | None], starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.array([LEAST if i is None else i for i in ids], np.int64), np.diff(starts))


def _anchors(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors over a slice's words, and their hashes."""
    runs = H.Sums(hashes).runs(ANCHOR)
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))
    ok = H.within(starts, len(hashes), ANCHOR) & np.isin(place[: len(runs)] % PERIOD, COVER)
    at = np.flatnonzero(ok)
    return at, runs[at]


def _windows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = H.Sums(hashes).runs(WINDOW)
    two = H.Sums(hashes ^ H.U(0xA5A5A5A5A5A5A5A5)).runs(WINDOW)
    return one, (two >> H.U(32)).astype(np.uint32)


def _send_anchors(parts: int):
    def work(table: pa.Table) -> pa.Table:
        keys, owners = [], []
        for ids, texts in B.sliced(*B.rows(table)):
            hashes, starts = H.words(texts, H.WHITE)
            at, found = _anchors(hashes, starts)
            keys.append(found)
            owners.append(_ids(ids, starts)[at])
        k, _, many = B.distinct_many(np.concatenate(keys), np.concatenate(owners))
        return B.to_parts(B.first(table.column("bundle")), k, parts, lambda g: B.pack(k[g], many[g]))

    return work


def _send_windows(parts: int):
    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        shared = np.sort(np.concatenate([np.empty(0, np.uint64), *(B.unpack(p, "<u8")[0] for p in B.payloads(told))]))
        one, two, owners = [], [], []
        if len(table) and len(shared):
            for ids, texts in B.sliced(*B.rows(table)):
                hashes, starts = H.words(texts, H.WHITE)
                at, found = _anchors(hashes, starts)
                at = at[B.member(found, shared)[0]]
                if not len(at):
                    continue
                near = np.zeros(len(hashes), bool)
                for back in range(PERIOD):
                    near[np.maximum(at - back, 0)] = True
                a, b = _windows(hashes)
                ok = np.flatnonzero(near[: len(a)] & H.within(starts, len(hashes), WINDOW))
                one.append(a[ok])
                two.append(b[ok])
                owners.append(_ids(ids, starts)[ok])
        if not one:
            return pa.Table.from_pydict({"part": [], "bundle": [], "payload": []}, schema=B.SEND_ARROW)
        one, two, owners = np.concatenate(one), np.concatenate(two), np.concatenate(owners)
        order = np.lexsort((owners, two, one))
        one, two, owners = one[order], two[order], owners[order]
        begin = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        end = np.r_[begin[1:], len(one)] - 1
        one, two, low, many = one[begin], two[begin], owners[begin], (owners[begin] != owners[end]).astype(np.uint8)
        return B.to_parts(B.first(table.column("bundle")), one, parts, lambda g: B.pack(one[g], low[g], two[g], many[g]))

    return work


def _least_owner(table: pa.Table) -> pa.Table:
    bundles, data = table.column("bundle").to_pylist(), table.column("payload").to_pylist()
    got = [B.unpack(p, "<u8", "<i8", "<u4", "u1") for p in data]
    one, low, two, many = (np.concatenate([g[i] for g in got]) for i in range(4))
    order = np.lexsort((low, two, one))
    begin = np.flatnonzero(np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    least = np.empty_like(low)
    least[order] = np.repeat(low[order][begin], np.diff(np.r_[begin, len(order)]))
    clash = len(begin) > len(np.unique(one))  # equal in 64 bits, different in 96
    out, at = [], 0
    for b, g in zip(bundles, got):
        own = least[at : at + len(g[0])]
        gone = np.flatnonzero((own < g[1]) & (g[3] == 0))  # one document of the bundle has it, and a smaller one elsewhere
        some = np.flatnonzero(g[3] > 0)
        if len(gone) + len(some):
            out.append((b, bytes([clash]) + len(gone).to_bytes(8, "little") + B.pack(g[0][gone], *([g[2][gone]] if clash else [])) + B.pack(g[0][some], own[some], g[2][some])))
        at += len(g[0])
    return B.answers(out)


def _told(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, the least document of each, their other 32 bits, whether these are to be compared, and whether the window goes whosever it is."""
    clash, n = payload[0], int.from_bytes(payload[1:9], "little")
    at = 9 + n * (12 if clash else 8)
    gone = B.unpack(payload[9:at], *(("<u8", "<u4") if clash else ("<u8",)))
    one, least, two = B.unpack(payload[at:], "<u8", "<i8", "<u4")
    first = gone[1] if clash else np.zeros(n, np.uint32)
    return np.r_[gone[0], one], np.r_[np.full(n, LEAST), least], np.r_[first, two], np.r_[np.full(n, bool(clash)), np.ones(len(one), bool)], np.r_[np.ones(n, bool), np.zeros(len(one), bool)]


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _remove(digest: bool):
    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        if not len(table):
            return pa.Table.from_pydict(out, schema=OUT)
        got = [_told(p) for p in B.payloads(told)]
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, bool), np.empty(0, bool))
        one, low, two, strict, sure = (np.concatenate([e, *(g[i] for g in got)]) for i, e in enumerate(empty))
        order = np.argsort(one, kind="stable")
        one, low, two, strict, sure = one[order], low[order], two[order], strict[order], sure[order]
        for ids, texts in B.sliced(*B.rows(table)):
            hashes, starts = H.words(texts, H.WHITE)
            gone = np.zeros(len(hashes), bool)
            if len(one) and len(hashes) >= WINDOW:
                a, b = _windows(hashes)
                hit, at = B.member(a, one)
                owner = _ids(ids, starts)[: len(a)]
                hit &= ((two[at] == b) | ~strict[at]) & ((low[at] < owner) | sure[at]) & H.within(starts, len(hashes), WINDOW)
                gone = H.covered(np.flatnonzero(hit), len(hashes), WINDOW)
            keep = (~gone).tolist()
            for i, text in enumerate(texts):
                words = text.split()
                flags = keep[starts[i] : starts[i + 1]]
                kept = b" ".join(compress(words, flags))
                out["doc_id"].append(ids[i])
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - sum(flags))
                out["kept"].append(hashlib.sha256(kept).hexdigest().encode() if digest else kept)
        return pa.Table.from_pydict(out, schema=OUT)

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (UTF-8, joined by a space), or the hex SHA-256 of these as bytes."""
    texts, parts = B.bundled(docs, id_col, text_col)
    shared = B.shared_keys(texts.groupBy("bundle").applyInArrow(_send_anchors(parts), B.SEND), parts)
    sent = texts.groupBy("bundle").cogroup(shared.groupBy("bundle")).applyInArrow(_send_windows(parts), B.SEND)
    told = B.by_part(sent, parts).applyInArrow(_least_owner, B.ANSWER)
    return texts.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(_remove(digest), "doc_id long, n_words long, n_removed long, kept binary")
