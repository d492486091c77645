"""MinHash near-dedup with darts.

A document is a weighted set of runs of `SHINGLE` words, the weight of a run being how often it occurs. Over each element
lies a strip as wide as its weight; hashed darts fall on it, one for every unit of area on average, at ranks that depend on
the element and the unit of weight alone. A document sees the darts on its own strips up to a rank at which it expects
K (ln K + 4) of them, each dart belongs to one of K coordinates by its hash, and the dart of least rank in every coordinate
is kept. Two documents agree in a coordinate with a probability equal to their weighted Jaccard similarity. The work is in
proportion to elements + K ln K, not their product.

Bands of `DEEP` coordinates give keys; documents with a key in common are candidates. Equal texts are one node from the
start. Within a key's bucket not all pairs are made: a pivot, the row that meets most others in all its buckets, is compared
with the others, exactly, by their weighted sets.
Jaccard distance is a metric, so with links up to distance 1 - T the bucket then falls into two that need no comparison
with each other but for the rows in both: those nearer to the pivot than 2 (1 - T), and those farther than 1 - T. The
pivot leaves; a bucket whose rows are already in one class is finished. Further rounds take sixteen times as many pivots each, from
the rows outside the bucket's largest class, until none is left. Between rounds the weight is found that a row shares with no other row still in a bucket; it bounds what the
row's similarity to any of them can be. So every pair of candidates is compared, connected, or ruled out by distance or weight.

The nodes are the different texts, numbered in a written table; ids come in only at the end, so rows without an id and rows
that share one are compared by their texts like others. Where a bucket, a pivot or a class has very many rows, look-ups by it
are split over tasks (`_look_up`).

Defined cases: null text: a class of its own; equal texts are one class, also without words; fewer than SHINGLE words: one
run of all of them; repeated rows are in one class; a class is named by its least doc_id, null if none of its rows has one;
rows that share a doc_id but not the text may be in different classes; an empty table gives no rows; very long texts are taken
whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm import hashing as H
from folium.llm.arrow import mapped, over
from folium.operators.graph import connected_components
from folium.session import cut, forget

SHINGLE = 5
THRESHOLD = 0.8
BANDS, DEEP = 24, 5
#: Rows that may be broadcast, of 60 bytes at most each.
BROADCAST_IDS = 500_000
#: Rows of one value from which on a look-up by it may be split, and values at most for which that is so.
SPLIT, HOT = 500, 5000
STEP = H.U(0xD1B54A32D192ED03)


def elements(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, cell): a cell for every unit of weight of every run of words, in order of hash; owner is the text's index."""
    hashes, starts = H.words([t.lower().encode() for t in texts], H.NOT_ALNUM)
    runs = H.Sums(hashes).runs(shingle)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    ok = H.within(starts, len(hashes), shingle)
    runs, who = runs[ok], owner[: len(ok)][ok]
    few = np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < shingle))
    if len(few):
        runs = np.concatenate([runs, H.Sums(hashes).of(starts[few], starts[few + 1])])
        who = np.concatenate([who, few])
    order = np.lexsort((who, runs))
    runs, who = runs[order], who[order]
    fresh = np.r_[True, (runs[1:] != runs[:-1]) | (who[1:] != who[:-1])][: len(runs)]
    begin = np.flatnonzero(fresh)
    unit = np.arange(len(runs)) - np.repeat(begin, np.diff(np.r_[begin, len(runs)]))
    return who, H.mix(runs + unit.astype(np.uint64) * STEP)


def darts(owner: np.ndarray, cells: np.ndarray, n: int, k: int, limit: np.ndarray | None = None) -> np.ndarray:
    """n rows of k kept darts, 0 in the rows of owners without cells. limit: width of each cell, 1 unless given."""
    weight = np.bincount(owner, limit, minlength=n) if len(owner) else np.zeros(n)
    out = np.zeros((n, k), np.uint64)
    todo = weight > 0
    reach = np.divide(k * (math.log(k) + 4), weight, out=np.zeros(n), where=todo)
    while todo.any():
        use = np.flatnonzero(todo[owner])
        cell, who = cells[use], owner[use]
        width = None if limit is None else limit[use]
        rank, seed = np.zeros(len(use)), cell
        ids, ranks, whose = [], [], []
        while len(cell):
            seed = H.mix(seed + STEP)
            rank = rank - np.log(((seed >> H.U(11)).astype(np.float64) + 0.5) / float(1 << 53))
            live = rank <= reach[who]
            cell, who, seed, rank = cell[live], who[live], seed[live], rank[live]
            hit = np.ones(len(cell), bool)
            if width is not None:
                width = width[live]
                hit = (H.mix(seed ^ H.BASE) >> H.U(11)).astype(np.float64) / float(1 << 53) < width
            ids.append(H.mix(seed ^ STEP)[hit])
            ranks.append(rank[hit])
            whose.append(who[hit])
        ids, ranks, whose = np.concatenate(ids), np.concatenate(ranks), np.concatenate(whose)
        slot = whose * k + (ids % H.U(k)).astype(np.int64)
        late = np.argsort(-ranks, kind="stable")
        flat = np.zeros(n * k, np.uint64)
        flat[slot[late]] = ids[late] | H.U(1)  # the last put is the earliest dart
        got = flat.reshape(n, k)
        out[todo] = got[todo]
        todo = todo & (got == 0).any(axis=1)
        reach = np.where(todo, 2 * reach, reach)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for every band of every signature, different for different bands."""
    key = np.broadcast_to(H.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for r in range(rows):
        key = H.mix(key * H.BASE + signature[:, r::rows][:, :bands])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key (equal for equal texts, null for null), n (weight), keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def work(batch: pa.RecordBatch) -> dict:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        owner, cells = elements([t or "" for t in texts], shingle)
        keys = band_keys(darts(owner, cells, len(texts), bands * rows), bands, rows).tolist()
        n = np.bincount(owner, minlength=len(texts)).tolist() if len(owner) else [0] * len(texts)
        names = [None if t is None else hashlib.md5(t.encode()).digest() for t in texts]
        return {"doc_id": ids, "text_key": names, "n": n, "keys": [k if m else [] for k, m in zip(keys, n)]}

    return over(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), mapped(work, schema), "doc_id long, text_key binary, n int, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, cells) of the nodes (id, text_key, doc_id), one for each row of documents with that id and text."""
    schema = pa.schema([("id", pa.int64()), ("cells", pa.list_(pa.int64()))])

    def work(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        owner, cells = elements(texts, shingle)
        order = np.argsort(owner, kind="stable")
        parts = np.split(cells[order].view(np.int64), np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if len(owner) else [[]] * len(texts)
        return {"id": batch.column("id"), "cells": [np.unique(p) for p in parts]}

    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    texts = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).withColumn("row_key", F.unhex(F.md5("text")))
    some = texts.join(nodes, (F.col("row_key") == F.col("text_key")) & F.col("row_id").eqNullSafe(F.col("doc_id"))).select("id", "text")
    return over(some, mapped(work, schema), "id long, cells array<long>")


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def _look_up(rows: DataFrame, table: DataFrame, key: str, by: str, counts: DataFrame, total: int) -> DataFrame:
    """rows joined with table by key.

    Values that very many rows have are dealt to several tasks by hashes of `by`, with a copy of the value's own rows of
    table in each. counts (key, size) tells which values these are, total how many rows there are; at most HOT can be, so
    the list of them is broadcast.
    """
    limit = max(SPLIT, total // HOT)
    hot = F.broadcast(counts.where(F.col("size") > limit).select(key, F.ceil(F.col("size") / limit).cast("int").alias("parts__")))
    parts = F.coalesce("parts__", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("salt__", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts__")
    copies = table.join(hot, key, "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts__")
    return dealt.join(copies, [key, "salt__"]).drop("salt__")


def _meet(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of buckets (key, id, size) joined with table (key, of) by bucket, of which one with very many rows is dealt to several tasks."""
    parts = F.ceil(F.col("size") / SPLIT).cast("int")
    dealt = rows.withColumn("salt__", F.pmod(F.xxhash64("id"), parts).cast("int"))
    copies = table.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.ceil(F.col("of") / SPLIT).cast("int") - 1))).drop("of")
    return dealt.join(copies, ["key", "salt__"]).drop("salt__")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ca, cb), each once, with j, the weighted Jaccard similarity. Both sets of a pair move to the task of the pair, so a pivot of many pairs is no hot key."""
    pairs = cut(pairs)
    near = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
    left = sets.withColumnRenamed("id", "a").join(near, "a").select("a", "b", "ca", "cb", F.col("cells").alias("x"))
    right = sets.withColumnRenamed("id", "b").join(near, "b").select("a", "b", F.col("cells").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    out = cut(left.join(right, ["a", "b"]).select("a", "b", "ca", "cb", (same / (F.size("x") + F.size("y") - same)).alias("j")))
    forget(pairs)
    return out


ROW = ["key", "id", "n", "match", "comp"]


def _unsettled(rows: DataFrame) -> DataFrame:
    """Of rows (a written table, deleted here) those of buckets with rows of different classes; of buckets with the same rows one.

    Adds the size of the bucket, the sorted keys of every row's buckets and how many rows it meets in them.
    """
    buckets = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("mix")).where("lo <> hi")
    chosen = cut(buckets.groupBy("size", "mix").agg(F.min("key").alias("key")).select("key", "size"))
    crowded = cut(_look_up(rows, chosen, "key", "id", chosen, rows.count()).select(*ROW, "size"))
    forget(rows, chosen)
    own = crowded.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.sum("size").alias("central"))  # two keys for each band at most
    out = cut(crowded.join(own, "id").select(*ROW, "size", "keys", "central"))
    forget(crowded)
    return out


def _most(n: Column, match: Column, p: str) -> Column:
    """The greatest similarity that sizes and matchable weights allow."""
    both = F.least(match, F.col(f"{p}.match"))
    return both / (n + F.col(f"{p}.n") - both)


def _odd(rows: DataFrame) -> DataFrame:
    """The rows that are not of their bucket's largest class: once these have been pivots, the bucket is settled."""
    counts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.first("size").alias("of"))
    return _meet(rows, counts).where(F.col("comp") != F.col("most.comp")).drop("most")


def _matchable(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """rows with `match`, the weight that occurs in another document still in a bucket; rows that can link to none are left out."""
    cells = sets.join(rows.select("id").distinct(), "id").select("id", F.explode("cells").alias("cell"))
    alone = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    rows = rows.join(alone, "id", "left").withColumn("match", F.least("match", F.col("n") - F.coalesce("alone", F.lit(0))))
    return rows.where(F.col("match") >= threshold * F.col("n")).select(*ROW)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = DEEP) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and copy_of (the least doc_id with the same text), for every row."""
    found = _classified(docs, id_col, text_col, threshold, shingle, bands, rows)
    return found.select("doc_id", "class_id", "copy_of")


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = DEEP) -> DataFrame:
    """doc_id, class_id, copy_of, text_key and first, the text_key that stands for the class: its least one among those with class_id."""
    signed = cut(signatures(docs, id_col, text_col, shingle, bands, rows))
    texts = signed.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))
    spread = texts.select(F.explode("keys").alias("key"), "id", F.col("n").cast("long").alias("n"), F.col("n").cast("long").alias("match"), F.col("id").alias("comp"))
    rows_in = _unsettled(cut(spread))
    nodes = cut(texts.select("id", "text_key", "doc_id").join(rows_in.select("id").distinct(), "id"))
    sets = cut(_sets(docs, nodes, id_col, text_col, shingle))
    if sets.count() > nodes.count():  # rows equal in id and text
        sets, more = cut(sets.dropDuplicates(["id"])), sets
        forget(more)
    loose = 1 - 2 * (1 - threshold) - 1e-9  # a row at the very bound is put on both sides
    found, turn = [], 0
    while not rows_in.isEmpty():
        head = F.min(F.struct((-F.col("central")).alias("order"), "id", "n", "match", "comp", "keys")).alias("p")
        pivots = _odd(rows_in) if turn else rows_in
        pivots = cut(pivots.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(16**turn)).alias("slot")).agg(head, F.first("size").alias("of")).select("key", "p", "of"))
        meet = (F.col("comp") != F.col("p.comp")) & (_most(F.col("n"), F.col("match"), "p") >= (threshold if turn else loose))
        if turn:  # a pair is compared in the first bucket that both are in
            meet = meet & (F.array_min(F.array_intersect("keys", "p.keys")) == F.col("key"))
        faced = _meet(rows_in, pivots).where(meet)
        first = F.col("id") < F.col("p.id")
        pairs = faced.select(
            F.least("id", "p.id").alias("a"),
            F.greatest("id", "p.id").alias("b"),
            F.when(first, F.col("comp")).otherwise(F.col("p.comp")).alias("ca"),
            F.when(first, F.col("p.comp")).otherwise(F.col("comp")).alias("cb"),
        )
        measured = _measured(pairs.distinct(), sets)
        if turn == 0:  # one pivot in each bucket; a row that was not measured against it is far
            known = measured.select("a", "b", "j")
            left = _meet(rows_in, pivots.select("key", "of", F.col("p.id").alias("pivot"))).where(F.col("id") != F.col("pivot"))
            left = left.withColumn("a", F.least("id", "pivot")).withColumn("b", F.greatest("id", "pivot")).join(known, ["a", "b"], "left")
            sides = F.array_compact(F.array(F.when(F.col("j") >= loose, F.lit(0)), F.when(F.coalesce(F.col("j"), F.lit(0.0)) < threshold, F.lit(1))))
            left = left.withColumn("side", F.explode(sides)).withColumn("key", F.xxhash64("key", "side")).select(*ROW)
        else:
            left = rows_in.join(pivots.select("key", F.col("p.id").alias("id")), ["key", "id"], "left_anti").select(*ROW)
        links = measured.where(F.col("j") >= threshold)
        if not links.isEmpty():
            found.append(cut(links.select("a", "b")))
            moved = connected_components(links, "ca", "cb").withColumnsRenamed({"node": "comp", "root": "to"})
            left = left.join(moved, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).select(*ROW)
        left = cut(_matchable(cut(left), sets, threshold))
        forget(rows_in, measured, pivots)
        rows_in = _unsettled(left)
        turn += 1
    forget(rows_in, sets, nodes)
    links = found[0] if found else texts.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    for more in found[1:]:
        links = links.unionByName(more)
    linked = connected_components(links, "a", "b").withColumnsRenamed({"node": "id", "root": "comp"})
    labelled = cut(texts.select("id", "text_key", "doc_id").join(linked, "id", "left"))
    some = labelled.where("comp IS NOT NULL")
    classes = some.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("least"))
    named = _look_up(some, classes, "comp", "id", _counted(some, "comp"), some.count()).select("text_key", F.col("doc_id").alias("copy_of"), F.col("least.doc_id").alias("class_id"), F.col("least.text_key").alias("first"))
    named = named.unionByName(labelled.where("comp IS NULL").select("text_key", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.col("text_key").alias("first")))
    written = signed.where("text_key IS NOT NULL").select("doc_id", "text_key")
    known = _look_up(written, named, "text_key", "doc_id", texts.select("text_key", F.col("rows").alias("size")), written.count()).select("doc_id", "class_id", "copy_of", "text_key", "first")
    alone = signed.where("text_key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), "text_key", F.col("text_key").alias("first"))
    return known.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their class: the row of least doc_id, of repeated rows one; of rows without an id one where none of the class has one.

    Rows with null text all stay, but for repeated ids, of which one does.
    """
    found = cut(_classified(docs, id_col, text_col))
    own = F.col("text_key").eqNullSafe(F.col("first")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = found.where(~own).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    key = F.unhex(F.md5(F.col(text_col)))
    kept = docs.withColumn("row_key__", key).join(gone, F.col(id_col).eqNullSafe(F.col("gone_id")) & F.col("row_key__").eqNullSafe(F.col("gone_key")), "left_anti")
    twice = found.where(own & ~(F.col("doc_id").isNull() & F.col("text_key").isNull())).groupBy("doc_id", "text_key").count().where("count > 1")
    if not twice.isEmpty():
        whole = F.col(id_col).isNull() & F.col("row_key__").isNull()
        kept = kept.where(whole).unionByName(kept.where(~whole).dropDuplicates([id_col, "row_key__"]))
    return kept.select(*docs.columns)
