"""Sharding: a minimax contiguous partition of ordered atomic groups.

Groups are the documents with equal texts (null counts as empty). They lie in the order of their texts' MD5. The smallest
capacity for which the groups, in that order, fit into `n_shards` runs is found by binary search with a greedy check; the
cuts are then placed under that capacity as near to even as it allows.

Only DataFrame operations touch rows. Running sums are taken in two levels (a bounded number of MD5 prefixes, then the
groups of a prefix), and a group of many copies is dealt over `salts` cells, so neither one long list nor one hot text
meets in a task. The search itself sees a bounded number of group ends: first the last one in each of `bins` equal
stretches of bytes, then again only inside the stretches where a cut may fall, until the capacity is exact.

Defined cases: null text = empty text, 8 bytes; repeated rows each get a slot; an empty table gives no rows; with fewer
groups than shards some shards stay empty; rows without an id are one id; very long texts are taken whole; other columns of
the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.session import cut

#: Digits of an MD5 prefix: PREFIX_DIGITS, and one more for each sixteenfold of PREFIX_ROWS rows, up to MOST_DIGITS.
PREFIX_DIGITS, MOST_DIGITS = 3, 5
PREFIX_ROWS = 400_000_000
SALTS = 128
BINS = 1 << 15


def _digits(rows: int) -> int:
    digits = PREFIX_DIGITS
    while digits < MOST_DIGITS and rows > PREFIX_ROWS * 16 ** (digits - PREFIX_DIGITS):
        digits += 1
    return digits


def _cells(base: DataFrame, digits: int = PREFIX_DIGITS) -> DataFrame:
    """(key, salt) cells with running sums: n_end rows and group_end bytes up to the cell's and its group's end."""
    cells = base.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    cells = cells.withColumn("prefix", F.substring("key", 1, digits))
    totals = cells.groupBy("prefix").agg(F.sum("n").alias("pn"), F.sum("bytes").alias("pb"))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** MOST_DIGITS rows at most
    totals = totals.select(
        "prefix",
        F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("pn"),
        F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("pb"),
    )
    upto = Window.partitionBy("prefix").orderBy("key", "salt").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("prefix", "key")
    cells = cells.withColumn("n_end", F.sum("n").over(upto)).withColumn("b_end", F.sum("bytes").over(upto))
    cells = cells.withColumn("group_end", F.max("b_end").over(group)).withColumn("group_bytes", F.sum("bytes").over(group))
    cells = cells.withColumn("last", F.col("b_end") == F.col("group_end"))
    return cells.join(F.broadcast(totals), "prefix").select(
        "key", "salt", "n", "group_bytes", "last", (F.col("n_end") + F.col("pn")).alias("n_end"), (F.col("group_end") + F.col("pb")).alias("group_end")
    )


class _Ends:
    """Known group ends; between two of them, others may be hidden above `floor` of the upper one."""

    def __init__(self) -> None:
        self.at: list[int] = [0]
        self.floor: list[int] = [-1]

    def refine(self, lo: int, hi: int, width: int, ends: list[tuple[int, int]]) -> None:
        """Replaces what is known inside (lo, hi], both known ends, by each stretch's last end and its number of ends."""
        kept = [(a, f) for a, f in zip(self.at, self.floor) if not lo < a <= hi]
        kept += [(a, a - 1 if n == 1 else max((a - 1) // width * width, lo)) for a, n in ends]
        kept.sort()
        self.at, self.floor = [a for a, _ in kept], [f for _, f in kept]

    def below(self, target: int) -> int:
        return self.at[bisect_right(self.at, target) - 1]

    def above(self, target: int) -> int:
        return self.at[min(bisect_left(self.at, target), len(self.at) - 1)]

    def at_most(self, target: int) -> int:
        """The greatest position a cut can have if it may be no greater than target."""
        i = bisect_right(self.at, target)
        if i < len(self.at) and target > max(self.floor[i], self.at[i - 1]):
            return target
        return self.at[i - 1]


def _greedy(step, capacity: int, n: int) -> list[int]:
    cuts, pos = [], 0
    for _ in range(n):
        pos = step(pos + capacity)
        cuts.append(pos)
    return cuts


def _smallest(step, low: int, high: int, n: int, total: int) -> int:
    while low < high:
        mid = (low + high) // 2
        if _greedy(step, mid, n)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(cells: DataFrame, n_shards: int, bins: int = BINS) -> tuple[int, list[int]]:
    """The least capacity and n_shards - 1 cut positions in bytes, from cells' group_end and group_bytes."""
    top = cells.agg(F.max("group_end"), F.max("group_bytes")).first()
    total, largest = top[0] or 0, top[1] or 0
    if not total:
        return 0, [0] * (n_shards - 1)
    ends, spans, width = _Ends(), [(0, total)], total * 4
    while True:
        width = max(1, min(width // 4, -(-sum(hi - lo for lo, hi in spans) // bins)))
        inside: Column = F.lit(False)
        for lo, hi in spans:
            inside = inside | ((F.col("group_end") > lo) & (F.col("group_end") <= hi))
        stretches = cells.where(inside).groupBy(F.expr(f"(group_end - 1) div {width}").alias("stretch"))
        found = sorted((r[0], r[1]) for r in stretches.agg(F.max("group_end"), F.sum(F.col("last").cast("int"))).drop("stretch").collect())
        for lo, hi in spans:
            ends.refine(lo, hi, width, found[bisect_right(found, (lo, total)) : bisect_right(found, (hi, total))])
        low = max(largest, -(-total // n_shards))
        least = _smallest(ends.at_most, low, total, n_shards, total)
        capacity = _smallest(ends.below, least, total, n_shards, total)
        if least == capacity:
            break
        firm, loose = _greedy(ends.below, least, n_shards), _greedy(ends.at_most, capacity, n_shards)
        spans = []
        for lo, hi in zip(firm[:-1], loose[:-1]):
            hi = min(total, ends.above(hi))
            if hi <= lo:
                continue
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
    earliest, pos = [0] * n_shards, total
    for j in range(n_shards - 1, 0, -1):
        pos = ends.above(max(0, pos - capacity))
        earliest[j] = pos
    cuts, pos = [], 0
    for j in range(1, n_shards):
        want = total * j // n_shards
        options = {ends.below(want), ends.above(want), earliest[j], ends.below(pos + capacity)}
        pos = min((abs(p - want), p) for p in options if max(pos, earliest[j]) <= p <= pos + capacity)[1]
        cuts.append(pos)
    return capacity, cuts


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, bins: int = BINS) -> DataFrame:
    """Shard and slot of every row; sizes of shards are as near equal as whole groups of equal texts allow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("key"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
    )
    cells = cut(_cells(base, _digits(docs.count())))
    _, cuts = minimax_cuts(cells, n_shards, bins)
    shard = sum(((F.col("group_end") > c).cast("int") for c in cuts), F.lit(0)).cast("int")
    cells = cells.withColumn("shard", shard)
    first = cells.groupBy("shard").agg(F.min(F.col("n_end") - F.col("n")).alias("first"))  # n_shards rows
    cells = cells.join(F.broadcast(first), "shard").select("key", "salt", "shard", (F.col("n_end") - F.col("n") - F.col("first")).alias("base_slot"))
    rank = F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id"))
    return base.withColumn("rank", rank).join(cells, ["key", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base_slot") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
