"""Document fingerprints by winnowing.

A document's words are hashed, `K` neighbours at a time, and of every `WINDOW` neighbouring hashes the least is kept with
its position, the rightmost of equal ones. Two texts that share WINDOW + K - 1 words in a row therefore share a kept hash.
Everything is built from array functions on the row: least values over 2, 4, 8 neighbours by doubling, no explode, no
shuffle of k-grams. A hash keeps its upper 40 bits; the position sits below it in 23 bits, counted from the right, so that
the least number is the rightmost of equal hashes (positions wrap after 8 million words, which only moves ties).

Rows are in the order of their ids, those without an id first; equal and missing ids are ordered by the hash of their texts.
After the last row comes the first. For the neighbours, texts move once, into bands: stretches of this order with about equal
numbers of bytes, whose bounds are rows of a sample. A bound also goes, as a mark, to the end of the band before its own, so
every row finds the next one in its band. Outlying ids, ids that many rows share and missing ids are split like others; only
rows equal in both id and text stay together.

Defined cases: null text = empty; a text without words has no fingerprint entries, likeness of two such texts is 1; a text
of fewer than K words has one k-gram, all its words; fewer k-grams than WINDOW make one window; the one row of a table follows
itself; an empty table gives no rows; a very long text is one row like others, of any number of words. Repeated rows each
give a row. Other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.session import parallelism

K = 5
WINDOW = 8
POSITION_BITS = 23
#: Bytes of text in a band, bands that a task takes on average, rows sampled for each band, and bands at most (a bound is 40 bytes or so, in the plan).
BAND_BYTES = 8_000_000
BANDS_A_TASK = 4
SAMPLED = 16
MOST_BANDS = 1 << 18
WORD_GAP = r"[\x09-\x0D\x20]+"


def _pairs(df: DataFrame, source: str, target: str, shift: int, combine) -> DataFrame:
    """target[i] = combine(source[i], source[i + shift])."""
    n = F.greatest(F.size(source) - shift, F.lit(0))
    return df.withColumn(target, F.zip_with(F.slice(source, 1, n), F.slice(source, shift + 1, n), combine))


def winnow(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds `out`: array of kept numbers (hash << 23 | reversed position), ascending by position."""
    a, b = f"{out}__a", f"{out}__b"
    words = F.filter(F.split(F.col(text_col), WORD_GAP), lambda x: x != "")
    df = df.withColumn(a, F.transform(words, lambda x: F.xxhash64(x)))
    whole = F.when(F.size(a) > 0, F.array(F.aggregate(a, F.lit(42).cast("long"), lambda s, x: F.xxhash64(s, x)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(f"{out}__w", F.when(F.size(a) < K, whole))
    mix = lambda x, y: F.xxhash64(x, y)
    df = _pairs(df, a, b, 1, mix)  # pairs of words
    df = _pairs(df, b, b, 2, mix)  # fours
    n = F.greatest(F.size(b) - 1, F.lit(0))
    df = df.withColumn(a, F.zip_with(F.slice(b, 1, n), F.slice(a, K, n), mix))  # fives
    df = df.withColumn(a, F.coalesce(F.col(f"{out}__w"), F.col(a)))
    mask = (1 << POSITION_BITS) - 1
    packed = F.transform(a, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 24), POSITION_BITS).bitwiseOR(F.lit(mask) - i.bitwiseAND(F.lit(mask))))
    df = df.withColumn(a, packed)
    low = lambda x, y: F.least(x, y)
    df = _pairs(df, a, b, 1, low)
    df = _pairs(df, b, b, 2, low)
    df = _pairs(df, b, b, 4, low)
    kept = F.when(F.size(a) == 0, F.col(a)).when(F.size(a) < WINDOW, F.array(F.array_min(a))).otherwise(F.array_distinct(b))
    return df.withColumn(out, kept).drop(a, b, f"{out}__w")


def hashes(kept: Column) -> Column:
    """The set of hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, POSITION_BITS)))


def positions(kept: Column) -> Column:
    """The word positions at which the kept k-grams start."""
    mask = (1 << POSITION_BITS) - 1
    return F.transform(kept, lambda x: (F.lit(mask) - x.bitwiseAND(F.lit(mask))).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union).cast("double")


def digest(kept: Column) -> Column:
    return F.sha2(F.array_join(kept.cast("array<string>"), ","), 256)


def _place(df: DataFrame) -> Column:
    return F.struct("doc_id", "mix")


def _bounds(df: DataFrame, tasks: int) -> list[tuple[int | None, int]]:
    """The first place of every band: rows of a sample of some SAMPLED for each band, chosen so that bands hold like numbers of bytes; first the least row's."""
    least, rows, size = df.agg(F.min(_place(df)), F.count(F.lit(1)), F.sum("size")).first()
    if not rows:
        return []
    bands = max(1, min(MOST_BANDS, max(4 * tasks, size // BAND_BYTES)))
    sampled = df.where(F.pmod(F.xxhash64("doc_id", "mix", F.lit(1)), F.lit(max(1, rows // (bands * SAMPLED)))) == 0)
    places = sorted(((r.doc_id is not None, r.doc_id or 0, r.mix, r.size) for r in sampled.select("doc_id", "mix", "size").collect()))
    step, upto, out = -(-sum(p[3] for p in places) // bands), 0, [(least[0], least[1])]
    for named, doc_id, mix, n in places:
        if upto >= step * len(out) and (doc_id if named else None, mix) != out[-1]:
            out.append((doc_id if named else None, mix))
        upto += n
    return out


def in_bands(df: DataFrame, bounds: list[tuple[int | None, int]]) -> DataFrame:
    """df (doc_id, mix) with `band`, the last bound that is not beyond the row, and `mark`: bounds stand a second time, as marks, in the band before."""
    kind = "array<struct<doc_id:bigint,mix:bigint>>"
    given = lambda rows: F.from_json(F.lit(json.dumps([{"doc_id": i, "mix": m} for i, m in rows])), kind)
    wide = max(1, math.isqrt(len(bounds)))
    upto = lambda bs, place: F.size(F.filter(bs, lambda b: b <= place))
    df = df.withColumn("place__", _place(df)).withColumn("coarse__", upto(given(bounds[::wide]), F.col("place__")) - 1)
    df = df.withColumn("band__", F.col("coarse__") * wide + upto(F.slice(given(bounds), F.col("coarse__") * wide + 1, F.lit(wide)), F.col("place__")) - 1)
    first = F.element_at(given(bounds), F.col("band__") + 1) == F.col("place__")
    own = F.struct(F.col("band__").alias("band"), F.lit(False).alias("mark"))
    before = F.struct(F.pmod(F.col("band__") - 1, F.lit(len(bounds))).alias("band"), F.lit(True).alias("mark"))
    return df.withColumn("to__", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own)))).withColumns({"band": F.col("to__.band"), "mark": F.col("to__.mark")}).drop("place__", "coarse__", "band__", "to__")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the start of the next document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mix", F.xxhash64("text"))
    n = parallelism(docs.sparkSession)
    bounds = _bounds(base.select("doc_id", "mix", (F.octet_length("text") + 64).cast("long").alias("size")), n)
    base = in_bands(base, bounds) if bounds else base.withColumns({"band": F.lit(0), "mark": F.lit(False)})
    base = base.repartition(max(n, len(bounds) // BANDS_A_TASK), "band").sortWithinPartitions("band", "mark", "doc_id", "mix", "text")
    base = winnow(base, "text", "kept").withColumn("set", hashes(F.col("kept")))
    step = Window.partitionBy("band").orderBy("mark", "doc_id", "mix", "text")
    base = base.withColumn("next", F.lead(F.struct("text", "set")).over(step)).where(~F.col("mark"))

    base = base.withColumn("n_chars", F.char_length("text").cast("long"))
    base = base.withColumn("q", F.floor(F.col("n_chars") / 4).cast("int"))
    base = base.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - q), left(next.text, q))"))
    base = winnow(base, "edited", "edited_kept")
    return base.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("kept")).alias("fingerprint"),
        digest(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("set"), hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("set"), F.col("next.set")).alias("near_next"),
        F.size("kept").cast("long").alias("n_kept"),
    )
