"""Exact dedup of byte strings of at least `LENGTH` bytes, by columns of aligned texts.

Column-wise construction takes a collection of texts and, from the last column to the first, inserts one symbol of each
text: a stable sort by that symbol updates the order of all suffixes, and range minima update the common prefixes of
neighbours. Run over whole documents it needs as many rounds, each over all texts so far, as the longest document has
bytes. Here it runs over short aligned pieces instead, which makes the rounds few and lets parts work by themselves:

1. Of every window of LENGTH bytes the K-byte gram of least hash (leftmost of equals) is its minimizer; it depends on the
   window's bytes alone, so equal windows have equal minimizers at equal places. Runs of windows with one minimizer form a
   piece of at most 2 * LENGTH - K bytes.
2. Minimizers that occur once in the collection are dropped with their pieces.
3. A part gets all different pieces of its minimizers, lays them into rows with the minimizers in one column, and inserts
   columns from right to left. A window is repeated if a neighbour's common prefix at its column reaches LENGTH bytes, or
   if its piece occurs more than once. The parts' files are those of Spark's exchange.
4. Every byte that a repeated window covers is removed.

Equal pieces are told by 128 bits of hash over their bytes, different ones by the columns.

Defined cases: null text = empty; texts below LENGTH bytes lose nothing; equal texts of at least LENGTH bytes lose
everything; repeats inside one document count; repeated rows are two documents, whether they have an id, share one or have
none; very long texts are taken whole, in a bundle of their own size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm import bundles as B
from folium.llm import hashing as H

LENGTH = 200
K = 50
SPAN = LENGTH - K + 1
PAD = 0xFF  # no byte of UTF-8
ROWS = 40_000
PLACE = H.U((1 << 24) - 1)
STRETCH = 1 << 23


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours, by doubling."""
    have = 1
    while 2 * have <= n:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (n - have)], values[n - have :]) if n > have else values


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, H.Sums] | None:
    """Over a slice's bytes laid end to end: buffer, first and last window start, minimizer place and hash of every piece."""
    whole = b"".join(texts)
    if len(whole) < LENGTH:
        return None
    buf = np.frombuffer(whole, np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    sums = H.Sums(buf)
    grams = sums.runs(K)
    found = []
    for base in range(0, len(grams) - SPAN + 1, STRETCH):  # places are kept in 24 bits
        part = grams[base : base + STRETCH + SPAN - 1]
        least = _least((part & ~PLACE) | np.arange(len(part), dtype=H.U), SPAN)
        found.append((least & PLACE).astype(np.int64) + base)
    place = np.concatenate(found)
    ok = np.ones(len(place), bool)
    for s in starts[1:-1].tolist():  # windows that would cross into the next text
        ok[max(0, s - LENGTH + 1) : s] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    fresh = np.r_[True, (np.diff(at) != 1) | (np.diff(place[at]) != 0)]
    lo = at[fresh]
    hi = np.r_[at[np.flatnonzero(fresh)[1:] - 1], at[-1]]
    return buf, lo, hi, place[lo], grams[place[lo]], sums


def _names(buf: np.ndarray, sums: H.Sums, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Two hashes of each stretch of a slice's bytes, and both as one number."""
    one, two = sums.of(lo, end), H.Sums(buf ^ np.uint8(0xA5)).of(lo, end)
    return one, two, _joined(one, two)


def _joined(one: np.ndarray, two: np.ndarray) -> list[int]:
    return [a | b << 64 for a, b in zip(one.tolist(), two.tolist())]


def _send_minimizers(parts: int):
    def work(table: pa.Table) -> pa.Table:
        keys = [np.empty(0, np.uint64)]
        for _, texts in B.sliced(*B.rows(table)):
            if (p := _pieces(texts)) is not None:
                keys.append(p[4])
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        many = (n > 1).astype(np.uint8)
        return B.to_parts(B.first(table.column("bundle")), k, parts, lambda g: B.pack(k[g], many[g]))

    return work


HEAD = np.dtype([("mini", "<u8"), ("one", "<u8"), ("two", "<u8"), ("off", "<u2"), ("windows", "<u2"), ("many", "u1")])


def _send_pieces(parts: int):
    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        shared = np.sort(np.concatenate([np.empty(0, np.uint64), *(B.unpack(p, "<u8")[0] for p in B.payloads(told))]))
        heads: dict[int, list] = {}
        if len(table) and len(shared):
            for _, texts in B.sliced(*B.rows(table)):
                if (p := _pieces(texts)) is None:
                    continue
                buf, lo, hi, place, mini, sums = p
                use = np.flatnonzero(B.member(mini, shared)[0])
                if not len(use):
                    continue
                one, two, names = _names(buf, sums, lo[use], hi[use] + LENGTH)
                raw = buf.tobytes()
                for m, c, x, y, a, b, q in zip(mini[use].tolist(), names, one.tolist(), two.tolist(), lo[use].tolist(), hi[use].tolist(), place[use].tolist()):
                    if c in heads:
                        heads[c][5] = 1
                    else:
                        heads[c] = [m, x, y, q - a, b - a + 1, 0, raw[a : b + LENGTH]]
        got = list(heads.values())
        keys = np.array([h[0] for h in got], np.uint64)

        def make(g: np.ndarray) -> bytes:
            mine = [got[i] for i in g.tolist()]
            return len(mine).to_bytes(8, "little") + np.array([tuple(h[:6]) for h in mine], HEAD).tobytes() + b"".join(h[6] for h in mine)

        return B.to_parts(B.first(table.column("bundle")) if len(table) else 0, keys, parts, make)

    return work


def columns(matrix: np.ndarray) -> np.ndarray:
    """For rows of symbols with PAD outside: whether row r has LENGTH symbols from column c in common with another row.

    Columns are inserted from the last to the first. order is that of the rows' suffixes from the current column on, and
    common[i] the length of the common prefix of rows order[i - 1] and order[i]; PAD is equal to nothing.
    """
    m, width = matrix.shape
    order, common = np.arange(m), np.zeros(m + 1, np.int16)
    out = np.zeros((m, width - LENGTH + 1), bool)
    turned = np.ascontiguousarray(matrix.T)
    for c in range(width - 1, -1, -1):
        symbol = turned[c][order]
        to = np.argsort(symbol, kind="stable")
        a, b = to[:-1], to[1:]
        cuts = np.empty(2 * (m - 1), np.int64)
        cuts[::2], cuts[1::2] = a + 1, b + 1
        least = np.minimum.reduceat(common, cuts)[::2]
        same = (symbol[a] == symbol[b]) & (symbol[b] != PAD)
        order = order[to]
        common = np.zeros(m + 1, np.int16)
        common[1:m] = np.where(same, least + 1, 0)
        if c <= width - LENGTH:
            far = common >= LENGTH
            out[order, c] = far[:m] | far[1:]
    return out


def _repeated(table: pa.Table) -> pa.Table:
    bundles, data = table.column("bundle").to_pylist(), table.column("payload").to_pylist()
    seen: dict[int, list] = {}  # name -> [mini, off, windows, many, bytes]
    mine: list[list[int]] = []
    for payload in data:
        n = int.from_bytes(payload[:8], "little")
        heads = np.frombuffer(payload, HEAD, n, 8)
        at = 8 + n * HEAD.itemsize
        own = _joined(heads["one"], heads["two"])
        mine.append(own)
        for h, c in zip(heads.tolist(), own):
            size = h[4] + LENGTH - 1
            if c in seen:
                seen[c][3] = 1
            else:
                seen[c] = [h[0], h[3], h[4], h[5], payload[at : at + size]]
            at += size
    found: dict[int, bytes] = {}  # name -> windows that are repeated, a bit for each
    groups: dict[int, list[int]] = {}
    for c, v in seen.items():
        groups.setdefault(v[0], []).append(c)
        if v[3]:
            found[c] = np.packbits(np.ones(v[2], bool)).tobytes()
    todo = [g for g in groups.values() if len(g) > 1 and not all(seen[c][3] for c in g)]
    batch: list[int] = []
    for i, g in enumerate(todo):
        batch += g
        if len(batch) < ROWS and i + 1 < len(todo):
            continue
        width = 2 * LENGTH - K
        matrix = np.full((len(batch), width), PAD, np.uint8)
        for r, c in enumerate(batch):
            _, off, _, _, raw = seen[c]
            matrix[r, LENGTH - K - off : LENGTH - K - off + len(raw)] = np.frombuffer(raw, np.uint8)
        hits = columns(matrix)
        for r in np.flatnonzero(hits.any(axis=1)).tolist():
            c = batch[r]
            if not seen[c][3]:
                begin = LENGTH - K - seen[c][1]
                found[c] = np.packbits(hits[r, begin : begin + seen[c][2]]).tobytes()
        batch = []
    out = []
    for b, own in zip(bundles, mine):
        hit = [c for c in own if c in found]
        if hit:
            width = max(len(found[c]) for c in hit)
            out.append((b, len(hit).to_bytes(8, "little") + b"".join(c.to_bytes(16, "little") for c in hit) + b"".join(found[c].ljust(width, b"\0") for c in hit)))
    return B.answers(out)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _whole_characters(gone: np.ndarray, raw: bytes) -> np.ndarray:
    """A character of UTF-8 goes only if all its bytes do."""
    begin = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, begin), np.diff(np.r_[begin, len(raw)])) if len(begin) else gone


def _remove(digest: bool, whole: bool = False, rest: pa.DataType | None = None):
    schema = OUT if rest is None else OUT.append(pa.field("rest", rest))

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in OUT}
        if not len(table):
            return schema.empty_table()
        bits: dict[int, bytes] = {}
        firsts = [np.empty(0, np.uint64)]
        for p in B.payloads(told):
            n = int.from_bytes(p[:8], "little")
            keys = np.frombuffer(p, "<u8", 2 * n, 8)
            flags, width = p[8 + 16 * n :], (len(p) - 8 - 16 * n) // n
            firsts.append(keys[::2])
            for i, c in enumerate(_joined(keys[::2], keys[1::2])):
                bits[c] = flags[i * width : (i + 1) * width]
        known = np.unique(np.concatenate(firsts))
        for ids, texts in B.sliced(*B.rows(table)):
            total = sum(map(len, texts))
            gone = np.zeros(total, bool)
            p = _pieces(texts) if len(known) else None
            if p is not None:
                _, lo, hi, _, _, sums = p
                use, starts = np.flatnonzero(B.member(sums.of(lo, hi + LENGTH), known)[0]), []
                names = _names(p[0], sums, lo[use], hi[use] + LENGTH)[2] if len(use) else []
                for i, c in zip(use.tolist(), names):
                    if c in bits:
                        flags = np.unpackbits(np.frombuffer(bits[c], np.uint8), count=int(hi[i] - lo[i]) + 1)
                        starts.append(np.flatnonzero(flags) + lo[i])
                if starts:
                    gone = H.covered(np.concatenate(starts), total, LENGTH)
            at = 0
            for i, text in enumerate(texts):
                cut = gone[at : at + len(text)]
                at += len(text)
                if whole and cut.any():
                    cut = _whole_characters(cut, text)
                kept = text
                if cut.any():
                    kept = np.frombuffer(text, np.uint8)[~cut].tobytes()
                out["doc_id"].append(ids[i])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(int(np.count_nonzero(np.diff(cut.view(np.int8), prepend=np.int8(0)) == 1)))
                out["kept"].append(hashlib.sha256(kept).hexdigest().encode() if digest else kept)
        if rest is not None:
            out["rest"] = table.column("rest").take(pa.array(B.in_order(table))).combine_chunks()
        return pa.Table.from_pydict(out, schema=schema)

    return work


def _answers(texts: DataFrame, parts: int) -> DataFrame:
    """Steps 1 to 3: for every bundle its pieces with repeated windows."""
    shared = B.shared_keys(texts.groupBy("bundle").applyInArrow(_send_minimizers(parts), B.SEND), parts)
    sent = texts.groupBy("bundle").cogroup(shared.groupBy("bundle")).applyInArrow(_send_pieces(parts), B.SEND)
    return B.by_part(sent, parts).applyInArrow(_repeated, B.ANSWER)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes, or the hex SHA-256 of these as bytes."""
    texts, parts = B.bundled(docs, id_col, text_col)
    told = _answers(texts, parts)
    return texts.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(_remove(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without repeated stretches of their texts; a character goes only with all its bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    texts, parts = B.bundled(docs, id_col, text_col, carry=True)
    told = _answers(texts.drop("rest"), parts)
    rest = to_arrow_schema(texts.select("rest").schema).field("rest").type
    out = texts.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(
        _remove(False, True, rest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, rest {texts.schema['rest'].dataType.simpleString()}"
    )
    return out.select(*[F.col("kept").cast("string").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
