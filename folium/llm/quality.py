"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes; only the bag has a label. Every passage is encoded by how it is written
(shares of kinds of bytes, hashed pairs of bytes, repeated and distinct words) through a hidden layer; gated attention,
tanh(V h) * sigmoid(U h), weighs the passages, and a logistic unit scores the weighted mean. All layers are learned
together from document labels with Adam, in numpy, from fixed seeds.

Training sees at most TRAIN_ROWS labelled rows, half of each label, the ones of least hash of doc_id among those with at
most TRAIN_BYTES bytes of text; scoring sees every whole text. Rows with crc32(doc_id as text) mod 4 = 2 are held out.
Inputs of a score are the text's bytes alone.

Defined cases: null text = empty, one passage of zeros; labels that are null are ignored, of several labels for a doc_id
the least counts, and of several texts the least; without labels of both kinds there is nothing to learn and every score is 1;
repeated rows and rows without an id each give a row, the latter not held out; very long texts are scored whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm import hashing as H
from folium.llm.arrow import mapped, over

PASSAGE = 512
TRAIN_ROWS = 4000
TRAIN_BYTES = 16_384
CUT = 0.7
PAIRS = 256
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE = 12, 64, 4e-3


def _kinds() -> np.ndarray:
    """A kind for every byte: the 33 ASCII marks each their own, then white space, digits, capitals, small letters, others."""
    out = np.full(256, 37, np.int64)
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    out[marks] = np.arange(len(marks))
    out[[0x20, *range(0x09, 0x0E)]] = 33
    out[0x30:0x3A], out[0x41:0x5B], out[0x61:0x7B] = 34, 35, 36
    return out


KINDS = _kinds()
#: Features of a passage, and last how far they are to be trusted: a short passage says little.
FEATURES = 38 + 3 + PAIRS
WIDTH = FEATURES + 1
TRUST = 64


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every passage, and where each text's passages start, with the end last."""
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-sizes // PASSAGE))
    starts = np.r_[0, np.cumsum(counts)]
    n = int(starts[-1])
    out = np.zeros((n, WIDTH), np.float32)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf):
        begin = np.r_[0, np.cumsum(sizes)]
        place = np.arange(len(buf)) - np.repeat(begin[:-1], sizes)
        owner = np.repeat(starts[:-1], sizes) + place // PASSAGE
        total = np.maximum(1, np.bincount(owner, minlength=n))[:, None]
        out[:, FEATURES:] = total / (total + TRUST)
        out[:, :38] = np.bincount(owner * 38 + KINDS[buf], minlength=n * 38).reshape(n, 38) / total
        pair = (buf[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) ^ buf[1:].astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(24)
        out[:, 41:FEATURES] = np.sqrt(np.bincount(owner[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / total)
        inside = ~H.WHITE[buf] & (place >= 0)
        joint = np.concatenate([[True], place[1:] == 0])  # a text's first byte parts words
        first = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | joint[1:]])
        last = np.flatnonzero(inside & np.r_[~inside[1:] | joint[1:], True]) + 1
        if len(first):
            word, of = H.Sums(buf).of(first, last), owner[first]
            words = np.maximum(1, np.bincount(of, minlength=n))
            again = np.r_[False, (word[1:] == word[:-1]) & (of[1:] == of[:-1])]
            out[:, 38] = np.bincount(of[again], minlength=n) / words
            different = np.unique(H.mix(word + of.astype(np.uint64) * H.BASE), return_index=True)[1]
            out[:, 39] = np.bincount(of[different], minlength=n) / words
            out[:, 40] = np.bincount(of, np.minimum(last - first, 30), minlength=n) / words / 10
    return out, starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    def __init__(self, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        init = lambda a, b: (rnd.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"w1": init(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "v": init(HIDDEN, GATE), "u": init(HIDDEN, GATE), "w": init(GATE, 1)[:, 0], "w2": init(HIDDEN, 1)[:, 0], "b2": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x[:, :-1] - self.mean) * self.scale, -6, 6) * x[:, -1:]
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = np.exp(np.clip((t * s) @ p["w"], -20, 20))
        bag = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        a = e / np.add.reduceat(e, starts[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, starts[:-1])
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["w2"] + p["b2"])}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, bag, a, h, t, s = self.p, f["bag"], f["a"], f["h"], f["t"], f["s"]
        d = (f["y"] - y) * weight / weight.sum()
        dz = d[:, None] * p["w2"]
        da = (dz[bag] * h).sum(1)
        mean = np.bincount(bag, a * da, minlength=len(y))
        de = a * (da - mean[bag])  # through the softmax of a bag
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T
        dpre = dh * (1 - h * h)
        return {"w1": f["x"].T @ dpre, "b1": dpre.sum(0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ de, "w2": f["z"].T @ d, "b2": np.array([d.sum()])}

    def fit(self, texts: list[bytes], y: np.ndarray, share: float = 0.5, seed: int = 11) -> Attention:
        """share: of label 1 among all labelled rows; rows are weighted so that scores are chances under it."""
        parts = [passages(texts[i : i + 100]) for i in range(0, len(texts), 100)]  # bounded, as features of raw bytes are many times their size
        x = np.concatenate([p for p, _ in parts])
        starts = np.r_[0, np.cumsum(np.concatenate([np.diff(s) for _, s in parts]))]
        self.mean = x[:, :-1].mean(0)
        self.scale = (1 / (x[:, :-1].std(0) + 0.02)).astype(np.float32)
        weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
        rnd, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(EPOCHS):
            order = rnd.permutation(len(y))
            for at in range(0, len(y), BATCH):
                own = order[at : at + BATCH]
                rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
                bags = np.r_[0, np.cumsum(starts[own + 1] - starts[own])]
                g = self.gradients(self.forward(x[rows], bags), y[own], weight[own])
                step += 1
                for k, d in g.items():
                    d = d + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x, starts = passages(texts)
        return self.forward(x, starts)["y"]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the rows that may be learned from."""
    rows = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 2)
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def training_rows(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, rows: int, longest: int) -> list:
    """At most `rows` rows (text, quality), half of each label where there are so many."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_col).alias("size")).where(F.col("size") <= longest).select("doc_id").distinct()
    fit = known.join(texts, "doc_id", "left_semi")
    pick = [fit.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for q in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # `rows` rows at most
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= longest).join(chosen, "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("quality").alias("quality")).orderBy("doc_id").select("text", "quality").collect()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, longest: int = TRAIN_BYTES) -> Attention | None:
    known = known_labels(labels)
    found = training_rows(docs, known, id_col, text_col, rows, longest)
    y = np.array([r.quality for r in found], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    share = known.agg(F.avg("quality")).first()[0]
    return Attention().fit([(r.text or "").encode() for r in found], y, share)


def score_documents(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def work(batch: pa.RecordBatch) -> dict:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        score = np.ones(len(texts)) if model is None else model.score(texts)
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": (score >= cut).astype(np.int32)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(fold(F.col(id_col)) == 2, F.lit(False)).alias("held_out"))
    return over(rows, mapped(work, schema), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Attention | None, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose score reaches cut."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)

    def run(batches):
        from folium.llm.arrow import pieces

        for piece in pieces(batches, text_col):
            if model is None:
                yield piece
                continue
            good = model.score([(t or "").encode() for t in piece.column(text_col).to_pylist()]) >= cut
            yield pa.RecordBatch.from_arrays(piece.filter(pa.array(good)).columns, schema=schema)

    return over(docs, run, docs.schema)
