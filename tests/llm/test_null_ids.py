import hashlib

import pytest
import xxhash
from test_native import kept, like

from folium.llm import fingerprints as P


def mix(t):
    h = xxhash.xxh64_intdigest(t.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def check(frame, rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, mix(r[1])))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(kept(t), kept(edited)), 9), round(like(kept(t), kept(after)), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in P.fingerprint_documents(frame(rows)).collect()]
    assert sorted(got) == sorted(want)


def text(k):
    return " ".join(f"w{j * k % 11}" for j in range(8 + k))


@pytest.fixture(params=[8_000_000, 300])
def band_bytes(request, monkeypatch):
    monkeypatch.setattr(P, "BAND_BYTES", request.param)


def test_rows_without_an_id(frame, band_bytes):
    rows = [(i * 7, text(i)) for i in range(20)] + [(None, text(30)), (None, text(31)), (None, None), (7, text(5))]
    check(frame, rows)
    check(frame, [(None, t) for _, t in rows])
    check(frame, [(None, text(3)), (-5, text(4))])
    check(frame, [(3, text(2))])
    check(frame, [(None, None)] * 9 + [(1, "")] * 5 + [(2, text(9))] * 4)


def test_ids_at_both_ends_of_a_long(frame, band_bytes):
    ends = [-(1 << 63), -(1 << 63) + 1, -1, 0, (1 << 63) - 2, (1 << 63) - 1]
    check(frame, [(i, text(k)) for k, i in enumerate(ends)] + [(i, text(i)) for i in range(100, 160)])


def test_an_outlying_id_leaves_bands_even(spark):
    ids = spark.range(4000).selectExpr("CASE WHEN id = 0 THEN 1000000000000000L WHEN id < 1400 THEN NULL WHEN id < 2400 THEN 9 ELSE id END AS doc_id", "xxhash64(id) AS mix", "100L AS size")
    bounds = P._bounds(ids, 8)
    assert len(bounds) == 32
    sizes = [r["count"] for r in P.in_bands(ids, bounds).where("NOT mark").groupBy("band").count().collect()]
    assert len(sizes) == 32 and sum(sizes) == 4000 and max(sizes) < 350
    assert P.in_bands(ids, bounds).where("mark").count() == 32
