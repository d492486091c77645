import hashlib
import random
import re
import struct
import zlib
from itertools import accumulate

import xxhash
from test_repeats import documents

from folium.llm import fingerprints as P
from folium.llm import licenses as L
from folium.llm import sharding as S

SIGN = 1 << 64


def h(*longs, seed=42):
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", x % SIGN), seed=seed)
    return seed


def kept(text):
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return []
    if len(words) < P.K:
        s = 42
        for w in words:
            s = h(s, w)
        grams = [s]
    else:
        twos = [h(a, b) for a, b in zip(words, words[1:])]
        fours = [h(a, b) for a, b in zip(twos, twos[2:])]
        grams = [h(fours[i], words[i + 4]) for i in range(len(fours) - 1)]
    n = max(1, len(grams) - P.WINDOW + 1)
    out = []
    for i in range(n):
        window = [(g >> 24, -j) for j, g in enumerate(grams[i : i + P.WINDOW], i)]
        best, place = min(window)
        if not out or out[-1] != (best, -place):
            out.append((best, -place))
    return out


def like(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(frame):
    rows = sorted({i: (t or "") for i, t in documents(6)}.items())
    docs = frame([(i, None if i == 300 else t) for i, t in rows])
    got = {r.doc_id: r for r in P.fingerprint_documents(docs).collect()}
    assert got.keys() == dict(rows).keys()
    print_of = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(kept(t), kept(edited))) < 1e-9 and abs(r.near_next - like(kept(t), kept(following))) < 1e-9
        assert r.n_kept == len(kept(t))
        assert print_of.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(print_of.values())) == len({tuple(kept(t)) for t in print_of})
    assert P.fingerprint_documents(docs.where("false")).count() == 0
    one = P.fingerprint_documents(frame([(5, "a b c d e f g h")])).first()
    assert one.near_next == 1.0


def test_a_shared_run_is_always_found(frame):
    rnd = random.Random(1)
    run = " ".join(f"s{i}" for i in range(P.WINDOW + P.K - 1))
    for _ in range(20):
        a = kept(" ".join([*(f"a{rnd.random()}" for _ in range(rnd.randint(0, 30))), run, *(f"b{rnd.random()}" for _ in range(rnd.randint(0, 30)))]))
        b = kept(" ".join([*(f"c{rnd.random()}" for _ in range(rnd.randint(0, 30))), run]))
        assert {x for x, _ in a} & {x for x, _ in b}


def brute_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


def test_sharding(frame, monkeypatch):
    monkeypatch.setattr(S, "PREFIX_ROWS", 1000)
    assert [S._digits(n) for n in (0, 1000, 1001, 16_001, 10**9)] == [3, 3, 4, 5, 5]
    monkeypatch.setattr(S, "PREFIX_ROWS", 20)
    rows = documents(7) + [(1000 + i, "the same text") for i in range(300)] + [(5000, None)]
    for n, bins in ((24, S.BINS), (5, 16), (1, 8), (200, 50)):
        got = S.shard_documents(frame(rows), n, bins=bins).collect()
        assert len(got) == len(rows)
        text = {}
        for i, t in rows:
            text.setdefault(i, t or "")
        groups = {}
        for r in got:
            t = text[r.doc_id]
            assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
            groups.setdefault(t, []).append(r)
        assert all(len({r.shard for r in g}) == 1 for g in groups.values())
        order = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
        sizes = [sum(r.size for r in groups[t]) for t in order]
        shards = [groups[t][0].shard for t in order]
        assert shards == sorted(shards) and set(shards) <= set(range(n))
        load = [sum(s for s, k in zip(sizes, shards) if k == j) for j in range(n)]
        assert max(load) == brute_capacity(sizes, n) or max(load) <= brute_capacity(sizes, n)
        for j in range(n):
            assert sorted(r.slot for r in got if r.shard == j) == list(range(sum(k == j for k in (r.shard for r in got))))
    assert S.shard_documents(frame(rows).where("false")).count() == 0


def test_search_for_capacity():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = [rnd.choice([rnd.randint(8, 40), rnd.randint(8, 3000)]) for _ in range(rnd.randint(1, 60))]
        ends, n = S._Ends(), rnd.randint(1, 12)
        all_ends = list(accumulate(sizes))
        ends.refine(0, all_ends[-1], 1, [(e, 1) for e in all_ends])
        low = max(max(sizes), -(-all_ends[-1] // n))
        assert S._smallest(ends.below, low, all_ends[-1], n, all_ends[-1]) == brute_capacity(sizes, n)


def test_licenses(frame, spark):
    texts = {
        1: "Some text.\nLicensed under the Apache License, Version 2.0.\nMore.",
        2: "x. Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal in the Software\nwithout restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        3: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.",
        4: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        5: "Copyright (c) 2020 Someone. All rights reserved.",
        6: "", 7: None, 8: "nothing of the kind", 9: "MIT" * 50_000,
    }
    got = {r.doc_id: r for r in L.scan_licenses(frame([*texts.items(), (1, texts[1])])).collect()}
    assert {i: got[i].licenses for i in texts} == {1: "Apache-2.0", 2: "MIT", 3: "MIT,CC-BY-NC-4.0", 4: "GPL-3.0-or-later", 5: "proprietary", 6: "", 7: "", 8: "", 9: ""}
    assert got[3].sequence == "MIT-ref,CC-BY-NC-4.0-ref,MIT-ref" and got[7].n_sentences == 0 and got[2].n_known == 2
    assert L.scan_licenses(frame([(1, "x")]).where("false")).count() == 0
