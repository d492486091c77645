import random
import re
from collections import Counter

import numpy as np
import pytest

from folium.llm import dart_minhash as D


def runs(text, n=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def classes(rows, threshold=0.8):
    sets = [runs(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or rows[i][0] == rows[j][0] or jaccard(sets[i], sets[j]) >= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def documents():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    rows = []
    for base in range(12):
        w = words(rnd.randint(8, 400))
        for _ in range(rnd.randint(1, 9)):
            c = list(w)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                c[rnd.randrange(len(c))] = rnd.choice(vocab)
            rows.append(" ".join(c))
    w = words(300)
    for i in range(60):  # a large group of near copies, some beyond the threshold of one another
        c = list(w)
        for _ in range(rnd.randint(0, 6)):
            c[rnd.randrange(len(c))] = rnd.choice(vocab)
        rows.append(" ".join(c))
    w = words(200)
    for i in range(12):  # a chain
        w = w[7:] + words(7)
        rows.append(" ".join(w))
    rows += ["", "", "!!!", "one two", "One  two.", "a b c d e " * 30, "a b c d e " * 28, "a b c d e " * 10, rows[0], rows[3], None, None]
    rnd.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.fixture(params=[500, 3])
def split(request, monkeypatch):
    """Look-ups as they are, and with every value of more than three rows split."""
    monkeypatch.setattr(D, "SPLIT", request.param)


def test_classes(frame, split):
    rows = documents()
    want = classes(rows)
    got = {r.doc_id: r.class_id for r in D.near_duplicates(frame([*rows, rows[0]])).collect()}
    assert got == want
    assert len(set(want.values())) < len(want) - 50


def test_empty(frame):
    assert D.near_duplicates(frame([(1, "a")]).where("false")).count() == 0
    assert [tuple(r) for r in D.near_duplicates(frame([(4, None)])).collect()] == [(4, 4, 4)]


def by_text(rows, threshold=0.8):
    """For every row the rows of its class; null texts stand alone."""
    sets = [runs(t) for _, t in rows]
    near = lambda i, j: rows[i][1] is not None and rows[j][1] is not None and (rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= threshold)
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(i, j):
                of = [of[j] if x == of[i] else x for x in of]
    return [[j for j in range(len(rows)) if of[j] == of[i]] for i in range(len(rows))]


def test_missing_and_shared_ids(frame, split):
    rnd = random.Random(3)
    rows = [(i if rnd.random() < 0.5 else None if rnd.random() < 0.6 else 7, t) for i, t in documents() if len(t or "") < 900]
    rows += [(None, "x y z a b c d"), (None, "x y z a b c d"), (None, None), (None, None), (-(1 << 63), rows[0][1]), ((1 << 63) - 1, "p q r s t u"), (None, "p q r s t u")]
    order = lambda i: (i is None, i or 0)
    members = by_text(rows)
    want = [(i, i if t is None else min((rows[j][0] for j in m), key=order)) for (i, t), m in zip(rows, members)]
    got = [(r.doc_id, r.class_id) for r in D.near_duplicates(frame(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text) for r in D.keep_one(frame(rows)).collect()]
    nothing = rows.count((None, None))
    assert kept.count((None, None)) == nothing > 1 and set(kept) <= set(rows) and len(set(kept)) == len(kept) - nothing + 1
    stay = {(i, t) for i, t in kept}
    for (i, t), m in zip(rows, members):
        if t is not None:
            assert sum(r in stay for r in {rows[j] for j in m}) == 1
            assert {rows[j][0] for j in m if rows[j] in stay} == {min((rows[j][0] for j in m), key=order)}


def test_similarities_at_the_bounds(frame, split):
    w = [f"w{i}" for i in range(60)]
    text = lambda a, b: " ".join(w[a:b])
    rows = [(1, text(0, 13)), (2, text(0, 12)), (3, text(1, 13)), (4, text(20, 32)), (5, text(21, 33)), (6, text(19, 31))]  # 0.8 apart are linked, 0.6 only through a third
    got = {r.doc_id: r.class_id for r in D.near_duplicates(frame(rows)).collect()}
    assert got == classes(rows) and got[3] == 1 and got[5] == 5


def test_a_very_long_text(frame):
    rnd = random.Random(8)
    w = [f"{rnd.randrange(16**5):x}" for _ in range(150_000)]
    changed = [x if rnd.random() > 0.01 else "new" for x in w]
    other = [x if rnd.random() > 0.2 else "new" for x in w]
    got = {r.doc_id: r.class_id for r in D.near_duplicates(frame([(3, " ".join(w)), (2, " ".join(changed)), (1, " ".join(other))])).collect()}
    assert got == {3: 2, 2: 2, 1: 1}


def test_agreement_is_weighted_jaccard():
    rnd = np.random.default_rng(2)
    a = {i: int(rnd.integers(1, 6)) for i in range(300)}
    b = {i: int(rnd.integers(1, 6)) for i in range(60, 340)}
    texts = [" ".join(f"w{i}" for i, n in x.items() for _ in range(n)) for x in (a, b)]
    owner, cells = D.elements(texts, 1)
    k = 6000
    s = D.darts(owner, cells, 2, k)
    union, both = sum(max(a.get(i, 0), b.get(i, 0)) for i in range(340)), sum(min(a.get(i, 0), b.get(i, 0)) for i in range(340))
    assert abs((s[0] == s[1]).mean() - both / union) < 0.03


def test_fractions_of_a_cell():
    cells = np.arange(1, 401, dtype=np.uint64)
    owner = np.repeat([0, 1], 400)
    limit = np.r_[np.ones(400), np.full(400, 0.5)]
    s = D.darts(owner, np.r_[cells, cells], 2, 6000, limit)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.03
