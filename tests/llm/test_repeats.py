import hashlib
import random
import re
from collections import Counter

import numpy as np

from folium.llm import substring_dedup, suffix_dedup


def brute_words(rows, n=13):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    place = lambda i: -(1 << 63) if i is None else i
    least = {}
    for i, w in texts:
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            least[k] = min(least.get(k, place(i)), place(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if least[tuple(w[a : a + n])] < place(i):
                gone[a : a + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, n=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[a : a + n] for _, b in texts for a in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - n + 1):
            if count[b[a : a + n]] > 1:
                gone[a : a + n] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def documents(seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    words = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passages = [words(rnd.randint(10, 90)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.4 else words(rnd.randint(1, 60)))
        rows.append((i * 3 % 127, rnd.choice([" ", "\n", "\t \n"]).join(parts)))
    rows += [(200 + k, rows[7][1]) for k in range(4)] + [(300, None), (301, ""), (302, "a " * 900), (303, "a " * 300), (304, "z" * 1000), (305, rows[3][1][30:]), (306, "x" + rows[3][1])]
    rows += [rows[5], (205, "no break space here"), (206, words(6000)), (207, "ü" * 150)]
    return rows


def test_words(frame):
    rows = documents()
    got = substring_dedup.remove_repeats(frame(rows), digest=True).selectExpr("doc_id", "n_words", "n_removed", "cast(kept as string)")
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(rows)


def test_bytes(frame):
    rows = documents(4)
    got = suffix_dedup.remove_repeats(frame(rows), digest=True).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "cast(kept as string)")
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes(rows)


def unnamed(seed):
    """Rows of which a third has no id and a third the same one, with ids at both ends of a long."""
    rnd = random.Random(seed)
    rows = [(rnd.choice([i, None, 7]), t) for i, t in documents(seed)]
    text = next(t for _, t in rows if t and len(t) > 900)
    return [*rows, (None, text), (None, text[20:]), ((1 << 63) - 1, text), (-(1 << 63), "before " + text), (None, None), (8, "only here " * 40), (None, "nowhere else " * 40)]


def test_missing_and_shared_ids(frame):
    rows = unnamed(6)
    got = substring_dedup.remove_repeats(frame(rows), digest=True).selectExpr("doc_id", "n_words", "n_removed", "cast(kept as string)")
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(rows)
    got = suffix_dedup.remove_repeats(frame(rows), digest=True).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "cast(kept as string)")
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes(rows)
    lost = [(None, t) for _, t in rows]
    got = substring_dedup.remove_repeats(frame(lost), digest=True).selectExpr("doc_id", "n_words", "n_removed", "cast(kept as string)")
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(lost)


def test_very_long_texts(frame):
    rnd = random.Random(12)
    words = lambda n: " ".join(f"{rnd.randrange(16**5):x}" for _ in range(n))
    a, shared = words(120_000), words(60)
    rows = [(2, a + " " + shared), (3, shared + " " + a[:500_000]), (1, words(30) + " " + shared)]
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    inside = len(a[:500_000].split()) - (a[500_000] != " ")  # the last word is cut
    assert removed[1][1] == 0 and removed[2] == (120_060, 60) and removed[3][1] in (60 + inside, 61 + inside)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(frame(rows)).collect()}
    whole = {i: t.encode() for i, t in rows}
    grams = Counter()
    for t in whole.values():
        grams.update({hash(t[i : i + 200]) for i in range(len(t) - 199)})
    for i, t in whole.items():
        gone = np.zeros(len(t) + 1, int)
        for j in range(len(t) - 199):
            if grams[hash(t[j : j + 200])] > 1:
                gone[j] += 1
                gone[j + 200] -= 1
        assert kept[i] == np.frombuffer(t, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes()


def test_kept_texts_and_empty_tables(frame):
    rows = documents(5)
    docs = frame(rows)
    got = substring_dedup.remove_repeats(docs)
    assert all(len(bytes(r.kept).split()) == r.n_words - r.n_removed for r in got.collect())
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(docs).collect())
    assert substring_dedup.remove_repeats(docs.where("false")).count() == suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_columns_against_pairs():
    rnd = np.random.default_rng(1)
    matrix = rnd.integers(97, 99, (40, 350)).astype(np.uint8)
    for r in range(1, 40):
        if r % 3:
            a, n = int(rnd.integers(0, 150)), int(rnd.integers(150, 349))
            matrix[r, a : a + n] = matrix[r - 1, a : a + n]
        matrix[r, : int(rnd.integers(0, 120))] = suffix_dedup.PAD
    got = suffix_dedup.columns(matrix)
    n = suffix_dedup.LENGTH
    for c in range(350 - n + 1):
        part = [bytes(x[c : c + n]) for x in matrix]
        want = [part.count(p) > 1 and suffix_dedup.PAD not in p for p in part]
        assert got[:, c].tolist() == want
