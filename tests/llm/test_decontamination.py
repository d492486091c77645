import random
import re

from folium.llm import decontamination as D


def brute(docs, items, t=0.8):
    def runs(text, k):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        return w, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = []
    for d, text in docs:
        found, best = [], 0.0
        for i, it in items:
            w, _ = runs(it, 5)
            k = min(5, len(w))
            if not k:
                continue
            q = runs(it, k)[1]
            share = len(q & runs(text, k)[1]) / len(q)
            if share >= t:
                found.append(i)
                best = max(best, share)
        out.append((d, bool(found), len(found), sorted(found), best))
    return sorted(out, key=str)


def case():
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(600)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 13, 17, 21, 30, 36, 37, 52, 68, 69, 120, 14, 59, 300] * 3)]
    items += [(100, ""), (101, None), (102, items[11][1]), (103, "a b c d e " * 10)]
    docs = []
    for i in range(150):
        w = words(rnd.choice([0, 3, 20, 100, 2000]))
        for _ in range(rnd.randint(0, 3)):
            it = rnd.choice(items[: 21 * 3])[1].split()
            if len(it) > 12 and rnd.random() < 0.5:
                it[0] = "edited" if rnd.random() < 0.5 else it[0]
                it[rnd.randrange(3)] = "Changed"
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() + rnd.choice(["", ",", "\n"]) for x in it] if rnd.random() < 0.3 else it
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), docs[3], (502, "a b c d e " * 12), (503, items[20][1]), (504, " ".join(words(30000)))]
    return docs, items


def test_against_brute_force(spark, frame):
    docs, items = case()
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, extra string")
    want = brute(docs, items)
    assert sum(w[1] for w in want) > 40
    for size in (D.BLOCK_BYTES, 60_000):  # one block, several blocks
        got = [(r.doc_id, r.contaminated, r.n_items, r["items"], r.containment) for r in D.find_items(frame(docs), bench, block_bytes=size).collect()]
        assert sorted(got, key=str) == want
        kept = sorted(r.doc_id for r in D.drop_contaminated(frame(docs), bench, block_bytes=size).collect())
        assert kept == sorted(w[0] for w in want if not w[1])


def test_empty(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.find_items(frame([(1, "a b c d e f")]), none).collect()] == [False]
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.find_items(frame([(1, "a")]).where("false"), some).count() == 0


def test_rows_and_items_without_an_id(spark, frame):
    _, items = case()
    lost = " ".join(items[12][1].split()[::-1])
    bench = spark.createDataFrame([*items[:60], (None, items[8][1]), (None, lost), (None, None)], "item_id long, text string")
    docs = frame([(None, f"x y z {lost} q"), (1, lost), (None, None), (2, items[8][1]), (2, items[9][1]), (2, items[9][1])])
    for size in (D.BLOCK_BYTES, 20_000):
        got = sorted(((r.doc_id, r.n_items, r["items"]) for r in D.find_items(docs, bench, block_bytes=size).collect()), key=str)
        same = [i for i, t in items[:60] if t == items[8][1]]
        assert got == sorted([(None, 1, [None]), (1, 1, [None]), (None, 0, []), (2, len(same) + 1, [*same, None]), (2, 1, [9]), (2, 1, [9])], key=str)
        assert sorted(r.text or "" for r in D.drop_contaminated(docs, bench, block_bytes=size).collect()) == [""]


def test_the_index_is_as_large_as_its_blocks_allow():
    import pickle
    import random

    rnd = random.Random(4)
    words = [f"{rnd.randrange(16**6):x}" for _ in range(9000)]
    for n in (4, 5, 40, 300):
        items = [(i, " ".join(rnd.choices(words, k=n))) for i in range(3000)]
        allowed = 3 * sum(len(t) for _, t in items) + len(items) * (D.ITEM_BYTES + 12 * D.HASHES)
        assert len(pickle.dumps(D.Index(items))) < allowed + 64 * D.FILTER
