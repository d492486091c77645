import hashlib

import pytest
from test_decontamination import brute
from test_near import classes
from test_quality import corpus as prose
from test_repeats import documents as repeats

import corpus_pipeline
from folium.llm import quality

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    words, labels = prose(900)
    rows = [(i, t) for i, t in words] + [(5000 + k, t) for k, (_, t) in enumerate(repeats(8)) if t and len(t) > 40] + [(9000, None), (9001, "")]
    rows += [(7000 + i, t + " end") for i, t in words[:40]]
    passage = max((t for i, t in words[:60] if i % 5), key=len)[:450]
    rows += [(6000 + i, t[::-1] + " é" + passage + "é " + t[7:]) for i, t in words[100:160] if i % 5 and len(t) > 300]
    items = [(1, " ".join(words[6][1].split()[:40])), (2, " ".join(words[11][1].split()[3:12])), (3, "never seen words in any of them")]
    docs = [(i, t, "en", "a", 0, f"x{i}") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, more string").select(*NAMES).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def text_without_repeats(rows, n=200):
    from collections import Counter

    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[a : a + n] for b in raw.values() for a in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for a in range(len(b) - n + 1):
            if count[b[a : a + n]] > 1:
                gone[a : a + n] = [True] * n
        kept, at = [], 0
        for c in b.decode():
            k = len(c.encode())
            if not all(gone[at : at + k]):
                kept.append(c)
            at += k
        out[i] = "".join(kept)
    return out


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    given = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, folder).write.parquet(f"{folder}/out{k}")
        got = spark.read.parquet(f"{folder}/out{k}")
        had = {r.doc_id: r.text for r in given.collect()}
        if k < 4:
            assert got.columns == NAMES
            now = {r.doc_id: r.text for r in got.collect()}
            assert got.count() == len(now)
        if name == "quality":
            good = {r.doc_id for r in quality.score_documents(given, quality.train(given, labels)).where("predicted = 1").collect()}
            assert now == {i: t for i, t in had.items() if i in good} and len(now) < len(had)
        elif name == "near_dedup":
            of = classes(list(had.items()))
            assert now == {i: t for i, t in had.items() if of[i] == i} and len(now) < len(had)
        elif name == "suffix_dedup":
            assert now == text_without_repeats(list(had.items())) and now != had
            assert all(r.n_chars == len(r.text) for r in got.collect())
        elif name == "decontamination":
            bad = {d for d, hit, *_ in brute(list(had.items()), bench) if hit}
            assert now == {i: t for i, t in had.items() if i not in bad} and bad
        else:
            from test_tokens import RANKS, base64, tiktoken

            with open(RANKS, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            found = {r.doc_id: r for r in got.collect()}
            assert found.keys() == had.keys()
            for i, t in had.items():
                assert list(found[i].ids) == own.encode_ordinary(t or "") and found[i].n_tokens == len(found[i].ids)
                assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        given = got
    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {r.doc_id: list(r.ids) for r in given.collect()}


def test_empty_table(spark, folder, tmp_path_factory):
    other = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{other}/{name}.parquet")
    assert corpus_pipeline.run(spark, other).count() == 0
