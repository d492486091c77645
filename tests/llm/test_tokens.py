import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folium.llm import byte_bpe, token_counts

WORD = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello, World's 123!!  \n\n x", "ÀÉß ñandú Ǆ İstanbul", "日本語テキスト と English", "a" * 5000, "ab" * 700, "<|endoftext|> x <|startoftext|>", "\x1c\x1f y\x85z​", "éä", "  \t ", "ΑΣ ΟΔΟΣ", "🙂🙃 ok", "1234567890 ½²", " x　y"]
anything = st.text(max_size=60) | st.text(alphabet="abcdeé ñ'st.!\n 12", max_size=200)


counter = token_counts.Counter(WORD)
lib = Tokenizer.from_file(WORD)


def size(text):
    return len(lib.encode(text, add_special_tokens=False).ids)


marked = st.lists(anything | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "’", "—", "Ω", " "])).map("".join)


@settings(max_examples=400, deadline=None)
@given(anything | marked)
def test_counts_like_the_library(text):
    assert counter.count(text) == int(counter.positions(text)[2][-1]) == size(text)


@settings(max_examples=150, deadline=None)
@given(anything | marked, st.integers(0, 30))
def test_longest_prefix_of_any_text(text, budget):
    shown = counter.spans(text)[0]
    specials = [m.span() for m in counter.apart.finditer(shown)]
    fits = [n for n in range(len(shown) + 1) if not any(a < n < b for a, b in specials) and (size(shown[:n]) <= budget)]
    n = counter.longest_prefix(text, budget)
    assert size(shown[:n]) <= budget or n == 0
    assert shown[: max(fits)].rstrip() == shown[:n].rstrip()


@settings(max_examples=300, deadline=None)
@given(anything)
def test_ids_like_the_library(tik, text):
    encoder = byte_bpe.load(RANKS, P.PATTERN)
    ids = encoder.encode(text)
    assert ids == tik.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(tik, text):
    test_counts_like_the_library.hypothesis.inner_test(text)
    test_ids_like_the_library.hypothesis.inner_test(tik, text)


def test_prefixes_inside_words():
    for word in ("thinking", "antidisestablishmentarianism", "xqzzv", "reouha", "licensed", "!!!???", "straße", "日本語", "ab" * 60):
        got = counter.word_counts(token_counts.byte_letters(word))
        assert [got[len(word[:i].encode()) - 1] for i in range(1, len(word) + 1)] == [size(word[:i]) for i in range(1, len(word) + 1)]


def test_every_budget():
    text = "unbelievable thinking of reouha the “edthings”, and Ωmega of it."
    shown = counter.spans(text)[0]
    for budget in range(size(text) + 1):
        assert shown[: counter.longest_prefix(text, budget)].rstrip() == shown[: max(i for i in range(len(shown) + 1) if size(shown[:i]) <= budget)].rstrip()


def test_queries(spark, frame, tik):
    docs = frame([(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (3, TEXTS[3])])
    cuts = {r.doc_id: r.fitting_chars for r in token_counts.count_tokens(docs, WORD, limit=10).collect()}
    assert all(cuts[i] == (counter.longest_prefix(t, 10) if size(t) > 10 else None) for i, t in enumerate(TEXTS)) and any(cuts.values())
    rows = sorted(tuple(r) for r in token_counts.count_tokens(docs, WORD, limit=10).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = []
    for i, t in [*enumerate(TEXTS), (50, ""), (3, TEXTS[3])]:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 10))
    assert rows == sorted(want)
    rows = sorted(tuple(r) for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in [*enumerate(TEXTS), (50, ""), (3, TEXTS[3])]:
        ids = tik.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    assert rows == sorted(want)
    empty = docs.where("false")
    assert token_counts.count_tokens(empty, WORD).count() == byte_bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
