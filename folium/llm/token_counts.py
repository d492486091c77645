"""Exact token counts by dynamic programming over prefixes.

The tokenizer drops white space, lower-cases and merges inside words only, so the count of a prefix that ends between two
words is the count of the one before plus that of a word. Inside a word, one pass finds for every prefix its last token: of
the tokens that end there the only one which stays apart from the last token of what stands before it (two tokens stay
apart if merging the letters of both gives the two again). `word_counts` stores the count of every prefix of a word,
`prefix_counts` the sums at the words' ends, `positions` the sums of a whole text; totals, budgets and truncation are
look-ups in them, and nothing is encoded a second time.

Words of a text come from a pattern where its characters are ones on which Unicode tables of libraries agree; elsewhere,
and around the tokenizer's special strings, the library's own normaliser and splitter give them. Counts are from the same
pass in both cases. Word counts are kept in a table of bounded size for each Python worker.

Defined cases: null text = empty, 0 bytes and 0 tokens; white space has no tokens; a special string is one token; repeated
rows each give a row, as do rows without an id; very long texts and words are taken whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folium.llm.arrow import mapped, over

LIMIT = 2048
TABLE_WORDS = 600_000
TABLE_PAIRS = 400_000
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
UNSURE = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
#: Words that are their own byte letters.
PLAIN = regex.compile(r"[!-~]+")
#: White space of texts that have none but ASCII's, which the normaliser makes one space.
BLANKS = regex.compile(r"[\t\n\r ]+")
#: Before words of the table that are in byte letters.
SPELLED = "\0"
END = "</w>"
#: Stands for the end of a word where tokens are searched for; no byte letter is it.
STOP = "\0"
NEVER = 1 << 60


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Counter:
    """Counts tokens of whole texts, of their prefixes, and the longest prefix within a budget."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS) -> None:
        self.lib = load(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(json.loads(self.lib.to_str())["model"]["merges"])}
        found = self.lib.get_vocab(with_added_tokens=False)
        self.longest = max(len(_letters(t)) for t in found)
        #: Tokens that merging their own letters gives.
        self.tokens = {t for t in found if len(_letters(t)) == 1 or merge(_letters(t), self.ranks) == [t]}
        self.parts = {a + b: (a, b) for a, b in self.ranks}
        self.edges: tuple[dict, dict] = ({}, {})
        #: For each token, whether it stays apart from what stands before it.
        self.before: dict[str, dict[str, bool]] = {t: {} for t in self.tokens}
        self.pairs = 0
        #: Finds the tokens that end at each place of a word, the longest first.
        self.finder = ahocorasick.Automaton()
        for t in self.tokens - {END}:
            key = t[: -len(END)] + STOP if t.endswith(END) else t
            self.finder.add_word(key, (len(key), t, self.before[t]))
        self.finder.make_automaton()
        self.table: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.table_words = table_words

    # inside a word

    def _edge(self, piece: str, side: int) -> list[tuple[str, int]]:
        """The pieces that stand at the right (1) or left (0) edge of a token while its letters are merged, each with the rank at which it becomes the next."""
        found = self.edges[side].get(piece)
        if found is None:
            part = self.parts.get(piece)
            if part is None:
                found = [(piece, NEVER)]
            else:
                inner = self._edge(part[side], side)
                found = [*inner[:-1], (part[side], self.ranks[part]), (piece, NEVER)]
            self.edges[side][piece] = found
        return found

    def _fits(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when their letters are merged: no pair over the border is ever next, of equal ranks the leftmost being first."""
        got = self.before[b].get(a)
        if got is None:
            if self.pairs == TABLE_PAIRS:
                self.pairs = 0
                for known in self.before.values():
                    known.clear()
            self.pairs += 1
            xs, ys, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
            while True:
                (x, grow_x), (y, grow_y) = xs[i], ys[j]
                rank = self.ranks.get((x, y), NEVER)
                if rank < grow_x and rank <= grow_y:
                    got = False
                elif grow_x == grow_y == NEVER:
                    got = True
                elif grow_x <= grow_y:
                    i += 1
                    continue
                else:
                    j += 1
                    continue
                break
            self.before[b][a] = got
        return got

    def _ended(self, word: str, i: int, last: list[str], count: list[int]) -> int:
        """The count of word[:i] taken as a word, from the last tokens and counts of shorter prefixes."""
        for j in range(max(0, i - self.longest), i):
            if (p := word[j:i] + END) in self.tokens and (not j or self._fits(last[j], p)):
                return count[j] + 1
        raise ValueError(f"no token ends {word[:i]!r}")

    def prefixes(self, word: str) -> tuple[list[str], list[int]]:
        """For a word of byte letters: the last token and the token count of each prefix that goes on, from length 0 on; with STOP behind it also those of the whole word."""
        fits, last, count, done = self._fits, [""], [0], -1
        for end, (size, piece, before) in self.finder.iter(word):
            if end == done:
                continue
            j = end + 1 - size
            if j:
                ok = before.get(last[j])
                if not (fits(last[j], piece) if ok is None else ok):
                    continue
            last.append(piece)
            count.append(count[j] + 1)
            done = end
        if len(last) != len(word) + 1:
            raise ValueError(f"no token ends at a place of {word!r}")
        return last, count

    def word_counts(self, word: str) -> list[int]:
        """For a word of byte letters: the token count of each prefix taken as a word, from length 1 on."""
        last, count = self.prefixes(word)
        return [self._ended(word, i, last, count) for i in range(1, len(word) + 1)]

    def word_count(self, word: str) -> int:
        return 1 if word + END in self.tokens else self.prefixes(word + STOP)[1][-1]

    # words of a text

    def plain(self, text: str) -> str | None:
        """The text in normal form and small letters, or None where the library must split it."""
        if UNSURE.search(text) or any(s in text for s in self.special):
            return None
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.lower()

    def words(self, plain: str) -> list[str]:
        return WORD.findall(plain)

    def spans(self, text: str) -> tuple[str, list[tuple[str | None, int, int]]]:
        """The normalised text, and its words in byte letters with where they begin and end in it; a special string is a word without letters."""
        shown, at, out = [], 0, []
        for k, part in enumerate(self.apart.split(text) if self.apart else [text]):
            special = k % 2 == 1
            part = part if special else self.lib.normalizer.normalize_str(part)
            found = [(None, (0, len(part)))] if special else self.lib.pre_tokenizer.pre_tokenize_str(part)
            out += [(w, at + a, at + b) for w, (a, b) in found]
            shown.append(part)
            at += len(part)
        return "".join(shown), out

    def learn(self, words: set[str]) -> None:
        """Puts words into the table; a full one becomes the older one, whose words come back when they are met again."""
        if len(self.table) + len(words) > self.table_words:
            self.table, self.older = {}, self.table
        table, older = self.table, self.older
        for w in words:
            n = older.get(w)
            table[w] = self.word_count(w[1:] if w[0] == SPELLED else w if PLAIN.fullmatch(w) else byte_letters(w)) if n is None else n

    def prefix_counts(self, words: list[str]) -> np.ndarray:
        """Token counts up to each word's end, 0 first; a word is looked up once."""
        counts = list(map(self.table.get, words))
        if None in counts:
            self.learn({w for w, n in zip(words, counts) if n is None})
            table = self.table
            counts = [table[w] if n is None else n for w, n in zip(words, counts)]
        out = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        return out

    def positions(self, text: str) -> tuple[str, list[tuple[str | None, int, int]], np.ndarray]:
        """The normalised text, its words, and the token counts up to each word's end, 0 first."""
        shown, spans = self.spans(text)
        sums = self.prefix_counts([w if PLAIN.fullmatch(w) else SPELLED + w for w, _, _ in spans if w is not None])
        if any(w is None for w, _, _ in spans):
            own = iter(np.diff(sums).tolist())
            sums = np.cumsum([0, *(1 if w is None else next(own) for w, _, _ in spans)])
        return shown, spans, sums

    def count(self, text: str) -> int:
        plain = self.plain(text)
        return int((self.positions(text)[2] if plain is None else self.prefix_counts(self.words(plain)))[-1])

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the normalised text that fit in budget tokens, cut at any character but inside special strings."""
        plain = self.plain(text)
        if plain is not None:
            return self.fitting(plain, self.prefix_counts(self.words(plain)), budget)
        shown, spans, sums = self.positions(text)
        if sums[-1] <= budget:
            return len(shown)
        k = int(np.searchsorted(sums, budget, side="right")) - 1
        word, a, b = spans[k]
        return a + (0 if word is None else self._inside(word, shown[a:b], budget - int(sums[k])))

    def fitting(self, plain: str, sums: np.ndarray, budget: int) -> int:
        """The same for a text in normal form and small letters, given the token counts up to each word's end."""
        if sums[-1] <= budget:
            return len(BLANKS.sub(" ", plain))
        k = int(np.searchsorted(sums, budget, side="right")) - 1
        found = next(itertools.islice(WORD.finditer(plain), k, None))
        return len(BLANKS.sub(" ", plain[: found.start()])) + self._inside(byte_letters(found[0]), found[0], budget - int(sums[k]))

    def _inside(self, word: str, shown: str, budget: int) -> int:
        """Characters of a word that fit in what is left of a budget."""
        inside = self.word_counts(word)
        return max((n for n in range(1, len(shown)) if inside[len(shown[:n].encode()) - 1] <= budget), default=0)


def _letters(piece: str) -> list[str]:
    """The letters that a token is merged from; the last one of a word has the end with it."""
    if piece.endswith(END) and piece != END:
        cut = piece[: -len(END)]
        return [*cut[:-1], cut[-1] + END]
    return list(piece)


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the leftmost pair of least rank until none is left."""
    while len(parts) > 1:
        rank, i = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(itertools.pairwise(parts)))
        if rank == 1 << 60:
            break
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
    return parts


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def byte_letters(word: str) -> str:
    return "".join(BYTE_LETTERS[b] for b in word.encode())


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_words long, fitting_chars long"
_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and whether the limit is passed, for every whole text; where it is, how many characters of the normalised text fit, else null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_words", pa.int64()), ("fitting_chars", pa.int64())])

    def work(batch: pa.RecordBatch) -> dict:
        counter = _COUNTERS.get(tokenizer)
        if counter is None:
            counter = _COUNTERS[tokenizer] = Counter(tokenizer)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        plain = [counter.plain(t) for t in texts]
        words = [None if p is None else counter.words(p) for p in plain]
        flat = [w for ws in words if ws for w in ws]
        sums = counter.prefix_counts(flat)  # over the whole slice; a text's share is a difference
        tokens, counts, fitting, at = [], [], [], 0
        for t, p, ws in zip(texts, plain, words):
            if ws is None:
                own = counter.positions(t)[2]
            else:
                own = sums[at : at + len(ws) + 1] - sums[at]
                at += len(ws)
            n = int(own[-1])
            tokens.append(n)
            counts.append(len(own) - 1)
            fitting.append(None if n <= limit else counter.longest_prefix(t, limit) if p is None else counter.fitting(p, own, limit))
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens], "n_words": counts, "fitting_chars": fitting}

    return over(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), mapped(work, schema), SCHEMA)
