"""Exact token counts at every prefix of a text, by dynamic programming over the merges of a tokenizer.

A BPE encoding is valid exactly if each pair of neighbours is what the tokenizer itself makes of
the two put together. So the last token of a prefix is the one that fits behind the last token of the
shorter prefix it leaves, and one pass over a word gives the count at each of its prefixes. Words are
independent of each other; a text's counts are the sums of the changes from one prefix to the next.
The changes are stored, one signed byte per code point, and truncation or budget questions are answered from
the store without encoding again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Words kept by each Python worker. More only save time; the counts are the same.
CACHED_WORDS = 500_000
CACHED_FITS = 600_000
#: Characters that are cut into words at a time.
_GROUP_CHARS = 2_000_000
#: Longer words are not cached.
_LONG_WORD = 64

# The character classes of the tokenizer's patterns for code points below U+0250.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts with other characters are cut into words by the tokenizer library itself.
UNUSUAL = re.compile(r"[^\x00-ɏ‐-‧‰-⁞€]")
_WORD = re.compile(
    rf"(?:'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+) ?|[{_SPACE}]+"
)
_BLANK = re.compile(rf"[{_SPACE}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d) ?")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class PrefixCounter:
    """Counts of one tokenizer file: BPE with word ends, text lower-cased, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = set(model["vocab"])
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t) for t in self.vocab)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.splits: dict[str, tuple[str, str] | tuple[()] | None] = {}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def last_merge(self, token: str) -> tuple[str, str] | None:
        """The two parts that the tokenizer joins last to get *token*; None for a single symbol."""
        if token not in self.splits:
            cut = len(token) - len(self.end) if self.end and token.endswith(self.end) else len(token)
            symbols = [*token[: cut - 1], token[cut - 1 :]] if cut else [token]
            while len(symbols) > 2:
                ranks = [self.rank.get(p, 1 << 30) for p in zip(symbols, symbols[1:])]
                at = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[at] == 1 << 30:
                    break
                symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            whole = len(symbols) == 2 and tuple(symbols) in self.rank
            self.splits[token] = tuple(symbols) if whole else None if len(symbols) == 1 else ()
        return self.splits[token]

    def fit(self, left: str, token: str) -> bool:
        """Whether the tokenizer leaves *left* and *token* as they are when they stand side by side.

        Both are taken apart from the latest merge back. If the parts that touch could be joined
        by a merge that comes before the one just undone, the tokenizer would have joined them.
        """
        own = self.last_merge(token)
        if own == ():  # never the result of merges
            return False
        if not left:
            return True
        other, limit = self.last_merge(left), 1 << 30
        while True:
            joint = self.rank.get((left, token), 1 << 30)
            if joint < limit:
                return False
            a = self.rank[other] if other else -1
            b = self.rank[own] if own else -1
            if a < 0 and b < 0:
                return True
            if a > b:  # the right one is older: at equal rank the left pair goes first
                limit, left = a, other[1]
                other = self.last_merge(left)
            else:
                limit, token = b + 1, own[0]
                own = self.last_merge(token)

    def word_counts(self, words: list[str]) -> Iterator[list[int]]:
        """For each of the sorted *words* the count of word[:i] as a word of its own, i from 1; the last is the word's own.

        A word that begins as the one before it takes over the state of the common prefix.
        """
        end, vocab, longest, fits = self.end, self.vocab, self.longest, self.fits
        text, tails, counts, ends = "", [""], [0], []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            before, text = text, "".join([self.letters[b] for b in raw])
            n = same = min(len(before), len(text))
            for same in range(n + 1):
                if same == n or before[same] != text[same]:
                    break
            n = len(raw)
            del tails[same + 1 :], counts[same + 1 :], ends[same:]
            for i in range(same + 1, n + 1):
                low = i - longest if i > longest else 0
                for j in range(low, i):
                    token = text[j:i]
                    if token in vocab:
                        key = (tails[j], token)
                        known = fits.get(key)
                        if known is None:
                            known = fits[key] = self.fit(*key)
                        if known:
                            tails.append(token)
                            counts.append(counts[j] + 1)
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                ends.append(0)
                if i < n and raw[i] & 0xC0 == 0x80:  # inside a code point
                    continue
                for j in range(low, i):
                    token = text[j:i] + end
                    if token in vocab:
                        key = (tails[j], token)
                        known = fits.get(key)
                        if known is None:
                            known = fits[key] = self.fit(*key)
                        if known:
                            ends[-1] = counts[j] + 1
                            break
            yield [c for c in ends if c]

    def _learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Adds the changes that each code point of each piece (a word, perhaps with the space behind it) makes."""
        if len(self.fits) > CACHED_FITS:
            self.fits.clear()
        words = {p: "" if _BLANK.fullmatch(p) else p.removesuffix(" ") for p in pieces}
        tails = {p: words[p][1:] for p in pieces if _CONTRACTION.fullmatch(p)}
        order = sorted({*words.values(), *tails.values()} - {""})
        found = dict(zip(order, self.word_counts(order)))
        for p, word in words.items():
            own = found.get(word, [])
            if p in tails:  # cut short, a contraction is an apostrophe and a word
                own = [own[0], *[own[0] + c for c in found[tails[p]][:-1]], own[-1]]
            changes = [(b - a) & 0xFF for a, b in zip([0, *own], own)]
            known[p] = bytes(changes + [0] * (len(p) - len(word)))

    def pieces(self, text: str) -> list[str]:
        """A normal text without special tokens, cut into words (with a space behind them, if any) and white space."""
        if not UNUSUAL.search(text):
            return _WORD.findall(text)
        out, at = [], 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            out += [text[at:a]] * (a > at) + [text[a:b]] * (b > a)
            at = b
        return out + [text[at:]] * (at < len(text))

    def changes(self, parts: list[list[str]]) -> list[bytes]:
        """The changes of texts that are given in pieces."""
        missing = list({p for part in parts for p in part if p not in self.cache})
        if len(self.cache) + len(missing) > CACHED_WORDS:
            self.cache.clear()
            missing = list({p for part in parts for p in part})
        long = {p for p in missing if len(p) > _LONG_WORD}
        self._learn([p for p in missing if p not in long], self.cache)
        known = self.cache
        if long:
            known = dict(known)
            self._learn(sorted(long), known)
        return [b"".join([known[p] for p in part]) for part in parts]

    def normal(self, text: str) -> str:
        """The text as its words see it: composed and lower-cased, character by character."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def stores(self, texts: list[str | None]) -> list[bytes]:
        """The changes at all code points of each normal text; a special token counts one where it is complete.

        Cut short, a special token is ordinary text behind the ordinary text before it.
        """
        parts, owner, before = [], [], ""
        for k, text in enumerate(texts):
            for i, part in enumerate(self._special.split(text or "") if self._special else [text or ""]):
                if i % 2 == 0:
                    before = self.normal(part)
                parts.append(self.pieces(before + part[:-1] if i % 2 else before))
                owner.append((k, len(before) if i % 2 else None))
        out: list[list[bytes]] = [[] for _ in texts]
        for (k, skip), made in zip(owner, self.changes(parts)):
            if skip is not None:
                made = made[skip:]
                made += bytes([(1 - int(np.frombuffer(made, np.int8).astype(np.int64).sum())) & 0xFF])
            out[k].append(made)
        return [b"".join(x) for x in out]


def counts(store: bytes) -> np.ndarray:
    """The token count of each prefix, from none to all code points."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(store, np.int8), dtype=np.int64)))


def longest_prefix(store: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most *budget* tokens."""
    return int(np.flatnonzero(counts(store) <= budget)[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _in_bounds(texts: pd.Series) -> Iterator[list[str | None]]:
    """The texts in groups of about ``_GROUP_CHARS`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > _GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def prefix_store(text: Column, path: str) -> Column:
    """The store of each text as binary; null counts as empty, whose store is empty."""

    @pandas_udf("binary")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for batch in batches:
            yield pd.Series([s for group in _in_bounds(batch) for s in own.stores(group)], dtype=object)

    return build(text)


def truncation(text: Column, path: str, budget: int) -> Column:
    """A struct ``n_tokens, over_limit, fitting_chars`` from the store of each text: its count, whether that
    exceeds *budget*, and the code points of its longest prefix within it. Null counts as empty."""

    @pandas_udf("n_tokens long, over_limit boolean, fitting_chars long")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in batches:
            rows = []
            for group in _in_bounds(batch):
                for store in own.stores(group):
                    at = counts(store)
                    total = int(at[-1])
                    fitting = len(at) - 1 if total <= budget else int(np.flatnonzero(at <= budget)[-1])
                    rows.append((total, total > budget, fitting))
            yield pd.DataFrame(rows, columns=["n_tokens", "over_limit", "fitting_chars"])

    return answer(text)
