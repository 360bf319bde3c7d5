"""Byte-level BPE vocabularies read from tokenizer files, and the split of texts into pre-tokens.

Files stay where they are: each Python worker reads the one it is given once. Words repeat a lot, so workers keep what
they found for them in a table of bounded size, which is emptied when full.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import regex

#: Fixed value: the pattern of byte-level BPE pre-tokens, of which the files' libraries and their users share one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's table of words, its bytes, and the signs of the longest word that is kept: longer ones hardly come again.
TABLE, BYTES, KEEP = 600_000, 256_000_000, 256
#: Signs from which on a text is looked up in segments of about that many.
SEGMENT = 1 << 19


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs for themselves, then the
    other bytes in order from sign 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """ids: bytes of a token to its id; merges: (left id, right id) in rank order; special: whole strings to ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        signs = byte_signs()
        as_bytes = lambda token: bytes(signs[c] for c in token)
        self.special = {x["content"]: x["id"] for x in raw["added_tokens"]}
        vocab = {k: v for k, v in raw["model"]["vocab"].items() if k not in self.special}
        self.ids = {as_bytes(k): v for k, v in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {as_bytes(a) + as_bytes(b): k for k, (a, b) in enumerate(pairs)}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * self.size
        for k, v in chain(self.ids.items(), ((k.encode(), v) for k, v in self.special.items())):
            self.tokens[v] = k
        self._pieces = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def parts(self, text: str) -> list[str | int]:
        """The text's pre-tokens in order, with the ids of special strings between them."""
        if not self._special or not self._special.search(text):
            return self._pieces.findall(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._pieces.findall(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._pieces.findall(text[at:])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Table:
    """What `find` gives for strings, kept for up to TABLE words and about BYTES bytes, for texts cut at blanks.

    A blank before another sign than white space always begins a pre-token, and what stands before it isn't looked at
    again. So a text can be cut there and its words, each with the blank before it, be found by themselves. Texts where
    white space or the end follows a blank, and those with special strings, are given to `find` whole.
    """

    def __init__(self, vocab: Vocabulary, find: Callable[[list[str]], list], join: Callable[[list], object]):
        self.special, self.find, self.join, self.known, self.first, self.bytes = list(vocab.special), find, join, {}, {}, 0

    @staticmethod
    def weight(words: dict) -> int:
        """Bytes of entries, about: their share of the table, the words, and what is found for them, which their length bounds."""
        return 200 * len(words) + 8 * sum(map(len, words))

    def _learn(self, table: dict, words: set[str], before: str) -> dict:
        """What is found for the words; the table keeps those that aren't long."""
        plain = [w for w in words if w and not w[0].isspace()]
        found = dict(zip(plain, self.find([before + w for w in plain]), strict=True))
        kept = found if max(map(len, plain), default=0) <= KEEP else {w: x for w, x in found.items() if len(w) <= KEEP}
        table.update(kept)
        self.bytes += self.weight(kept)
        return found

    def _make_room(self, cut: list[list[str]]) -> None:
        """Tables over their size keep what the texts at hand use."""
        if len(self.known) > TABLE or self.bytes > BYTES:
            self.known = {w: self.known[w] for w in set(chain.from_iterable(cut)) if w in self.known}
            self.bytes = self.weight(self.known) + self.weight(self.first)
        if len(self.first) > TABLE // 8 or self.bytes > BYTES:
            self.first, self.bytes = {}, self.weight(self.known)

    def _some(self, texts: list[str], after_blank: bool = False) -> Iterator:
        """Entries of texts; with after_blank, of texts that each go on behind a blank, which belongs to them."""
        cut = [t.split(" ") for t in texts]
        self._make_room(cut)
        entries, missing, new, new_first = [], [], set(), set()
        for c in cut:
            e = list(map(self.known.get, c))
            if not after_blank:
                e[0] = self.first.get(c[0])
            m = [i for i, x in enumerate(e) if x is None]
            if m and m[0] == 0 and not after_blank:
                new_first.add(c[0])
            new.update(c[i] for i in m if i or after_blank)
            entries.append(e)
            missing.append(m)
        found = self._learn(self.known, new, " ")
        found_first = self._learn(self.first, new_first, "")
        for t, c, e, m in zip(texts, cut, entries, missing, strict=True):
            for i in m:
                e[i] = (found if i or after_blank else found_first).get(c[i])
            whole = any(e[i] is None for i in m) or any(s in t for s in self.special)
            yield self.find([" " * after_blank + t])[0] if whole else self.join(e)

    def _long(self, text: str):
        """The entries of a long text, found segment by segment and joined; segments end before a blank that begins a word."""
        found, at, blank = [], 0, False
        while True:
            end = text.find(" ", at + SEGMENT)
            while 0 <= end and (end + 1 == len(text) or text[end + 1].isspace()):
                end = text.find(" ", end + 1)
            found += self._some([text[at : end if end >= 0 else None]], blank)
            if end < 0:
                return self.join(found)
            at, blank = end + 1, True

    def look_up(self, texts: list[str]) -> Iterator:
        """For each text what `join` makes of its entries. Texts are taken some 256 KB at a time, long ones in segments."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > 2 * SEGMENT and not any(" " in s for s in self.special):
                yield self._long(texts[at])
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 18):
                size += len(texts[end])
                end += 1
            yield from self._some(texts[at:end])
            at = end
