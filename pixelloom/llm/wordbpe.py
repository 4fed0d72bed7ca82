"""Exact, fast use of a BPE tokenizer file whose merges never cross pre-tokens.

A pre-token's ids don't depend on its surroundings, so a worker runs the library once per distinct pre-token that it remembers. Texts made only of characters whose class every Unicode version agrees on are split by an equivalent
pattern; all others are split by the library itself.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from itertools import chain

import numpy as np

_SAFE = [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x180), *range(0x2010, 0x2028), 0x20AC]
_CLASS = {k: "".join(re.escape(chr(c)) for c in _SAFE if unicodedata.category(chr(c))[0] == k) for k in "LN"}
_CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
_SPLIT = re.compile(rf"[{_CLASS['L']}]+|{_CONTRACTIONS}|[{_CLASS['N']}]|[^\s{_CLASS['L']}{_CLASS['N']}]+")
_SPLIT_ASCII = re.compile(rf"[a-z]+|{_CONTRACTIONS}|[0-9]|[^\sa-z0-9]+")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_UNSAFE = re.compile("[^" + "".join(re.escape(chr(c)) for c in _SAFE) + "]")
#: Bytes that stand for themselves in the byte alphabet; the others are letters from U+0100 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: A byte is a character of the alphabet; white space stays, as it parts words.
_BYTE_ALPHABET = "".join(chr(b) if b in _PLAIN or b == 32 else chr(256 + sum(x not in _PLAIN for x in range(b))) for b in range(256))
#: The split pattern that the fast path reproduces; another tokenizer file is split by the library alone.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Pretokenizer:
    """Splits texts into pre-tokens and encodes pre-tokens as the library does.

    >>> Pretokenizer(path).split("A b's")   # 'a', 'b', "'s"
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        specials = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self._marks = specials
        kinds = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        splits = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self._fast = kinds == ["NFC", "Replace", "Lowercase"] and splits == _KNOWN

    def words(self, text: str) -> list[str] | None:
        """The pre-tokens of a text that the equivalent pattern can split; None: it cannot."""
        if not self._fast or any(m in text for m in self._marks):
            return None
        if text.isascii():
            return None if _CONTROL.search(text) else _SPLIT_ASCII.findall(text.lower())
        return None if _UNSAFE.search(text) else _SPLIT.findall(unicodedata.normalize("NFC", text).lower())

    def _plain(self, text: str) -> list[str]:
        if (found := self.words(text)) is not None:
            return found
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of text in order; special strings are pre-tokens of their own, as the library has them."""
        if any(m in text for m in self._marks):
            out = []
            for i, part in enumerate(self._specials.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


class _Cache:
    """A dict made by `many` from the keys that it lacks. Of two generations the older goes when the younger has `most` entries."""

    def __init__(self, many, most: int):
        self.known: dict = {}
        self._old: dict = {}
        self._many, self._most = many, most

    def of(self, keys) -> dict:
        known = self.known
        every = set(keys)
        if new := every.difference(known):
            if len(known) + len(new) > self._most:
                self._old, self.known = known, (known := {})
                new = every
            old = self._old
            if again := [k for k in new if k in old]:
                known.update(zip(again, map(old.__getitem__, again)))
                new.difference_update(again)
            if new := list(new):
                known.update(zip(new, self._many(new)))
        return known


class IdCache:
    """Ids of whole texts as little-endian uint32 bytes through a bounded cache of pre-tokens, whose ids the library makes once."""

    _of_path: dict[str, IdCache] = {}

    def __init__(self, path: str, most: int = 600_000):
        import json

        from tokenizers import Tokenizer

        self._tokens = Pretokenizer(path)
        self._ids = _Cache(self._encode, most)
        known = self._tokens.library.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(1 + max(self._tokens.library.get_vocab().values()), bool)
        self._ends[[i for t, i in known.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        # the same merges for words of the byte alphabet with spaces between
        self._merges = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))

    @staticmethod
    def shared(path: str) -> IdCache:
        """One for all tasks of a worker process."""
        if path not in IdCache._of_path:
            IdCache._of_path[path] = IdCache(path)
        return IdCache._of_path[path]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens. Many are encoded as one text, whose ids are cut where words end."""
        out: list[bytes] = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            text = codecs.charmap_decode(" ".join(some).encode(), "strict", _BYTE_ALPHABET)[0]
            ids = np.array(self._merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some):  # an id that doesn't end a word: each by itself
                out += [self._whole(w) for w in some]
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokens.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_many(self, texts: list[str]) -> list[bytes]:
        split = [self._tokens.words(t) for t in texts]
        every = set(chain.from_iterable(w for w in split if w is not None))
        known = self._ids.of(every)
        own = dict(zip(every, map(known.__getitem__, every))).__getitem__  # small, so that most lookups are near
        return [self._whole(t) if w is None else b"".join(map(own, w)) for t, w in zip(texts, split)]
