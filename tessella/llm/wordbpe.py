"""Encoding whole texts with a word-end BPE of the tokenizers library, by way of the texts' distinct words.

The pre-tokenizer of such a file drops white space and no token spans it, so a text's ids are those of its chunks
between white space in turn. Chunks repeat; each is given to the library once per worker and its ids are kept as
bytes. A chunk that ends in ASCII punctuation after a letter is two chunks, if that letter is still one once the chunk
is normalised (lower-casing may leave a combining mark there): no token spans that place either. Texts that hold the
string of a special token go to the library whole.
"""

from __future__ import annotations

import os
from itertools import accumulate, chain, pairwise

import numpy as np

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_encoders: dict[tuple[str, str, bool], "WordEncoder"] = {}


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian bytes of ``kind``. At most ``most`` chunks are kept.

    With ``special``, as by the library's default, the string of a special token in a text is that token; without, it
    is ordinary text.
    """

    def __init__(self, path: str, kind: str, special: bool, most: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.kind, self.most = np.dtype(kind), most
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith("</w>")
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each one token run: by the model itself in lower-case ASCII, else as one text."""
        plain = [w for w in words if w.isascii()]
        tokenize, size = self.tokenizer.model.tokenize, self.kind.itemsize
        runs = [[t.id for t in tokenize(w)] for w in plain]
        flat = np.fromiter(chain.from_iterable(runs), self.kind).tobytes()
        out = {w: flat[a:b] for w, (a, b) in zip(plain, pairwise(accumulate((size * len(r) for r in runs), initial=0)), strict=True)}
        rest = [w for w in words if not w.isascii()]
        if rest:
            ids = np.array(self.tokenizer.encode(" ".join(rest), add_special_tokens=False).ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(rest):
                out.update(zip(rest, (x.tobytes() for x in np.split(ids, cuts[:-1])), strict=True))
            else:
                out.update(zip(rest, self._library(rest), strict=True))
        return [out[w] for w in words]

    def _letter(self, core: str) -> bool:
        """Whether a chunk ends in a letter, normalised as well as written."""
        return core[-1].isalpha() and (core[-1].isascii() or self.tokenizer.normalizer.normalize_str(core)[-1:].isalpha())

    def _learn(self, chunks: set[str]) -> None:
        split, need = [], set()
        for c in chunks:
            if c.isascii() and c.isalpha():
                core = c.lower()
                split.append((c, core, ""))
                need.add(core)
                continue
            core = c.rstrip(_MARKS)
            if not core or len(core) == len(c) or not self._letter(core):
                core = c
            tail = c[len(core) :]
            core = core.lower() if core.isascii() else core
            split.append((c, core, tail))
            need.add(core)
            if tail:
                need.add(tail)
        need = {w for w in need if w not in self.parts}
        letters = [w for w in need if w.isalpha() and max(w) < "\u0250"]
        self.parts.update(zip(letters, self._words(letters), strict=True))
        others = list(need.difference(letters))
        self.parts.update(zip(others, self._library(others), strict=True))
        for c, core, tail in split:
            self.chunks[c] = self.parts[core] + self.parts[tail] if tail else self.parts[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        # str.split() would cut at the odd characters, the pattern doesn't
        whole = [any(c in text for c in _ODD) or any(t in text for t in self.strings) for text in texts]
        words = [[] if w else text.split() for w, text in zip(whole, texts, strict=True)]
        seen = set().union(*words)
        if len(self.chunks) + len(self.parts) > self.most:
            self.chunks.clear()
            self.parts.clear()
        self._learn(seen.difference(self.chunks))
        known = self.chunks.__getitem__
        return [self._library([text])[0] if w else b"".join(map(known, own)) for w, text, own in zip(whole, texts, words, strict=True)]


def encoder(path: str, kind: str, special: bool = True) -> WordEncoder:
    """The worker's encoder for a file."""
    key = path, kind, special
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]
