"""Token ids by the ``tokenizers`` library for its word vocabularies, with words kept in bounded caches.

Such a vocabulary lower-cases, drops white space and never merges over it, so a text's ids are those of its words one after the
other. A word of Latin-1 letters, with or without ASCII punctuation behind it, is one or two of the vocabulary's
own pre-tokens and goes to the library's model directly; every other word goes through the library's whole encoder,
and so does a whole text that holds a separator which Python takes for white space and the vocabulary doesn't.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

_ODD = re.compile("[\x1c-\x1f]")
_BEHIND = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which can open a pre-token of its own
#: Words a worker keeps in each cache: two generations of this many, some 170 bytes each.
CACHE_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class _Kept(dict):
    """A dictionary that makes what it lacks and forgets what it hasn't met for a while."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        x = self.old.get(key)
        if x is None:
            x = self.make(key)
        self[key] = x
        return x


class Ids:
    """Little-endian unsigned 32-bit ids of texts as bytes."""

    def __init__(self, path: str, words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.letters = _byte_letters()
        self.runs = _Kept(self._run, words)
        self.words = _Kept(self._word, words)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """A pre-token: lower-cased Latin-1 letters."""
        ids = [x.id for x in self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_BEHIND)
        if core.isalpha() and max(core) < "Ā":
            run = self.runs[core.lower()]
            return run if len(core) == len(word) else run + self.words[word[len(core) :]]
        return self._whole(word)

    def of(self, text: str | None) -> bytes:
        text = text or ""
        if _ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_loaded: dict[tuple[str, int], Ids] = {}


def ids_of(path: str, words: int = CACHE_WORDS) -> Ids:
    """The encoder of a vocabulary file, one in each Python worker: another one takes the place of the last."""
    if (path, words) not in _loaded:
        _loaded.clear()
        _loaded[path, words] = Ids(path, words)
    return _loaded[path, words]
