"""Hashes of the words of whole texts, remembered by each Python worker."""

from __future__ import annotations

import numpy as np
import xxhash

from cnvspark.llm.common import remembers, working

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"


class _Hashes(dict):
    """Word as written -> hash of its lower-case form without marks at its edges (0: nothing is left)."""

    def __missing__(self, word: str) -> int:
        plain = word.lower().strip(_MARKS)
        value = (xxhash.xxh3_64_intdigest(plain) | 1) if plain else 0
        if len(self) > 600_000:
            self.clear()
        self[word] = value
        return value


_HASHES = _Hashes()
remembers("words", _HASHES.clear)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each text the hashes of its words in order; words stand between white space, and bare marks are none."""
    working("words")
    out = []
    for text in texts:
        words = text.split()
        x = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        out.append(x if x.all() else x[x != 0])
    return out
