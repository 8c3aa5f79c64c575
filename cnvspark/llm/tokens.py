"""Token ids of whole texts by a given public tokenizer file, with a memo of what stands between single spaces."""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cnvspark.llm.common import remembers, single_threaded, working

#: The longest run, in bytes, whose ids are remembered.
LONGEST = 64
#: New runs that the library gets in one call, as it holds far more than their bytes.
AT_ONCE = 2_000
#: How many times what it may hold a memo misses before it begins anew.
RENEWED = 16
#: White space that may join with a space next to it into one pre-token.
_JOINING = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Kinds of bytes. Letters are those of ASCII and of U+00C0 to U+00FF, signs those of ASCII but the apostrophe.
_OTHER, _SPACE, _LINE, _LETTER, _DIGIT, _SIGN = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[[*range(48, 58)]] = _DIGIT
_KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KINDS[[ord("'"), ord(" "), ord("\n")]] = _OTHER, _SPACE, _LINE
#: A run that is one pre-token.
_RUN = re.compile(rb" ?(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as they are, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo:
    """Run -> its ids, of at most ``most`` runs. The second half is for runs that come more than once in a call. A full memo
    stays as it is, for frequent runs mostly come early; when it has missed many times what it holds, it begins anew.
    """

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int):
        self.make, self.most, self.missed = make, most, 0
        self.known: dict[bytes, bytes] = {}

    def of(self, runs: list[bytes], counts: np.ndarray) -> list[bytes]:
        """The ids of different runs, which come ``counts`` times; those of the unknown ones are made together."""
        out = [*map(self.known.get, runs)]
        fresh = [i for i, ids in enumerate(out) if ids is None]
        self.missed += len(fresh)
        if self.missed > RENEWED * self.most:
            self.known, self.missed = {}, 0
        for i, n, ids in zip(fresh, counts[fresh].tolist(), self.make([runs[i] for i in fresh]), strict=True):
            out[i] = ids
            if len(self.known) < (self.most if n > 1 else self.most // 2) and len(runs[i]) <= LONGEST:
                self.known[runs[i]] = ids
        return out


class TokenCoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A byte-level pre-tokenizer cuts a text before each lone space, so the ids of a text are those of its chunks, each
    with the space before it, one after another. Chunks of Latin letters, digits, signs and lone line ends fall into runs of one
    kind, which are their pre-tokens; any other chunk is one run. Runs repeat, so each is looked up once for all texts of a call, and
    its ids are remembered (at most ``memo_size`` of them). A text where a space touches other white space, or
    that holds a special token's opening, goes to the library as a whole, which gives such a token its own id. The
    library's model makes all ids in every case: those of new pre-tokens in one call, with NUL, which none of them holds, between.
    """

    def __init__(self, path: str, memo_size: int = 900_000):
        single_threaded()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = Tokenizer(self.tokenizer.model)  # the same model, for pre-tokens
        self.cut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        letters = _byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")
        self.letters[1] = ord(" ")
        (self.between,) = (t.id for t in self.tokenizer.model.tokenize(letters[0]))
        self.memo = _Memo(self._of_runs, memo_size)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_runs(self, runs: list[bytes]) -> list[bytes]:
        """The ids of runs, made anew."""
        out, plain, other = [b""] * len(runs), [], []
        for i, run in enumerate(runs):
            (plain if run.lstrip(b" ").isalpha() or _RUN.fullmatch(run) else other).append(i)
        for part in itertools.batched(plain, AT_ONCE):
            data = np.frombuffer(b"\1\0\1".join([*(runs[i] for i in part), b""]), np.uint8)
            shown = self.letters[data].tobytes().decode("utf-32-le")
            (encoded,) = self.cut.encode_batch_fast([shown], add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            ends = (np.flatnonzero(ids == self.between) * 4).tolist()
            ids, start = ids.tobytes(), 0
            for i, end in zip(part, ends, strict=True):
                out[i], start = ids[start:end], end + 4
        for i, ids in zip(other, self._ids([runs[i].decode() for i in other]), strict=True):
            out[i] = ids
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, none of them empty, whose chunks can be taken one by one."""
        raw = [text.encode() for text in texts]
        firsts = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        kinds = _KINDS[data]
        last, this = kinds[:-1], kinds[1:]
        heads = kinds == _SPACE  # of chunks
        begins = heads.copy()  # of runs
        begins[1:] |= (this != last) & (last != _SPACE)
        strange = kinds == _OTHER
        strange[1:] |= (this == _LINE) & (last == _LINE) | (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        heads[firsts[:-1]] = begins[firsts[:-1]] = True
        if strange.any():
            chunk = np.cumsum(heads)
            whole = np.zeros(chunk[-1] + 1, bool)
            whole[chunk[strange]] = True
            begins &= heads | ~whole[chunk]
        bounds = np.append(np.flatnonzero(begins), len(data))
        runs = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        _, at, held = runs.dictionary.buffers()
        at, held = np.frombuffer(at, np.int64)[: len(runs.dictionary) + 1].tolist(), held.to_pybytes()
        which = runs.indices.to_numpy()
        ids = self.memo.of([held[a:b] for a, b in itertools.pairwise(at)], np.bincount(which))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        known, starts, each = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes[which]
        ends = np.cumsum(each)
        found = known[np.repeat(starts[which] - ends + each, each) + np.arange(ends[-1])].tobytes()
        cuts = np.append(0, ends)[np.searchsorted(bounds, firsts)] * 4
        return [found[a:b] for a, b in itertools.pairwise(cuts.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, plain, whole = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if "<|" in text or any(x in text for x in _JOINING) or _RARE_SPACE.search(text):
                whole.append(i)
            elif text:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._joined([texts[i] for i in plain]), strict=True):
                out[i] = ids
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def _coder(path: str, memo_size: int) -> TokenCoder:
    return TokenCoder(path, memo_size)


def coder(path: str, memo_size: int = 900_000) -> TokenCoder:
    """One coder for each Python worker, which Spark reuses between tasks."""
    working("tokens")
    return _coder(path, memo_size)


remembers("tokens", _coder.cache_clear)


def tokenizer_path() -> str:
    """Where the public byte-level vocabulary lies on this machine; every machine of the cluster has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
