"""Token ids of texts through their units: stretches that a vocabulary never joins across are encoded once each."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from runlore.llm.spans import span_hashes

#: Units kept by a worker, about 50 bytes each; a full store is emptied, so memory is bounded whatever the vocabulary.
STORE_UNITS = 750_000


def flat_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the items of runs, one run after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


class UnitStore:
    """Ids of units by a 64-bit hash of their bytes; those not seen before are encoded many at a time."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, units: list[str], keys: np.ndarray) -> None:
        parts = self.encode(units)
        n = np.array([len(p) for p in parts], np.int64)
        ids = np.array([i for p in parts for i in p], np.uint32)
        at = np.searchsorted(self.keys, keys)  # keys are sorted
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, len(self.lengths) + np.arange(len(keys)))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units at these places of ``data``, one after the other; how many ids come before each unit, and
        in all)."""
        if len(self.keys) > STORE_UNITS:
            self.clear()
        hashes = span_hashes(np.frombuffer(data, np.uint8), starts, stops)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = first[~known]
            self._learn([data[i:j].decode() for i, j in zip(starts[new].tolist(), stops[new].tolist(), strict=True)], keys[~known])
            at = np.searchsorted(self.keys, keys)
        units = self.place[at][which]
        n = self.lengths[units]
        return self.flat[flat_places(self.starts[units], n)], np.append(0, np.cumsum(n))


#: Kinds of bytes for ``WordEncoder``: white space, letter, digit, apostrophe, other ASCII, beyond ASCII.
BLANK, LETTER, DIGIT, OTHER, APOSTROPHE, WIDE = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[39] = APOSTROPHE
KIND[128:] = WIDE
#: Units that the tokenizer is given at a time; what it keeps of each is much larger than its ids.
AT_ONCE = 4096


class WordEncoder:
    """Ids of texts, equal to those of a tokenizer file that drops white space, folds case, and takes letters, single
    digits and other marks apart unless an apostrophe is near. So runs of ASCII bytes of one kind stand alone, and small
    letters stand for capitals but where a mark may follow. The end id, where there is one, comes last."""

    def __init__(self, path: str, end: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.tail = Tokenizer.from_file(path), np.array([] if end is None else [end], np.uint32)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.store = UnitStore(self.whole)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """A text that holds the string of a special token is encoded whole."""
        apart = [any(s in t for s in self.special) for t in texts]
        data = [t.encode("utf-8", "replace") + b" " for t, a in zip(texts, apart, strict=True) if not a]
        ends = np.cumsum([len(x) for x in data], dtype=np.int64)
        buffer = np.frombuffer(b"".join(data), np.uint8).copy()
        kind = KIND[buffer]
        if len(buffer):
            capital = (buffer >= 65) & (buffer <= 90)
            capital[:-1] &= kind[1:] != WIDE
            buffer[capital] += 32
        own = (kind >= LETTER) & (kind <= OTHER)
        begins = kind != BLANK
        begins[1:] &= (kind[:-1] == BLANK) | (own[1:] & own[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)))
        stops = kind != BLANK
        stops[:-1] &= (kind[1:] == BLANK) | begins[1:]
        starts = np.flatnonzero(begins)
        ids, past = self.store.ids(buffer.tobytes(), starts, np.flatnonzero(stops) + 1)
        cuts = past[np.searchsorted(starts, np.append(0, ends))]
        plain = iter(np.split(ids, cuts[1:-1]) if len(ends) else ())
        hard = iter(self.whole([t for t, a in zip(texts, apart, strict=True) if a]))
        return [np.concatenate([np.array(next(hard), np.uint32) if a else next(plain), self.tail]) for a in apart]


@lru_cache(maxsize=1)
def word_encoder(path: str, end: int | None) -> WordEncoder:
    """One encoder per worker, kept over tasks."""
    return WordEncoder(path, end)
