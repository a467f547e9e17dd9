"""Packing documents into token sequences by vector best-fit.

Every task tokenises its own documents and packs them block by block, so nothing is shuffled. A bin has residual
capacities of tokens, documents and attention cost; an item goes to the open bin whose residual, weighted, is nearest
to what the item needs, or best aligned with it, among those that hold it under every constraint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runlore.llm.common import give_back
from runlore.llm.spans import SPACE, span_hashes

#: Units kept by a task, about 50 bytes each; a full store is emptied, so memory is bounded whatever the vocabulary.
STORE_UNITS = 1_000_000
#: Rows of a batch that are texts in memory at a time.
SLICE = 256
#: Characters of texts that a task looks at together, about: it holds some 100 bytes of arrays for each.
CHARS = 256_000
#: ASCII letters, behind which a comma or full stop is a unit of its own.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: White space other than the space and the line feed; the first eight are ASCII.
RARE_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bits of a sequence id that number the sequences within a task.
SEQUENCE_BITS = 33


@dataclass(frozen=True)
class Bins:
    """Capacities of a sequence, the weight of each in choosing a bin, the measure (``norm`` of the residual that would
    be left, least first, or ``dot`` of need and residual, largest first), and how many pieces are packed together."""

    tokens: int = 2048
    documents: int = 2048
    attention: float = 2048.0**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    measure: str = "norm"
    block: int = 16_384


class Encoder:
    """Token ids of texts, equal to those of the tokenizer file, with each word encoded once.

    A byte-level vocabulary never joins across a single space between two characters that aren't white space, nor
    across such a line feed, so texts are cut there into units. Units are looked up by a 64-bit hash in a bounded
    store; those not seen before are encoded many at a time.
    """

    def __init__(self, path: str, end: int | None):
        from tokenizers import Tokenizer

        self.tokenizer, self.tail = Tokenizer.from_file(path), np.array([] if end is None else [end], np.uint32)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.feed = self._encode("\n")[0]
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at these places, one after the other, and each one's number of ids."""
        n = self.lengths[at]
        pick = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.flat[pick], n

    def _store(self, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Add units by their hashes; their ids stand in ``ids`` from ``starts`` on."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.place = np.insert(self.place, at, order + len(self.lengths))
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self, units: list[str], keys: np.ndarray) -> None:
        """Encode units of letters behind a space in one go, and units of letters alone likewise; the rest one by one."""
        kind = np.fromiter((u.isalpha() + 2 * (u[0] == " " and u[1:].isalpha()) for u in units), np.int8, len(units))
        groups = {k: np.flatnonzero(kind == k) for k in (0, 1, 2)}
        pick = {k: [units[i] for i in at.tolist()] for k, at in groups.items()}
        if pick[2]:
            ids = self._encode("".join(pick[2]))
            starts = np.flatnonzero(self.spaced[ids])
            self._store(keys[groups[2]], ids, starts, np.diff(np.append(starts, len(ids))))
        if pick[1]:
            ids = self._encode("\n".join(pick[1]))
            stops = np.append(np.flatnonzero(ids == self.feed), len(ids))
            starts = np.append(0, stops[:-1] + 1)
            self._store(keys[groups[1]], ids, starts, stops - starts)
        if pick[0]:
            parts = [e.ids for e in self.tokenizer.encode_batch(pick[0], add_special_tokens=False)]
            n = np.array([len(x) for x in parts])
            self._store(keys[groups[0]], np.concatenate(parts).astype(np.uint32), np.cumsum(n) - n, n)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that ``plain_spaces`` holds of: one buffer, a line feed between texts."""
        data = [t.encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(x) + 1 for x in data])
        whole = b"\n".join(data) + b"\n"
        buffer = np.frombuffer(whole, np.uint8)
        feed = buffer == 10
        starts = (buffer == 32) | feed
        starts[1:] |= feed[:-1]
        dots = (buffer == 44) | (buffer == 46)  # a comma or full stop behind a letter and before white space
        near = LETTER[buffer[:-2]] & dots[1:-1] & SPACE[buffer[2:]]
        starts[1:-1] |= near
        starts[0] = True
        starts = np.flatnonzero(starts)
        stops = np.append(starts[1:], len(buffer))
        if len(self.keys) > STORE_UNITS:
            self.clear()
        keys, first, which = np.unique(span_hashes(buffer, starts, stops), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = first[~known]
            units = [whole[i:j].decode() for i, j in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            self._learn(units, keys[~known])
            at = np.searchsorted(self.keys, keys)
        ids, n = self._gather(self.place[at][which])
        past = np.append(0, np.cumsum(n))
        cuts = np.searchsorted(starts, np.append(0, ends))
        return [np.concatenate([ids[past[i] : past[j - 1]], self.tail]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id last where there is one."""
        plain = [plain_spaces(t) for t in texts]
        easy = iter(self._plain([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        hard = iter(self.tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [next(easy) if p else np.concatenate([np.array(next(hard).ids, np.uint32), self.tail]) for p in plain]


def plain_spaces(text: str) -> bool:
    """Whether there is text and all its white space is single spaces and line feeds, each between two other characters."""
    if not text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
        return False
    return "<|" not in text and not any(c in text for c in (RARE_SPACES[:8] if text.isascii() else RARE_SPACES))


def pack(lengths: np.ndarray, bins: Bins = Bins()) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, the longest placed first, equal ones in their order."""
    order = np.argsort(-lengths, kind="stable")
    full = np.array([bins.tokens, bins.documents, bins.attention])
    scale = np.array(bins.weights) / full**2
    needs = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, number, used = np.empty((64, 3)), np.empty(64, np.int64), 0
    least, made = (lengths.min() if len(lengths) else 0), 0
    for i in order:
        need = needs[i]
        if (need > full).any():
            raise ValueError(f"a piece of {lengths[i]} tokens fits no empty bin")
        best = -1
        if used:
            rest = left[:used] - need
            fits = (rest >= 0).all(axis=1)
            if fits.any():
                if bins.measure == "norm":
                    score = np.where(fits, (rest * rest) @ scale, np.inf)
                    best = int(score.argmin())
                else:
                    score = np.where(fits, left[:used] @ (need * scale), -np.inf)
                    best = int(score.argmax())
        if best < 0:
            if used == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            best, left[used], number[used] = used, full, made
            used, made = used + 1, made + 1
        where[i], offset[i] = number[best], full[0] - left[best, 0]
        left[best] -= need
        if left[best, 0] < least or left[best, 1] < 1:  # nothing fits any more
            used -= 1
            left[best], number[best] = left[used], number[used]
    return where, offset


def pieces(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``size`` but for the first, which may be shorter."""
    if length <= size:
        return [(0, length)]
    first = length % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, length, size)]


def pack_documents(docs: DataFrame, tokenizer: str, bins: Bins = Bins(), end: int | None = 0, key: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each row's text: place in its document, checksum of its ids, sequence, offset there.

    A null text is an empty one and still has its end id; repeated rows are packed as often as they stand, null keys
    stay null, other columns are not read, an empty table gives no row. ``with_ids`` adds the ids themselves.
    A sequence holds pieces of one task's block, so ids follow from the task and a lost executor's task gives the same
    again. ``tokenizer`` is a path that every worker sees. A document is cut only if it is longer than a sequence.
    """

    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("piece", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")],
        *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = encoder(tokenizer, end), TaskContext.get().partitionId() << SEQUENCE_BITS, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            columns = [list(c) for c in zip(*held, strict=True)]
            where, offset = pack(np.array(columns[3], np.int64), bins)
            columns[5:5] = [where + (base + made), offset]
            made += int(where.max()) + 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for keys, texts in slices(batches):
            for at, n in chunks(texts):
                for k, ids in zip(keys[at : at + n], encode(texts[at : at + n]), strict=True):
                    for p, (start, length) in enumerate(pieces(len(ids), bins.tokens)):
                        if length:
                            part = ids[start : start + length].astype("<u4")
                            held.append((k, p, start, length, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                    if len(held) >= bins.block:
                        yield flush()
        if held:
            yield flush()
        encode.clear()  # the worker lives on; its memory is for the next task
        give_back()

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of (key, text) batches, few at a time; a null text is an empty one."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.column(0).slice(start, rows).to_pylist(), [t or "" for t in batch.column(1).slice(start, rows).to_pylist()]
    pa.default_memory_pool().release_unused()


def chunks(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of texts of about so many characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield first, i + 1 - first
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts) - first


@lru_cache(maxsize=1)
def encoder(path: str, end: int | None) -> Encoder:
    """One encoder per worker, kept over tasks."""
    return Encoder(path, end)
