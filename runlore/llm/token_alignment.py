"""Alignment of two tokenizers' ids on whole texts by white-space anchors.

Both tokenise a whole text. Where a token of each begins at the same byte and both carry the space before a word, the
tokens before end together: an anchor. Anchors cut a document into windows of token ids on both sides, mostly a word
each, and the alignment of a window depends on its ids alone. So equal windows are aligned once and remembered by their
pair of id tuples: the groups between ends that both sides share, and the pairs of tokens whose bytes overlap.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runlore.llm.common import BROADCAST_BYTES, give_back
from runlore.llm.packing import Encoder, chunks, plain_spaces, slices
from runlore.llm.spans import mixed, span_hashes
from runlore.llm.unit_store import UnitStore, flat_places
from runlore.operators.skew import join_hot
from runlore.session import materialise

#: The mark of a space in the pieces of one tokenizer.
SPACE_MARK = "▁"
#: Windows a worker remembers, some 100 bytes each; a full memory is emptied.
WINDOWS = 400_000
#: Bits of an id pair's code that hold the second id.
ID_BITS = 32
#: Bits of a row's number that count within its task.
ROW_BITS = 33


class ByteSide:
    """Ids of a space and a text by a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.encoder = Encoder(path, None)
        tokenizer = self.encoder.tokenizer
        tokenizer.encode_special_tokens = True
        self.of_byte = byte_of_char()
        self.entries = [bytes(self.of_byte.get(c, 0) for c in tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [plain_spaces(t) for t in texts]
        spaced = [" " + t for t in texts]
        easy = iter(self.encoder._plain([t for t, p in zip(spaced, plain, strict=True) if p]) if any(plain) else ())
        rest = [t for t, p in zip(spaced, plain, strict=True) if not p]
        hard = iter(self.encoder.tokenizer.encode_batch(rest, add_special_tokens=False))
        return [next(easy) if p else np.array(next(hard).ids, np.uint32) for p in plain]


def byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others by
    the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceSide:
    """Ids of a text by a piece vocabulary that puts a space before it. No piece joins a space to what stands before it
    but other spaces, so runs of spaces with what follows are units."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        self.lone = self.pieces.piece_to_id(SPACE_MARK)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.splits = not any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names)
        self.entries = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(SPACE_MARK, " ").encode()
                        for i, n in enumerate(names)]
        self.store = UnitStore(self._units)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    def _units(self, units: list[str]) -> list[list[int]]:
        return [[self.lone] if u == " " else ids for u, ids in zip(units, self._whole([u[1:] for u in units]), strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = [not t or SPACE_MARK in t or not self.splits for t in texts]
        data = [(" " + t).encode("utf-8", "replace") for t, w in zip(texts, whole, strict=True) if not w]
        firsts = np.cumsum([0, *map(len, data)])
        buffer = np.frombuffer(b"".join(data), np.uint8)
        begins = buffer == 32
        begins[1:] &= buffer[:-1] != 32
        begins[firsts[:-1]] = True
        starts = np.flatnonzero(begins)
        ids, past = self.store.ids(buffer.tobytes(), starts, np.append(starts[1:], len(buffer)))
        easy = iter(np.split(ids, past[np.searchsorted(starts, firsts)][1:-1]) if data else ())
        hard = iter(self._whole([t for t, w in zip(texts, whole, strict=True) if w]))
        return [np.array(next(hard), np.uint32) if w else next(easy) for w in whole]


class Runs:
    """Runs of items, one after the other, by number."""

    def __init__(self, kind: type):
        self.flat, self.starts, self.lengths = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items of these runs, one after the other; each one's number of items)."""
        n = self.lengths[at]
        return self.flat[flat_places(self.starts[at], n)], n

    @classmethod
    def of(cls, parts: list[bytes]) -> Runs:
        runs = cls(np.uint8)
        runs.add(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))
        return runs


def overlaps(ends: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first token of the second side that overlaps each one of the first, how many do)."""
    first = np.searchsorted(ends[1], ends[0] - lengths[0], side="right")
    return first, np.searchsorted(ends[1] - lengths[1], ends[0], side="left") - first


@dataclass
class Aligned:
    """What is known of a text's alignment; ``pairs`` are codes of id pairs and ``times`` how many links hold each."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: str = ""
    groups: str = ""
    pairs: np.ndarray | None = None
    times: np.ndarray | None = None


class Aligner:
    """Aligns texts, each distinct window once while it is remembered."""

    def __init__(self, byte_path: str, piece_path: str):
        self.sides = ByteSide(byte_path), PieceSide(piece_path)
        self.bytes = [Runs.of(s.entries) for s in self.sides]
        self.spaced = [np.array([e.startswith(b" ") for e in s.entries]) for s in self.sides]
        # an id as text with what follows it: another of its side, or the last of its side in a group
        self.shown = [f"{i}{mark}".encode() for s, last in zip(self.sides, "|;", strict=True) for i in range(len(s.entries)) for mark in ("," + last)]
        self.shown_length = np.array([len(x) for x in self.shown])
        self.clear()

    def clear(self) -> None:
        """Forget all windows: their keys, ids of both sides, groups as text, codes of linked pairs, numbers of groups."""
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.text, self.codes, self.n_groups = [Runs(np.int64), Runs(np.int64)], Runs(np.uint8), Runs(np.int64), np.empty(0, np.int64)

    def _align(self, ids: list[np.ndarray], n: list[np.ndarray]) -> None:
        """Align windows, given by their ids on both sides, and add them to what is known, in their order."""
        lengths = [r.lengths[i] for r, i in zip(self.bytes, ids, strict=True)]
        ends = [np.cumsum(x) for x in lengths]
        shared = np.intersect1d(*ends, assume_unique=True)
        window = [np.repeat(np.arange(len(x)), x) for x in n]
        last = [np.zeros(len(i), np.int64) for i in ids]
        for mark, end in zip(last, ends, strict=True):
            mark[np.searchsorted(end, shared)] = 1
        group = [np.cumsum(x) - x for x in last]
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        token = np.concatenate([ids[0] * 2 + last[0], 2 * len(self.sides[0].entries) + ids[1] * 2 + last[1]])[order]
        text = np.frombuffer(b"".join([self.shown[t] for t in token.tolist()]), np.uint8)
        count = len(n[0])
        self.text.add(text, np.bincount(np.concatenate(window)[order], weights=self.shown_length[token], minlength=count).astype(np.int64))
        first, links = overlaps(ends, lengths)
        self.codes.add(np.repeat(ids[0] << ID_BITS, links) | ids[1][flat_places(first, links)], np.bincount(window[0], weights=links, minlength=count).astype(np.int64))
        self.n_groups = np.concatenate([self.n_groups, np.bincount(window[0], weights=last[0], minlength=count).astype(np.int64)])
        for known, i, x in zip(self.ids, ids, n, strict=True):
            known.add(i, x)

    def windows(self, keys: np.ndarray, ids: list[np.ndarray], starts: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
        """The number of each of these distinct windows among those known; new ones are aligned and remembered. Windows
        are told by a hash of their ids, and a hash that is known must be of the very same ids."""
        if len(self.keys) > WINDOWS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out = np.zeros(len(keys), np.int64)
        out[known] = self.place[at[known]]
        same = known.copy()
        for own, flat, first, x in zip(self.ids, ids, starts, n, strict=True):
            same[known] &= own.lengths[out[known]] == x[known]
            rows = np.flatnonzero(same)
            equal = own.take(out[rows])[0] == flat[flat_places(first[rows], x[rows])]
            bad = np.repeat(rows, x[rows])[~equal]
            same[bad] = False
        new = np.flatnonzero(~same)
        if len(new):
            out[new] = len(self.n_groups) + np.arange(len(new))
            self._align([flat[flat_places(first[new], x[new])] for flat, first, x in zip(ids, starts, n, strict=True)], [x[new] for x in n])
            add = np.flatnonzero(~known)
            add = add[np.argsort(keys[add], kind="stable")]
            add = add[np.append(True, keys[add][1:] != keys[add][:-1])] if len(add) else add
            where = np.searchsorted(self.keys, keys[add])
            self.keys, self.place = np.insert(self.keys, where, keys[add]), np.insert(self.place, where, out[add])
        return out

    def _covered(self, texts: list[str], ids: tuple[list[np.ndarray], ...]) -> list[int]:
        """Texts with tokens: not empty, and on both sides the joined tokens are its bytes behind a space."""
        want = [(" " + t).encode("utf-8", "replace") for t in texts]
        good = np.array([bool(t) for t in texts])
        for runs, side in zip(self.bytes, ids, strict=True):
            total = np.array([int(runs.lengths[x].sum()) for x in side])
            good &= total == [len(w) for w in want]
        held = np.flatnonzero(good)
        for runs, side in zip(self.bytes, ids, strict=True):
            if len(held):
                data = np.frombuffer(b"".join([want[i] for i in held]), np.uint8)
                wrong = np.flatnonzero(runs.take(np.concatenate([side[i] for i in held]))[0] != data)
                good[held[np.searchsorted(np.cumsum([len(want[i]) for i in held]), wrong, side="right")]] = False
        return np.flatnonzero(good).tolist()

    def __call__(self, texts: list[str], with_groups: bool = False) -> list[Aligned]:
        """Of each text; a text without tokens has zeros."""
        out = [Aligned() for _ in texts]
        each = tuple(s(texts) for s in self.sides)
        held = self._covered(texts, each)
        if not held:
            return out
        n_tokens = [np.array([len(s[i]) for i in held]) for s in each]
        ids = [np.concatenate([s[i] for i in held]).astype(np.int64) for s in each]
        ends = [np.cumsum(r.lengths[i]) for r, i in zip(self.bytes, ids, strict=True)]
        begins = [e - r.lengths[i] for e, r, i in zip(ends, self.bytes, ids, strict=True)]
        marked = [s[m[i]] for s, m, i in zip(begins, self.spaced, ids, strict=True)]
        anchors = np.intersect1d(*marked, assume_unique=True)  # the first token of each text is among them
        first = [np.searchsorted(s, anchors) for s in begins]
        stop = [np.append(x[1:], len(i)) for x, i in zip(first, ids, strict=True)]
        n = [y - x for x, y in zip(first, stop, strict=True)]
        keys = mixed(mixed(span_hashes(ids[0], first[0], stop[0])) + span_hashes(ids[1], first[1], stop[1]))
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        for i, x, m in zip(ids, first, n, strict=True):  # equal hashes must mean equal ids
            if (m[one][which] != m).any() or (i[flat_places(x[one][which], m)] != i).any():
                one = which = np.arange(len(anchors))
                break
        number = self.windows(keys[one], ids, [x[one] for x in first], [m[one] for m in n])[which]

        begin = np.searchsorted(first[0], np.cumsum(n_tokens[0]) - n_tokens[0])  # documents begin where the tokens before them end
        links, per_window = self.codes.take(number)
        groups, per_text = self.text.take(number)
        n_groups, n_links = (np.add.reduceat(x, begin) for x in (self.n_groups[number], per_window))
        codes, code = np.unique(links, return_inverse=True)
        cells, times = np.unique(np.repeat(np.arange(len(held)), n_links) * len(codes) + code, return_counts=True)
        cut = np.searchsorted(cells, np.arange(len(held) + 1) * len(codes))
        past = np.append(0, np.cumsum(np.add.reduceat(per_text, begin)))
        for j, i in enumerate(held):
            text = groups[past[j] : past[j + 1] - 1].tobytes()  # without the last mark
            some = slice(cut[j], cut[j + 1])
            out[i] = Aligned(int(n_tokens[0][j]), int(n_tokens[1][j]), int(n_groups[j]), int(n_links[j]), hashlib.sha256(text).hexdigest(),
                             text.decode() if with_groups else "", codes[cells[some] - j * len(codes)], times[some])
        return out


@lru_cache(maxsize=1)
def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    """One aligner per worker, kept over tasks."""
    return Aligner(byte_path, piece_path)


def aligned_documents(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text",
                      with_groups: bool = False) -> DataFrame:
    """(key, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]) of every row: token and group
    counts, links between overlapping tokens, checksum of the groups as text, and the distinct id pairs (first id in the
    upper 32 bits) with the number of links that hold each. ``row`` is a number of its own.

    A null text is an empty one; without tokens all counts are 0, the checksum is empty and there are no pairs. Repeated
    rows are aligned as often as they stand, keys may be null or repeated, other columns are not read, an empty table
    gives no rows. Both paths are ones that every worker sees.
    """
    kind = docs.schema[key].dataType
    pairs = [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(c, T.LongType()) for c in ("row", "n_a", "n_b", "n_groups", "n_links")],
                           T.StructField("groups_sha256", T.StringType()), *pairs, *([T.StructField("groups", T.StringType())] if with_groups else [])])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = aligner_of(byte_path, piece_path), TaskContext.get().partitionId() << ROW_BITS
        for keys, texts in slices(batches):
            for at, n in chunks(texts):
                found = aligner(texts[at : at + n], with_groups)
                columns = [keys[at : at + n], range(row, row + n), [x.n_a for x in found], [x.n_b for x in found], [x.n_groups for x in found],
                           [x.n_links for x in found], [x.digest for x in found], *[list_column([getattr(x, c) for x in found]) for c in ("pairs", "times")]]
                if with_groups:
                    columns.append([x.groups for x in found])
                row += n
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        give_back()

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema)


def list_column(parts: list[np.ndarray | None]) -> pa.Array:
    parts = [np.empty(0, np.int64) if p is None else p for p in parts]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) of every id pair: links that hold it, and whether no pair of its second id has more. Tasks
    add up their own links first; a second id meets at most the vocabulary of the first."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    of_second = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_second))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text",
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row: ``aligned_documents`` with the
    links that hold the commonest pair of their second id, equally common ones included, and the sum over all links of
    how common their pair is in all of ``docs``.

    Pair counts of up to ``broadcast_bytes`` travel to the tasks; of more, rows and counts meet by pair, the hottest
    pairs apart. Both give the same rows. Sums are per distinct pair of a document, never per link.
    """
    aligned = materialise(aligned_documents(docs, byte_path, piece_path, key, text))
    counts = materialise(pair_counts(aligned))
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if counts.count() * 48 <= broadcast_bytes:
        met = each.join(F.broadcast(counts), "pair")
    else:
        met = join_hot(each, counts, "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
