"""Alignment of two tokenizers against byte ranges compared one by one."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from runlore.llm import token_alignment
from runlore.llm.token_alignment import Aligner, PieceSide, align_documents, aligned_documents, overlaps

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "the quick brown fox", "", None, " ", "  two  spaces ", "tab\tand\nfeed\r\n\n x", "a▁b", "▁",
    "naïve café ßtraße Ünïcödé", "中文字符 и кириллица", "emoji 🤦🏼‍♂️ x", "<|endoftext|> and <s> </s> <unk>", "<0x41>", "x" * 300, "nul \x00 in",
    "don't can't 1234567 3.14", "ﬁ Å é", " hard space", "a  b   c    d", "same words same words same words", "The quick brown fox jumps over the lazy dog.",
]


def sides():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = token_alignment.byte_of_char()

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return (lambda t: [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, piece(i)) for i in b.encode(t)])


def by_hand(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, every token with every other."""
    first, second = sides()
    rows, count = [], Counter()
    for t in texts:
        spans = []
        for tokens in (first(t or ""), second(t or "")):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append((b"".join(x for _, x in tokens), out))
        (x, a), (y, b) = spans
        if not t or not x == y == (" " + t).encode():
            rows.append(None)
            continue
        links = [(p[0], q[0]) for p in a for q in b if p[1] < q[2] and q[1] < p[2]]
        count.update(links)
        cuts = sorted({p[2] for p in a} & {q[2] for q in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(p[0]) for p in side if lo < p[2] <= hi) for side in (a, b)))
            lo = hi
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (*r[:3], len(r[3]), sum(count[p] == best[p[1]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_against_every_pair_of_tokens(spark, limit):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align_documents(docs, A, B, broadcast_bytes=limit).collect()}
    assert [got[i] for i in range(len(TEXTS))] == by_hand(TEXTS)


def test_overlaps_of_token_ends():
    ends = lambda *n: np.cumsum(n)
    for a, b, want in (([3, 2], [3, 2], [(0, 1), (1, 1)]), ([5], [2, 2, 1], [(0, 3)]), ([2, 3, 1], [4, 1, 1], [(0, 1), (0, 2), (2, 1)])):
        first, count = overlaps((ends(*a), ends(*b)), (np.array(a), np.array(b)))
        assert list(zip(first.tolist(), count.tolist(), strict=True)) == want


def test_units_of_pieces_are_encoded_as_in_whole_texts():
    whole, side = SentencePieceProcessor(model_file=B), PieceSide(B)
    texts = [t for t in TEXTS if t is not None] + ["trailing ", "trailing  ", " lead", "   ", "\n", "a \n b"]
    for _ in range(2):
        assert [x.tolist() for x in side(texts)] == whole.encode(texts)


def test_equal_hashes_of_other_ids_change_nothing(monkeypatch):
    texts = [t or "" for t in TEXTS]
    want = Aligner(A, B)(texts, True)
    monkeypatch.setattr(token_alignment, "mixed", lambda h: h * 0)  # every window seems to be the same
    aligner = Aligner(A, B)
    aligner(texts[:5])
    got = aligner(texts, True)
    assert [(x.digest, x.groups, x.n_links) for x in got] == [(x.digest, x.groups, x.n_links) for x in want]


def test_a_full_memory_is_emptied(monkeypatch):
    texts = [t or "" for t in TEXTS]
    want = [x.digest for x in Aligner(A, B)(texts)]
    monkeypatch.setattr(token_alignment, "WINDOWS", 3)
    assert [x.digest for x in Aligner(A, B)(texts)] == want


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    want = Counter(zip([r.doc_id for r in rows], by_hand([r.text if r.doc_id != 5 else "" for r in rows]), strict=True))
    got = align_documents(odd_docs, A, B).collect()
    assert len(got) == 11 and {r.doc_id for r in got} == {r.doc_id for r in rows}
    long = next(r for r in got if r.doc_id == 5)
    assert long.n_a > 40_000 and long.n_groups <= min(long.n_a, long.n_b)
    # the long text's pairs count for the others too, so only their own figures are compared
    short = lambda r: (r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256))
    assert Counter(short(r) for r in got if r.doc_id != 5) == Counter((k, (*v[:4], v[6])) for k, v in want.elements() if k != 5)
    assert align_documents(no_docs, A, B).count() == 0
    assert aligned_documents(no_docs, A, B, with_groups=True).count() == 0
    groups = aligned_documents(odd_docs.where("doc_id = 1"), A, B, with_groups=True).first()
    assert hashlib.sha256(groups.groups.encode()).hexdigest() == groups.groups_sha256 and sum(groups.times) == groups.n_links
