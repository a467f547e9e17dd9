"""Packed token files: round trips, spans, order, and the tokenizer itself as the brute-force version."""

import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlore.llm import token_files
from runlore.llm.token_files import Blocks, pack, read_tokens, unpack, write_tokens
from runlore.llm.unit_store import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def unpacked(data, index, blocks, n):
    columns = [c.to_numpy() for c in index.columns]
    return unpack(np.frombuffer(data, np.uint8), *columns, blocks.size)[:n]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=200), st.sampled_from([8, 16, 64]))
def test_blocks_round_trip(ids, size):
    blocks = Blocks(size=size)
    data, index = pack(np.array(ids, np.uint32), blocks)
    assert index.num_rows == -(-len(ids) // size)
    assert unpacked(data, index, blocks, len(ids)).tolist() == ids


def test_outliers_go_to_the_exception_list():
    ids = np.full(512, 1000, np.uint32) + np.arange(512, dtype=np.uint32) % 8
    plain, index = pack(ids)
    assert index["width"].to_pylist() == [3] and index["exceptions"].to_pylist() == [0] and len(plain) == 512 * 3 // 8
    ids[[5, 100]] = 48_000, 7
    data, index = pack(ids)  # the least id is an outlier too: subtracting it widens all
    assert unpacked(data, index, Blocks(), 512).tolist() == ids.tolist()
    ids[100] = 1000
    data, index = pack(ids)
    assert index["width"].to_pylist() == [3] and index["exceptions"].to_pylist() == [1] and len(data) == len(plain) + 6


def test_words_are_encoded_as_in_whole_texts():
    tokenizer, encode = Tokenizer.from_file(PATH), WordEncoder(PATH, None)
    texts = ["", "  ", "Hello  world's\tÜBER\n", "a<|endoftext|>b <|startoftext|>", "é ́x ΣΑΣ Σ", "中文 字", "1234 x1y2", "don't DON'T", "a,'s b.'S 'Tis,'ll \"'re\" '.s", "J\u030c T\u0308x H\u0331 I\u0307 A\u030a =\u0338 a=\u0338", "3.14,15-x_y/(Z)!?é.é,É1", "\x85a\x85 b"]
    for _ in range(2):
        assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows, end=2):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("blocks", [Blocks(), Blocks(size=8, file_ids=20)])
def test_files_hold_all_texts_in_order(spark, tmp_path, blocks):
    texts = [f"Text number {i} " + "word " * (i % 50) + "éß" * (i % 3) for i in range(200)] + ["", None, "long " * 5000]
    rows = [(i * 7 % 211, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    files = write_tokens(docs, PATH, str(tmp_path), blocks=blocks)
    got = [tuple(r) for r in read_tokens(files, docs.schema["doc_id"].dataType, with_ids=True).orderBy("start").collect()]
    assert got == expected(sorted(rows))
    if blocks.size == 8:
        assert files.count() > 100
    for r in files.collect()[:5]:
        reader = token_files.FileReader(r.path)
        whole = reader.span(0, r.ids)
        assert reader.ids == r.ids and reader.span(r.ids // 3, r.ids // 2).tolist() == whole[r.ids // 3 :][: r.ids // 2].tolist()
        with pytest.raises(IndexError):
            reader.span(0, r.ids + 1)


def test_a_span_reads_its_blocks_only(tmp_path):
    import pyarrow as pa

    writer = token_files.FileWriter(str(tmp_path), pa.string(), Blocks(size=64))
    ids = np.random.default_rng(1).integers(0, 49_000, 64 * 100).astype(np.uint32)
    writer.add(pa.array(["a", None]), [ids[:1000], ids[1000:]])
    path, documents, n, size = writer.close()
    assert (documents, n) == (2, 6400) and size == (tmp_path / path.rsplit("/", 1)[1]).stat().st_size
    reader, read = token_files.FileReader(path), []

    class Counted:
        def read_at(self, n, at):
            read.append(n)
            return whole.read_at(n, at)

    whole, reader.file = reader.file, Counted()
    assert reader.span(640, 64).tolist() == ids[640:704].tolist() and sum(read) <= 64 * 2 + 64
    assert [k.as_py() for keys, _, _ in reader.each() for k in keys] == ["a", None]
    (tmp_path / "cut.pfor").write_bytes((tmp_path / path.rsplit("/", 1)[1]).read_bytes()[:-3])
    with pytest.raises(ValueError, match="not whole"):
        token_files.FileReader(str(tmp_path / "cut.pfor"))


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    kind = odd_docs.schema["doc_id"].dataType
    got = read_tokens(write_tokens(odd_docs, PATH, str(tmp_path / "a")), kind, with_ids=True).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r) for r in got] == expected(rows)
    assert read_tokens(write_tokens(no_docs, PATH, str(tmp_path / "b")), kind).count() == 0


def test_one_key_of_many_rows_is_cut(spark, tmp_path):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_tokens(docs.repartition(8), PATH, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.agg(F.max("documents")).first()[0] < 4000
    got = read_tokens(files, docs.schema["doc_id"].dataType).orderBy("start").collect()
    assert [r.start for r in got] == list(accumulate([3] * 5999, initial=0))
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 6000


def test_blocks_are_checked(spark, odd_docs):
    with pytest.raises(ValueError, match="multiple of 8"):
        write_tokens(odd_docs, PATH, "/nowhere", blocks=Blocks(size=100))
