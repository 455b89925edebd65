"""Token streams against the tokenizer, and every limit, gap and cut of the packing."""

import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from conftest import SF
from keepwell.llm.q_packing import LIMITS, packed
from keepwell.llm.vector_packing import ChunkIds, Limits, pack_examples, pack_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, CHUNKS = Tokenizer.from_file(PATH), ChunkIds(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeéÉßΣσİ .,'’ś \n\t\x1c1<|>")), max_size=60))
def test_chunks_give_the_ids_of_the_whole_text(text):
    got = CHUNKS.text_ids(text.encode())
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == WHOLE.encode(text, add_special_tokens=False).ids


def check(rows, texts, limits):
    streams = {k: ids_of(t) for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = streams[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32 and r.doc_tokens == len(streams[r.doc_id])
    assert set(by_doc) == set(streams)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(streams[k])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r.length - 1 for r in pieces) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding, len(by_sequence)


def test_documents_are_packed_whole_and_without_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    padding, _ = check(packed(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, LIMITS)
    assert padding == 0


@pytest.mark.parametrize("limits", [Limits(64, 3, 64), Limits(64, 2, 20), Limits(100, 5, 98)])
def test_small_limits_and_odd_texts(spark, limits):
    texts = {i: t for i, t in enumerate(["", None, "one", "a b c " * 400, "x" * 5000, "Éa, <|endoftext|> b", "tie", "tie"] + ["w " * n for n in range(60)])}
    rows = [(i, t, 1, "s") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, sequence_id string").repartition(3)
    got = pack_texts(docs, "doc_id", "text", PATH, limits=limits, pool_rows=8).collect()
    check(got, texts, limits)
    assert pack_texts(docs.limit(0), "doc_id", "text", PATH).collect() == []


def test_examples_are_not_cut(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    sizes = defaultdict(lambda: [0, 0, 0])
    for t in turns:
        n = len(t.text or "")
        sizes[t.conv_id] = [a + b for a, b in zip(sizes[t.conv_id], (n, 1, n if t.role == "assistant" else 0))]
    limits = Limits(4000, 6, 1500)
    rows = [(k, *v) for k, v in sizes.items()] + [(-1, 9000, 1, 0), (None, None, 1, 0)] + [(7000 + i, 1, 1, 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, n_tokens long, n_segments long, n_loss long").repartition(2)
    got = pack_examples(frame, "conv_id", limits, pool_rows=16).collect()
    assert sorted(map(str, ((r.conv_id, r.n_tokens) for r in got))) == sorted(map(str, ((r[0], r[1] or 0) for r in rows)))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: (r.offset, r.n_tokens))
        assert [r.offset for r in s] == [sum(x.n_tokens for x in s[:i]) for i in range(len(s))]
        if s[0].fits:
            assert all(sum(getattr(r, c) for r in s) <= m for c, m in (("n_tokens", 4000), ("n_segments", 6), ("n_loss", 1500)))
        else:
            assert len(s) == 1 and s[0].n_tokens > 4000 or s[0].n_loss > 1500 or s[0].n_segments > 6
