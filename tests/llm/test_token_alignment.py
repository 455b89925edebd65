"""Token alignment against a plain walk over byte offsets, and its parts against simple versions."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF
from keepwell.llm import token_alignment as TA
from keepwell.llm.q_alignment import FILES, token_alignment

PATHS = [public_tokenizers.path(f) for f in FILES]
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a\nb \n\n c", "don't stop", "x" * 3000, "ab" * 900 + " " + "é" * 300,
    "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ sign", "日本語のテキスト と 한국어", "tab\tand\x0bvt\x85nel ls", "\x1c \x1d x\x1c y",
    "é ﬁne ﻿ bom", "a\x00b c", "one two three one two three", "one two three one two three", "🙂🙃 🙂",
    "ends in line\n", "many     spaces   here     ", "\xa0nbsp \xa0 x", "!!!! ???? ----", " " * 70 + "deep", "123 4567 89",
]


def plain(texts):
    """Whole-text tokenization, byte offsets by addition, groups by set intersection."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a_side.encode_special_tokens = True
    letter = TA._byte_letters()
    out, held, counts = [], Counter(), []
    for text in texts:
        text = text or ""
        a = a_side.encode(" " + text, add_special_tokens=False) if text else None
        a_ids, b_ids = (a.ids, b_side.encode(text)) if text else ([], [])
        a_bytes = [bytes(letter[c] for c in t) for t in a.tokens] if text else []
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b_ids for p in [b_side.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a_ids, b_ids, a_bytes, b_bytes = [], [], [], []
        ends = [[sum(map(len, side[:i + 1])) for i in range(len(side))] if len(side) < 400 else list(np.cumsum([len(x) for x in side]))
                for side in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = bisect_left(ends[0], end) + 1, bisect_left(ends[1], end) + 1
            groups.append((a_ids[i:i2], b_ids[j:j2]))
            i, j = i2, j2
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        counts.append(links)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([len(a_ids), len(b_ids), len(groups), sum(links.values()),
                    hashlib.sha256(spelled.encode()).hexdigest() if a_ids else ""])
    highest = Counter()
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    for row, links in zip(out, counts):
        row += [sum(n for p, n in links.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in links.items())]
    return out


def rows_of(df):
    return [[r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum] for r in df.collect()]


def test_query_matches_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip([d.doc_id for d in docs], plain([d.text for d in docs])))
    found = token_alignment(spark, SF)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = {r.doc_id: [r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum] for r in found.collect()}
    assert got == expected


@pytest.mark.parametrize("most", [1 << 20, 5, 0])
def test_odd_texts_and_any_split_of_the_counts(spark, most, monkeypatch):
    monkeypatch.setattr(TA, "BLOCK_ROWS", 3)
    docs = spark.createDataFrame([(i if i % 5 else None, t, 7, "z", "z") for i, t in enumerate(ODD)],
                                 "doc_id long, text string, row int, pairs string, times string")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = rows_of(TA.alignment(docs, "doc_id", "text", *PATHS, keep={"groups_sha256": digest}, most=most))
    assert sorted(found) == sorted(plain(ODD))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert TA.alignment(docs, "doc_id", "text", *PATHS).collect() == []


def test_cut_texts_are_aligned_like_whole_texts():
    cut, whole = TA.Aligner(*PATHS), TA.Aligner(*PATHS)
    assert cut.cut and cut.sides[0].ranked is not None
    whole.cut = False
    whole.sides[0].ranked = None  # the file's own library
    one, other = cut.block([t or "" for t in ODD]), whole.block([t or "" for t in ODD])
    for name, values in one.items():
        if name in ("pairs", "times"):
            assert [v.tolist() for v in values] == [v.tolist() for v in other[name]], name
        else:
            assert list(values) == list(other[name]), name


def test_forgotten_words_are_found_again(monkeypatch):
    texts, kept = [t or "" for t in ODD], TA.Aligner(*PATHS)
    before = kept.block(texts)
    monkeypatch.setattr(TA, "TABLE_WORDS", 3)
    again = kept.block(texts)
    assert again["groups"] == before["groups"] and again["pairs"][1].tolist() == before["pairs"][1].tolist()


def test_galloping_search_finds_what_a_set_finds():
    rng = random.Random(5)
    for _ in range(60):
        top = rng.choice([20, 300, 5000])
        short, long = (np.array(sorted(rng.sample(range(top), rng.randrange(0, top // rng.choice([2, 9])))), dtype=np.int64) for _ in "ab")
        i, j = TA.common_ends(short, long)
        assert short[i].tolist() == long[j].tolist() == sorted(set(short.tolist()) & set(long.tolist()))


def test_large_groups_are_counted_not_spelled_out(monkeypatch):
    rng = np.random.default_rng(1)
    ids = (rng.integers(0, 9, 900), rng.integers(0, 7, 800))
    sizes, doc = (np.array([1, 600, 299]), np.array([2, 700, 98])), np.array([0, 0, 1])
    results = []
    for large, at_once in ((4096, 1 << 22), (0, 10), (1 << 40, 1 << 22), (1 << 40, 5)):
        monkeypatch.setattr(TA, "LARGE_GROUP", large)
        monkeypatch.setattr(TA, "LINKS_AT_ONCE", at_once)
        keys, times = TA.distinct_links(ids, sizes, doc, 7, 63)
        results.append((keys.tolist(), times.tolist()))
    assert results[0] == results[1] == results[2] == results[3]
    assert sum(results[0][1]) == 1 * 2 + 600 * 700 + 299 * 98 and len(results[0][0]) <= 2 * 63
