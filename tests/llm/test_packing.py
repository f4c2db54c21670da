import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from broadloom.llm import bpe, packing
from broadloom.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
TEXTS = ["", None, "one", "two  blanks", " lead", "trail ", "tab\tand\nline \n mixed", "a b c d", "<|endoftext|> inside <|endoftext|>", "ünïcode 漢字 🙂 x",
         "it's 'quoted' 123 4a", "\x1c \x1d", "line\nline word", "“curly” quotes", "a" * 5000, "　wide", "x\u0085y z"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_distinct_pieces_give_the_tokenizer_s_ids(tokenizer):
    encoder, rng = bpe.Encoder(PATH), random.Random(4)
    alphabet = ["word", "Wörd", "x1", "'s", "don't", ".", ",", " ", "  ", "\n", "\t", "漢", " ", "é", "12", "!?", "\r\n", "🙂"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for few in (texts, texts[:1], texts[2:3], [" "], []):
        ids, stop = encoder.encode([t.encode() for t in few], 7)
        assert len(stop) == len(few) and len(ids) == (stop[-1] if few else 0)
        for t, got in zip(few, np.split(ids, stop[:-1])):
            assert got.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 7], repr(t)
    assert encoder.encode([None, b"\xff a"], 7)[0].tolist() == [7, *tokenizer.encode("\ufffd a", add_special_tokens=False).ids, 7]


def verify(rows, docs, tokenizer):
    left = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    got = []
    for p in pieces.values():
        p.sort(key=lambda r: r.start)
        while p:  # rows that repeat an id: any of its pieces that continue
            ids, total = [], None
            for r in list(p):
                if r.start == len(ids) and total in (None, r.doc_tokens):
                    ids += r.ids
                    total = r.doc_tokens
                    p.remove(r)
                    if len(ids) == total:
                        break
            assert len(ids) == total
            got.append(ids)
    assert sorted(got) == left
    return sequences


def test_every_id_lies_in_one_piece(spark, tokenizer):
    rng = random.Random(5)
    docs = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma", f"w{i % 7}", f"u{rng.randrange(999)}"])
                                                        for _ in range(rng.randrange(1, 1500)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, start int")
    rows = packing.pack_documents(df, PATH, shard_docs=30, with_ids=True).collect()
    sequences = verify(rows, docs, tokenizer)
    padding = sum(1024 - n for n in (sum(r.length for r in s) for s in sequences.values()) if n & (n - 1))
    assert padding <= 1024 * 4


def test_repeated_rows_null_ids_and_empty_table(spark, tokenizer):
    docs = [(1, "same text"), (1, "same text"), (None, "no id"), (2, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    verify(packing.pack_documents(df, PATH, with_ids=True).collect(), docs, tokenizer)
    assert packing.pack_documents(df.limit(0), PATH).collect() == []


def test_neighbours_that_share_rare_words_come_first():
    tails = [np.array([1, 2, 3, 900, 901]), np.array([1, 2, 8, 4]), np.array([1, 5, 900, 901]), np.array([1, 7, 8, 9])]
    index = packing.Index(tails)
    scores = index.scores(0)
    assert scores[2] > scores[1] > scores[3]
    n, mean = 4, np.mean([5, 4, 4, 4])
    weight = lambda df, length: np.log1p((n - df + .5) / (df + .5)) * 2.2 / (1 + 1.2 * (.25 + .75 * length / mean))
    assert scores[2] == pytest.approx(weight(4, 4) + 2 * weight(2, 4))


def test_documents_on_one_matter_share_a_shard(spark):
    rng, topics = random.Random(6), ["river", "music", "engine", "garden", "planet", "court", "bread", "winter"]
    docs = []
    for i in range(160):
        w = ["the"] * 40 + [topics[i % 8]] * 6 + [f"w{rng.randrange(300)}" for _ in range(20)]
        rng.shuffle(w)
        docs.append((i, " " + " ".join(w)))
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), PATH, shard_docs=20).collect()
    shards = defaultdict(lambda: defaultdict(set))
    for r in rows:
        shards[r.doc_id % 8][r.sequence_id >> 32].add(r.doc_id)
    assert sum(max(map(len, s.values())) for s in shards.values()) >= 0.7 * len(docs)


def test_scores_go_by_the_corpus_and_whole_documents():
    tails = [np.array([1, 2]), np.array([1, 8]), np.array([2, 9])]
    idf = packing._idf(np.arange(10), 10)
    corpus = packing.Corpus([np.array([1, 2, 5]), np.array([1, 5, 8]), np.array([2, 9])], [np.array([1, 1, 3]), np.array([1, 2, 1]), np.array([1, 1])],
                            np.array([5., 4., 2.]), idf, 3.0)
    weight = lambda term, tf, length: idf[term] * tf * 2.2 / (tf + 1.2 * (.25 + .75 * length / 3))
    scores = packing.Index(tails, corpus).scores(0)
    assert scores[1] == pytest.approx(weight(1, 1, 4) + weight(5, 2, 4)) and scores[2] == pytest.approx(weight(2, 1, 2))


def test_ids_of_whole_windows_are_not_moved(spark, tokenizer, monkeypatch):
    rng, moved, frame = random.Random(8), [], type(spark.range(1))
    repartition = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *by: moved.append(df) or repartition(df, *by))
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randrange(99)}"]) for _ in range(rng.choice([10, 900, 5000])))) for i in range(40)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), PATH, shard_docs=7, with_ids=True).collect()
    verify(rows, docs, tokenizer)
    assert any(r.doc_tokens > 4096 for r in rows)
    table, = moved
    assert "whole" not in table.columns and max(len(r.ids) for r in table.select("ids").collect()) < 2 * 1024  # two bytes an id
