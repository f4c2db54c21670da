import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from broadloom.llm import token_file
from broadloom.llm.queries import TEXT_QUERIES, TOKENIZERS

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
HARD = ["", None, "a", "\n\n", " lead and  trail ", "it's we'll, don't.", "Ünïcode, STRASSE. Σίσυφος ΟΔΟΣ", "é. ́x", "tab\tand nbsp em\x1cfs",
        "<|endoftext|> x<|startoftext|>y", "12.5,77 ... ,,, 日本語。 👍🏽", "word " * 3000, "A.B,C.", "naïve. café, ﬁ. Ǆ."]


def plain(docs):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_words_are_encoded_like_whole_texts():
    encoder, whole = token_file.WordEncoder(PATH), Tokenizer.from_file(PATH)
    every = " ".join(f"{chr(c)} a{chr(c)}. {chr(c)}B{chr(c)}," for c in range(0x2B0))
    for text in [*HARD, every, "the's x't. ÀÉÎÕÜß ÿŸ", "word<|endoftext|>. A\u0301.", 'say("a-b",c)...x!? it\'s "q\'s" <b>x</b> a|b [é] --ü--', "".join(map(chr, range(33, 127))),
                 " ".join(f"{chr(a)}{chr(b)}x{chr(b)}{chr(a)}" for a in range(33, 127) for b in range(33, 127, 7))]:
        got = np.frombuffer(encoder.encode(text, 2), "<u2").tolist()
        assert got == whole.encode(text or "", add_special_tokens=False).ids + [2], text


def test_round_trip_over_several_files(spark, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_DOCS", 4)
    docs = [(i * 7 - 20, t) for i, t in enumerate(HARD)] + [(None, "no id")]
    df = spark.createDataFrame([(d, t, b"x", 5) for d, t in docs], "doc_id bigint, text string, ids binary, start int").repartition(3)
    files = token_file.write_token_files(df, PATH)
    assert files.files.count() > 3
    got = [tuple(r) for r in files.read().select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == plain(docs)
    few = files.fetch([1, 8, 99]).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in few) == [r for r in plain(docs) if r[0] in (1, 8)]
    assert files.fetch([]).collect() == []


def test_repeated_rows_stay_and_empty_tables_give_nothing(spark):
    docs = [(3, "same text here")] * 400 + [(3, "another"), (1, "first"), (9, None)]
    got = token_file.write_token_files(spark.createDataFrame(docs, "doc_id bigint, text string"), PATH).read()
    rows = sorted((tuple(r) for r in got.select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert [r[1] for r in rows] == [1] + [3] * 401 + [9]
    assert [r[0] for r in rows] == np.r_[0, np.cumsum([r[2] for r in rows])[:-1]].tolist()
    assert sorted(r[3] for r in rows) == sorted(r[3] for r in plain(docs))
    assert token_file.write_token_files(spark.createDataFrame([], "doc_id bigint, text string"), PATH).read().collect() == []


def test_damage_is_noticed(spark):
    from pathlib import Path

    files = token_file.write_token_files(spark.createDataFrame([(i, f"text number {i} " * 30) for i in range(500)], "doc_id bigint, text string"), PATH)
    dictionary = next(Path(files.folder).glob("*.dict"))
    dictionary.write_bytes(dictionary.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="dictionary"):
        files.read().collect()


def test_query_equals_plain(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in TEXT_QUERIES["op12_token_file"].build(spark, sf).collect()), key=lambda r: r[1])
    assert got == plain(docs)
