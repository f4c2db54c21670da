"""Token ids in binary files: one zstandard frame per document, one dictionary for all, an index for single documents.

A file is

    header   8 bytes MAGIC, 1 byte width of an id, 32 bytes SHA-256 of the dictionary (zeros: none)
    frames   one zstandard frame per document: its ids, little-endian, ``width`` bytes each
    index    zstandard frame of 4 columns: doc_id (int64), whether it is NULL (uint8), end of the frame (uint64), ids
             before the document's end within the file (uint64)
    footer   start of the index (uint64), documents (uint64), CRC-32 of the index (uint32), 8 bytes MAGIC

The dictionary lies beside the files under the name of its hash. Files are written by the tasks that hold the sorted
documents; a table lists the files of the attempts that succeeded, others are never read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.llm.bpe import _byte_of_symbol as byte_of_symbol
from broadloom.llm.common import slices, worker_state
from broadloom.session import durable, new_path

MAGIC = b"BLTOKEN1"
HEADER, FOOTER = "<8sB32s", "<QQI8s"
HEADER_SIZE, FOOTER_SIZE = struct.calcsize(HEADER), struct.calcsize(FOOTER)
#: A file is closed beyond so many bytes of frames or documents (24 bytes each are held until then).
FILE_BYTES, FILE_DOCS = 128 << 20, 1 << 20
WORDS_KEPT = 400_000
#: A run of such letters is one piece for this family of vocabularies, and is its own normal form but for the case; so is
#: a run of ASCII marks, apostrophes (endings) and angle brackets (special tokens) left aside.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
RUN = re.compile(LATIN.pattern + r"""|[!"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]+""")
RUNS = re.compile(f"(?:{RUN.pattern})+")


class WordEncoder(dict):
    """Ids of a text, words remembered: the vocabulary drops white space, so no id spans a blank or line feed, and the
    normal form of a word does not depend on what lies beyond them. As a dict: bytes of a word's ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        self.tokenizer = Tokenizer.from_file(path)
        # Letters go straight to the merges: lower case, each byte as the character that stands for it.
        self.merges, symbol = self.tokenizer.model, {b: c for c, b in byte_of_symbol().items()}
        self.letters = {chr(c): "".join(symbol[b] for b in chr(c).lower().encode()) for c in range(256) if LATIN.fullmatch(chr(c))}
        self.letters = str.maketrans(self.letters)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.before: dict[str, bytes] = {}

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:  # the words of late stay at hand, those of before go
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            if LATIN.fullmatch(word):
                ids = self._bytes([t.id for t in self.merges.tokenize(word.translate(self.letters))])
            elif RUNS.fullmatch(word) and len(runs := RUN.findall(word)) > 1:
                ids = b"".join(map(self.__getitem__, runs))
            else:
                ids = self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.kind.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str | None, end: int) -> bytes:
        words = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, words)) + self.kind.type(end).tobytes()


def _encoder(path: str) -> WordEncoder:
    return worker_state(f"word_encoder_{path}", lambda: WordEncoder(path))


def _encode(path, end, batches):
    encoder = _encoder(path)
    for batch in slices(batches):
        yield pa.record_batch([pa.array([encoder.encode(t, end) for t in batch.column("text").to_pylist()], pa.binary())], names=["ids"])


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves; nothing for none."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


class FileWriter:
    """One file under construction; ``add`` takes the documents in order."""

    def __init__(self, folder: str, kind: np.dtype, dictionary: bytes, compressor):
        store, base = _open(folder)
        self.name, self.kind, self.compress = f"{uuid.uuid4().hex}.tok", kind, compressor
        self.out = store.open_output_stream(f"{base}/{self.name}")
        self.out.write(struct.pack(HEADER, MAGIC, kind.itemsize, hashlib.sha256(dictionary).digest() if dictionary else bytes(32)))
        self.at, self.ids, self.index = HEADER_SIZE, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.out.write(frame)
        self.at += len(frame)
        self.ids += len(ids) // self.kind.itemsize
        self.index.append((doc_id, self.at, self.ids))

    def full(self) -> bool:
        return self.at >= FILE_BYTES or len(self.index) >= FILE_DOCS

    def close(self) -> None:
        import zstandard

        docs, ends, counts = zip(*self.index)
        columns = (np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), np.array(ends, "<u8"), np.array(counts, "<u8"))
        block = zstandard.ZstdCompressor().compress(b"".join(c.tobytes() for c in columns))
        self.out.write(block)
        self.out.write(struct.pack(FOOTER, self.at, len(self.index), zlib.crc32(block), MAGIC))
        self.out.close()


FILES = "file string, first_doc bigint, first_tie bigint, first_salt bigint, last_doc bigint, docs bigint, ids bigint, bytes bigint"


def _write(folder, path, end, level, sent, batches):
    import zstandard

    encoder, content = _encoder(path), sent.value
    compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(content)).compress
    writer = first = last = None

    def listed():
        writer.close()
        row = (writer.name, *first, last, len(writer.index), writer.ids, writer.at)
        kinds = [pa.string()] + [pa.int64()] * 7
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in FILES.split(", ")])

    for batch in slices(batches):
        for doc, tie, salt, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "salt", "text"))):
            if writer is None:
                writer, first = FileWriter(folder, encoder.kind, content, compressor), (doc, tie, salt)
            writer.add(doc, encoder.encode(text, end))
            last = doc
            if writer.full():
                yield listed()
                writer = None
    if writer is not None:
        yield listed()


@dataclass
class TokenFiles:
    """The written files: their folder, and one row per file with the documents and ids it holds."""
    folder: str
    files: DataFrame

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, ids) of every document, in tasks of whole files. ``ids`` are
        little-endian unsigned 32-bit numbers; ``start`` counts the ids of all documents before."""
        return self._tasks(None)

    def fetch(self, doc_ids: list[int]) -> DataFrame:
        """The same for single documents: files whose range of ids has none of them are not opened, of the others only
        the index and the frames asked for are read."""
        return self._tasks(sorted(set(doc_ids)))

    def _tasks(self, wanted):
        files = self.files
        if wanted is not None:
            inside = [F.lit(i).between(F.coalesce("first_doc", F.lit(-(1 << 63))), F.col("last_doc")) for i in wanted]
            files = files.filter(F.array_contains(F.array(*inside), True) if inside else F.lit(False))
        spread = files.select("file", "start").repartition(max(1, files.count()))  # a task each, however short the list
        return spread.mapInArrow(partial(_read, self.folder, wanted), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def _read(folder, wanted, batches):
    import zstandard

    store, base = _open(folder)
    known = {}
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            with store.open_input_file(f"{base}/{name}") as f:
                magic, width, digest = struct.unpack(HEADER, f.read(HEADER_SIZE))
                f.seek(f.size() - FOOTER_SIZE)
                at, docs, crc, closing = struct.unpack(FOOTER, f.read(FOOTER_SIZE))
                if magic != MAGIC or closing != MAGIC:
                    raise ValueError(f"{name} is no token file")
                f.seek(at)
                block = f.read(f.size() - FOOTER_SIZE - at)
                if zlib.crc32(block) != crc:
                    raise ValueError(f"{name}: damaged index")
                if digest not in known:
                    known[digest] = zstandard.ZstdDecompressor(dict_data=_dictionary(_named(store, base, digest)))
                plain = zstandard.ZstdDecompressor().decompress(block)
                ids, null, ends, counts = (np.frombuffer(plain, t, docs, o * docs) for t, o in (("<i8", 0), ("u1", 8), ("<u8", 9), ("<u8", 17)))
                rows = np.arange(docs) if wanted is None else np.flatnonzero(np.isin(ids, wanted) & (null == 0))
                f.seek(HEADER_SIZE)
                for i in range(0, len(rows), 64):
                    yield _decoded(f, known[digest], width, start, rows[i:i + 64], ids, null, ends, counts)


def _named(store, base, digest):
    if digest == bytes(32):
        return b""
    with store.open_input_file(f"{base}/{digest.hex()}.dict") as f:
        content = f.read()
    if hashlib.sha256(content).digest() != digest:
        raise ValueError("the dictionary is not the one the file was written with")
    return content


def _decoded(f, frames, width, start, rows, ids, null, ends, counts):
    out = []
    for i in rows.tolist():
        begin = int(ends[i - 1]) if i else HEADER_SIZE
        if f.tell() != begin:
            f.seek(begin)
        data = frames.decompress(f.read(int(ends[i]) - begin))
        wide = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
        out.append((None if null[i] else int(ids[i]), start + (int(counts[i - 1]) if i else 0), len(wide) // 4, zlib.crc32(wide), wide))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def write_token_files(docs: DataFrame, vocabulary: str, end: int = 2, doc_id: str = "doc_id", text: str = "text", level: int = 3,
                      sample_docs: int = 2000, sample_bytes: int = 1 << 16, dictionary_bytes: int = 1 << 15) -> TokenFiles:
    """Encode whole texts, append ``end`` to each, and write them in ascending order of doc_id (NULL first).

    NULL and empty texts are the closing id alone. Rows of one doc_id follow each other by a hash of the text; rows that
    repeat stay all and are spread by a number of the row, so that a doc_id with a third of the rows fills many tasks.
    No documents give no files. Integer ids only; other columns play no part.

    The dictionary is trained on about ``sample_docs`` documents of at most ``sample_bytes``, chosen by hash; it has no
    influence on what is read back. The texts move once, through the range exchange; the scratch folder must be of a
    kind that pyarrow opens (local or mounted paths, hdfs, s3, gs, abfs).
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = plain.withColumn("tie", F.xxhash64("text"))
    h = F.pmod(F.xxhash64("doc", "tie"), F.lit(1 << 40))
    share = int(min(1.0, sample_docs / max(plain.count(), 1)) * (1 << 40))
    few = rows.filter((h < share) & F.octet_length("text").between(1, sample_bytes)).select(h.alias("h"), "text").dropDuplicates(["h"])
    samples = [bytes(r.ids) for r in few.select("text").mapInArrow(partial(_encode, vocabulary, end), "ids binary").limit(2 * sample_docs).collect()]
    content = train_dictionary(sorted(samples), dictionary_bytes) if samples else b""

    folder = new_path(spark, "tokens")
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    if content:
        with store.open_output_stream(f"{base}/{hashlib.sha256(content).hexdigest()}.dict") as f:
            f.write(content)
    sent = spark.sparkContext.broadcast(content)
    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("doc", "tie", "salt").sortWithinPartitions("doc", "tie", "salt")
    files = durable(ordered.select("doc", "tie", "salt", "text").mapInArrow(partial(_write, folder, vocabulary, end, level, sent), FILES))
    return TokenFiles(folder, durable(_with_starts(files)))


def _with_starts(files: DataFrame) -> DataFrame:
    """Ids in all files before: a running sum over the list of files, one row for 128 MB."""
    from pyspark.sql import Window as W

    before = W.orderBy(F.asc_nulls_first("first_doc"), "first_tie", "first_salt").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("bigint"))
