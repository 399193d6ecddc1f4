"""Token ids of whole texts, and their file format with fixed-width bit packing.

A file is a row of blocks. A block holds the documents of a stretch of the order:

    header     magic, bits of an id, number of documents, task, block in the task,
               ids before the block in the task, ids in the block
    doc table  document ids (int64), whether they are set (uint8),
               offsets of the documents in ids (uint64, one more than documents)
    payload    all ids, each in the least number of bits that holds the vocabulary,
               most significant bit first
    newline    as the sink ends its records

Every id takes as many bits, so an offset times that width is the place of any document
or id: a reader unpacks any range with numpy alone (:meth:`Block.ids`).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from stockloom.llm.common import append, expand, written
from stockloom.session import fresh_path

END_ID = 2
#: Words whose ids a worker remembers, half of them those met last; forgetting them costs time only.
CACHE = 600_000
#: Bytes of texts that are split at once.
GROUP = 8_000_000
BLOCK_IDS, BLOCK_DOCS, FILE_BLOCKS = 1 << 20, 1 << 14, 8
_HEADER = struct.Struct("<4sB3xIIIQQ")
_MAGIC = b"TID1"
#: ASCII punctuation but the apostrophe, which may begin a token of letters.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lower-case letters of Latin-1 in UTF-8: one token of the splitter, which normalizing leaves alone.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def bits_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


class Encoder:
    """Ids of texts as little-endian arrays, by a tokenizer whose tokens never cross white space.

    Such a tokenizer (``word_bpe_49k.json`` drops white space before it splits) gives a
    text the ids of its white-space separated words, one after the other. Arrow splits a
    group of texts and finds its distinct words; only these are looked up, and only those
    not met lately are encoded: words of letters many at a time, as their last id alone
    ends a word, all others each by itself. ``end`` is appended to every document.
    """

    def __init__(self, path: str, end: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.end = b"" if end is None else np.array([end], self.dtype).tobytes()
        self.last = np.zeros(self.vocabulary, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str, end: int | None = END_ID) -> Encoder:
        """The one of this Python worker, which serves task after task and so knows its words."""
        if (path, end) not in _ENCODERS:
            _ENCODERS[path, end] = cls(path, end)
        return _ENCODERS[path, end]

    def _encoded(self, tokenizer, texts: list[bytes]) -> list[np.ndarray]:
        found = tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _learn(self, new: list[bytes]) -> None:
        plain, letters, others = [], [], []
        for w in new:
            if _PLAIN(w):
                plain.append(w)
            else:
                (letters if w.decode("utf-8", "replace").isalpha() else others).append(w)
        for tokenizer, words in ((self.plain, plain), (self.tokenizer, letters)):
            groups = [words[i:i + 500] for i in range(0, len(words), 500)]
            for group, ids in zip(groups, self._encoded(tokenizer, [b" ".join(g) for g in groups]), strict=True):
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group) and ends[-1] == len(ids):
                    data, at, step = ids.tobytes(), 0, self.dtype.itemsize
                    for w, e in zip(group, (ends * step).tolist(), strict=True):
                        self.known[w] = data[at:e]
                        at = e
                else:
                    others += group
        self.known.update((w, i.tobytes()) for w, i in zip(others, self._encoded(self.tokenizer, others), strict=True))

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {b"": b""}
        known, older, new, tailed = self.known, self.older, {}, []
        found = list(map(known.get, words))
        gaps = [k for k, i in enumerate(found) if i is None]
        # Letters with punctuation behind are two tokens of the splitter; the case of ASCII letters makes no difference.
        for k in gaps:
            w = stem = words[k]
            if not _PLAIN(w):
                stem = w.rstrip(_PUNCTUATION)
                if stem.isalpha():
                    stem = stem.lower()
                elif not stem or stem.isascii() or not stem.decode("utf-8", "replace").lower().isalpha():
                    stem = w
                tail = w[len(stem):]
                tailed.append((k, stem, tail))
                if tail not in known:
                    new[tail] = None
            if stem not in known:
                if stem in older:
                    known[stem] = older[stem]
                else:
                    new[stem] = None
        self._learn(list(new))
        for k, stem, tail in tailed:
            found[k] = known[stem] + known[tail]
        for k in gaps:
            if found[k] is None:
                found[k] = known[words[k]]
        return found

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text (UTF-8; None is empty) with the end id."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP:
                data = texts[at] or b""
                # Unless a combining mark or a special token could follow, ASCII letters may be lower-cased beforehand.
                group.append(data if b"\xcc" in data or b"\xcd" in data or b"<|" in data else data.lower())
                size += len(data)
                at += 1
            raw = pa.array(group, pa.large_binary())
            # Bytes are split as they are, valid UTF-8 or not; white space at an end of a text gives an empty word.
            words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers()))
            coded = words.values.dictionary_encode()
            found = self._look_up(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
            ids = pa.array(found, pa.large_binary()).take(coded.indices)
            _, places, data = ids.buffers()
            places = np.frombuffer(places, np.int64)[words.offsets.to_numpy()].tolist()
            for a, b in zip(places, places[1:]):
                yield data[a:b].to_pybytes() + self.end


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, most significant first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    out, step = [], 1 << 16  # a multiple of 8 ids ends on a byte
    for i in range(0, len(ids), step):
        wide = np.unpackbits(ids[i:i + step].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(wide[:, 32 - bits:].reshape(-1)).tobytes())
    return b"".join(out)


def unpack(payload: bytes | memoryview, bits: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a payload, reading only their bytes."""
    first, last = start * bits // 8, -(-end * bits // 8)
    raw = np.frombuffer(payload[first:last], np.uint8)
    if bits in (8, 16, 32):
        return raw.view(f">u{bits // 8}").astype(np.uint32)
    out, step = [np.zeros(0, np.uint32)], 1 << 16
    for i in range(start, end, step):
        j = min(end, i + step)
        a = i * bits - first * 8
        part = np.unpackbits(raw[a // 8:-(-(j * bits - first * 8) // 8)])[a % 8:a % 8 + (j - i) * bits].reshape(-1, bits)
        wide = np.zeros((j - i, 32), np.uint8)
        wide[:, 32 - bits:] = part
        out.append(np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32))
    return np.concatenate(out)


def block_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, task: int, number: int, before: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    return b"".join([
        _HEADER.pack(_MAGIC, bits, len(ids), task, number, before, int(offsets[-1])),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        offsets.tobytes(), pack(np.concatenate(ids), bits)])


class Block:
    """A block at ``at`` in the content of a file; ``end`` is where the next one starts."""

    def __init__(self, content: memoryview, at: int):
        magic, self.bits, n, self.task, self.number, self.before, total = _HEADER.unpack_from(content, at)
        if magic != _MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += _HEADER.size
        ids, given = np.frombuffer(content, "<i8", n, at), np.frombuffer(content, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(d) if g else None for d, g in zip(ids, given, strict=True)]
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        self.end = at + -(-total * self.bits // 8) + 1
        self.payload = content[at:self.end - 1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the block."""
        return unpack(self.payload, self.bits, int(self.offsets[i]), int(self.offsets[i + 1]))


def blocks(content: bytes) -> Iterator[Block]:
    view, at = memoryview(content), 0
    while at < len(view):
        block = Block(view, at)
        at = block.end
        yield block


def write_files(docs: DataFrame, path: str, tokenizer: str, end: int | None = END_ID) -> None:
    """Writes the ids of all documents to binary files below ``path``, in ascending doc_id order.

    Nulls come first, rows with one doc_id in the order of a hash of their text. A null
    text is empty: it has the end id alone. The files go through Spark's writer, so a task
    that is run again leaves no trace; file names ascend with the order.
    """
    def make():
        from pyspark import TaskContext

        encoder, task = Encoder.shared(tokenizer, end), TaskContext.get().partitionId()
        bits = bits_of(encoder.vocabulary)

        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            names, ids, held, number, before = [], [], 0, 0, 0
            for b in batches:
                for name, data in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    names.append(name)
                    ids.append(np.frombuffer(data, encoder.dtype))
                    held += len(ids[-1])
                    if held >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                        yield (block_bytes(names, ids, bits, task, number, before),)
                        names, ids, held, number, before = [], [], 0, number + 1, before + held
            if ids:
                yield (block_bytes(names, ids, bits, task, number, before),)
        return function

    tie = F.xxhash64("text")
    order = docs.select("doc_id", "text").withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (expand(order.select("doc_id", "text"), "block binary", make, rows=FILE_BLOCKS)
     .select(F.col("block").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", FILE_BLOCKS).text(path))


def read_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, task, first (ids before it in the task), n_tokens, ids_crc32."""
    def make():
        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for content in b.column(0):
                    for block in blocks(content.as_buffer()):
                        for i, doc_id in enumerate(block.doc_ids):
                            ids = block.ids(i)
                            yield doc_id, block.task, block.before + int(block.offsets[i]), len(ids), crc32(ids)
        return function

    files = spark.read.format("binaryFile").load(path).select("content")
    return expand(files, "doc_id long, task long, first long, n_tokens long, ids_crc32 long", make)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and returns doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before one: its place in its task, kept in
    the files, and the sum over the tasks before (a row for each task).
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    write_files(docs, path, tokenizer)
    rows = written(read_files(spark, path), "token-rows")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("task").agg(F.sum("n_tokens").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(tasks, "task").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def with_ids(docs: DataFrame, tokenizer: str, end: int | None = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, two bytes each if the vocabulary allows, else four), n_tokens."""
    def make():
        encoder = Encoder.shared(tokenizer, end)

        def function(texts: list[bytes | None]) -> Iterator[tuple]:
            return ((ids, len(ids) // encoder.dtype.itemsize) for ids in encoder.encode(texts))
        return function

    return append(docs.select("doc_id", "text"), "text", "ids binary, n_tokens long", make).drop("text")
