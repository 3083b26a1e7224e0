"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on ids.

``write_tokens`` deals the rows by ranges of (id, hash of the text), sorts each
range, encodes the texts inside the sorted tasks and lets Spark's ORC writer
commit the files, so a lost task is simply written again. Each row holds the
document id, its token ids and the number of ids before it in its file; the
offsets of the files add up in a prefix sum over one row per file.
``read_tokens`` splits by stripes; ``lookup`` prunes files, stripes and row
groups by the column statistics and the Bloom filter.

Words are encoded once and remembered: the tokenizer drops white space and
never joins across it, nor between Latin letters and most marks behind them, so
a text's ids are its pieces' ids in order.

Defined results: null text is encoded as empty (only the end id); rows with a
null id come first; rows with equal ids are ordered by a hash of the text;
empty input gives files without rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, materialize, scratch, up_to
from .textscan import blocks

#: Pieces of words remembered per worker, and bytes of them and their ids; a piece may be as long as its text.
MEMO, HELD_BYTES = 300_000, 16 << 20
#: Bytes of text handled at once: a block's arrays of numbers take about thirty times that.
BLOCK_BYTES = 1 << 20
OPTIONS = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000",
           "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


#: A byte as the character that byte-level vocabularies have for it (fixed values of that format: printable
#: bytes stand for themselves, the others follow from U+0100 on).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
#: Latin letters, then ASCII marks without the apostrophe: the tokenizer always splits between the two.
_PLAIN = re.compile(r"^(?:([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)|.+)$", re.MULTILINE)


_GAP, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _GAP
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = _MARK


def runs(data: bytes) -> np.ndarray:
    """Where the runs of ``data`` begin and the last one ends: white space, words of letters, the marks right behind
    those, and other words whole. ``data`` begins and ends with white space."""
    buf = np.frombuffer(data, np.uint8)
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf == 0xC3)  # of U+00C0 to U+00FF, letters but for two
    sign = (buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)
    kind[lead[~sign] + 1] = _LETTER
    kind[lead[sign]] = _OTHER
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    before, after = kind[edge - 1], kind[edge]
    cut = (before == _LETTER) & (after == _MARK)
    cut[1:] &= before[:-1] == _GAP
    cut[:-1] &= after[1:] == _GAP
    return np.concatenate([[0], edge[cut | (before == _GAP) | (after == _GAP)], [len(buf)]])


def items(column: pa.LargeBinaryArray) -> list[bytes]:
    """``to_pylist`` without a scalar per value."""
    _, at, data = column.buffers()
    at, data = np.frombuffer(at, np.int64)[: len(column) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(at, at[1:])]


class WordEncoder:
    """Ids of texts, piece by piece.

    A word of Latin letters goes to the vocabulary's own model in the form the
    tokenizer would give it (lower case, bytes as characters), apart from marks
    behind it; any other word goes through the whole tokenizer. The pieces of a
    block of texts are told apart by Arrow, so that only distinct ones are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(open(path, encoding="utf-8").read())
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = [x.get("type") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"]
        if not self.plain:
            raise ValueError(f"{path}: not a tokenizer that splits at white space and lower-cases")
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}  # piece -> its place in ``ends``
        self.ids, self.ends = array("I"), array("q", [0])
        self.held = 0

    def _add(self, piece: bytes, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.known[piece] = found = len(self.ends)
        self.ends.append(len(self.ids))
        self.held += len(piece) + 4 * len(ids)
        return found

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]

    def _letters(self, lower: str) -> list[int]:
        chars = lower if lower.isascii() else lower.encode().decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.model.tokenize(chars)]

    def _learn(self, new: list[bytes]) -> None:
        known = self.known
        # pieces hold no line ends: one search takes all of them apart, in order
        parts = _PLAIN.findall(b"\n".join(new).decode("utf-8", "replace"))
        rest = []
        for piece, (letters, marks) in zip(new, parts):
            if not letters or marks:
                rest.append(piece)
                continue
            lower = letters.lower()
            if lower == letters:
                if piece not in known:
                    self._add(piece, self._letters(lower))
                continue
            key = lower.encode()
            found = known.get(key)
            known[piece] = self._add(key, self._letters(lower)) if found is None else found
        for piece, ids in zip(rest, self._whole([w.decode("utf-8", "replace") for w in rest])):
            self._add(piece, ids)

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.known) > MEMO or self.held > HELD_BYTES:
            self._reset()
        data = b"\n" + b"\n".join(texts) + b"\n"
        at = runs(data)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        names, known = items(pieces.dictionary), self.known
        found = [known.get(x, 0) for x in names]
        if 0 in found:
            new = [x for x, place in zip(names, found) if not place]
            for gap in filter(bytes.isspace, new):
                self._add(gap, [])
            if new := [x for x in new if x not in known]:
                self._learn(new)
            found = [place or known[x] for x, place in zip(names, found)]
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        place = np.array(found, np.int64)
        place = place[pieces.indices.to_numpy()]
        first, n = ends[place - 1], ends[place] - ends[place - 1]
        stop = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.arange(stop[-1]) + np.repeat(first - stop[:-1], n)]
        begin = 1 + np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return out, np.diff(stop[np.searchsorted(at[:-1], begin)], prepend=0)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not texts:
            return []
        ids, n = self.block(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The Python worker's encoder: tasks that follow each other in a worker share its memory of words."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the cores; the library's threads take memory each
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode_batches(path: str, end_id: int):
    def run(batches):
        enc, start = encoder(path), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in blocks(texts, BLOCK_BYTES):
                ids, n = enc.block(texts[lo:hi])
                values = np.insert(ids, np.cumsum(n), end_id).astype(np.int32)
                n = n + 1
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                before = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(before), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(values))],
                    names=["doc_id", "file_start", "n_tokens", "ids"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of every row to ORC files at ``path``, ascending by id."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    d = d.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    kind = d.schema["doc_id"].dataType.simpleString()
    out = map_batches(d, _encode_batches(tokenizer_path, end_id), f"doc_id {kind}, file_start bigint, n_tokens bigint, ids array<int>")
    out.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the store."""
    rows = spark.read.orc(path).withColumn("file", F.input_file_name())
    files = rows.groupBy("file").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("total"))
    # files are numbered in the order of their ranges
    files = files.select(F.col("file"), F.coalesce(F.sum("total").over(
        W.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    files = up_to(materialize(files, "token-files"), 200_000)  # one row per file
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of some documents; ORC statistics and Bloom filters skip the rest."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def _crc_batches(batches):
    for batch in batches:
        lists = batch.column(1)
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], names=["key", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows of :func:`read_tokens`."""
    d = tokens.select(F.struct("doc_id", "start", "n_tokens").alias("key"), "ids")
    out = map_batches(d, _crc_batches, f"key {d.schema['key'].dataType.simpleString()}, ids_crc32 bigint")
    return out.select("key.*", "ids_crc32")


def store(docs: DataFrame, tokenizer_path: str, **kwargs) -> str:
    """Write to a fresh folder in the shared space; returns its path."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, **kwargs)
    return path
