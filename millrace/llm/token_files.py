"""Token ids in flat binary files that can be memory-mapped.

A folder holds shards and ``manifest.json``. Shard ``name`` is three little-endian files: ``name.bin``, the ids of its
documents in a row (unsigned, 16 bits if the vocabulary fits, else 32); ``name.off``, n + 1 offsets of 64 bits into
them; ``name.doc``, n document ids of 64 bits (the least such number stands for a null id). Shards follow each other
in ascending order of doc_id; the manifest gives the base of each, the prefix sum of ids before it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import kernels as K
from millrace.llm.lexicon import Lexicon
from millrace.llm.stage import parts, text_bytes, texts_of, written
from millrace.session import local_frame

NO_ID = np.iinfo(np.int64).min
SHARD = "shard int, name string, n_docs long, n_tokens long"
_lexicons: dict = {}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def lexicon(tokenizer: str) -> tuple[PartEncoder, Lexicon]:
    """The parts of a tokenizer whose pre-tokenizer never crosses white space, so words can be encoded apart."""
    if tokenizer not in _lexicons:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = PartEncoder(Tokenizer.from_file(tokenizer))
        _lexicons[tokenizer] = own, Lexicon(own)
    return _lexicons[tokenizer]


# Fixed value: the pre-tokenizer pattern whose parts ``PartEncoder.spans`` finds, and the normaliser it goes with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWERS = ["NFC", "Replace", "Lowercase"]
LETTER, DIGIT, SIGN, ODD = 1, 2, 3, 4


class PartEncoder:
    """Finds the parts of words and encodes distinct ones, many in one call of the library.

    Words of Latin letters (to U+024F), digits and signs are cut into runs of letters, single digits and runs of
    signs, and lower-cased, so "Word" and "word," share a part. Each part ends in one of the vocabulary's word ends,
    which tells the ids of a call apart. Words with an apostrophe, other characters, or one that a special token
    begins with stay whole and are encoded one by one; so are all words of a tokenizer with other rules.
    """

    CHUNK = 500

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        own = json.loads(tokenizer.to_str())
        patterns = re.findall(r'"Regex": ("(?:[^"\\]|\\.)*")', json.dumps(own["pre_tokenizer"]))
        suffix, steps = own["model"].get("end_of_word_suffix"), [n["type"] for n in (own["normalizer"] or {}).get("normalizers", [])]
        self.cuts = bool(suffix) and [json.loads(p) for p in patterns] == [PATTERN] and steps == LOWERS
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in tokenizer.get_vocab().items() if suffix and piece.endswith(suffix)]] = True
        kind = np.full(256, ODD, np.uint8)
        kind[0x21:0x7F] = SIGN
        kind[list(range(65, 91)) + list(range(97, 123)) + list(range(0x80, 0xC0)) + list(range(0xC3, 0xCA))] = LETTER
        kind[48:58] = DIGIT
        kind[[ord("'"), *{t["content"].encode()[0] for t in own["added_tokens"] if t["content"]}]] = ODD
        self.kind = kind

    def spans(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and where parts start and end in them; and where those of each text begin."""
        words, data = K.Words(texts), texts.data
        if not self.cuts or not len(words.start):
            return data, words.start, words.end, words.offsets
        kind, before = self.kind[data], np.r_[np.uint8(0), data[:-1]]
        odd = kind == ODD
        odd |= (before == 0xC3) & ((data == 0x97) | (data == 0xB7)) | (before == 0xC4) & (data == 0xB0) | (before == 0xC9) & (data >= 0x90)
        seen = np.r_[0, np.cumsum(odd)]
        plain = seen[words.end] == seen[words.start]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.start[plain]] += 1
        inside[words.end[plain]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        first = np.zeros(len(data), bool)
        first[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        first[words.start] = True
        start = np.flatnonzero(first)
        end = np.minimum(np.r_[start[1:], len(data)], words.end[np.searchsorted(words.start, start, "right") - 1])
        return np.where(inside, K.LOWER[data], data), start, end, np.searchsorted(start, texts.offsets)

    def __call__(self, parts: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        out: list = [None] * len(texts)
        if self.cuts:
            joined = np.frombuffer(b"".join(parts), np.uint8)
            odd = np.r_[0, np.cumsum((self.kind[joined] == ODD) | (joined == 0xB0) | (joined == 0x97) | (joined == 0xB7) | (joined == 0xC9))]
            ends = np.cumsum([len(p) for p in parts])
            plain = np.flatnonzero(odd[ends] == odd[np.r_[0, ends[:-1]]]).tolist()
            for a in range(0, len(plain), self.CHUNK):
                own = plain[a : a + self.CHUNK]
                ids = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in own])], add_special_tokens=False)[0].ids
                last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(last) == len(own) and last[-1] == len(ids):
                    for i, s, e in zip(own, [0, *last], last):
                        out[i] = ids[s:e]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


def shard_rows(tokenizer: str, end_id: int, kind: str, folder: str):
    """Write a partition, sorted by doc_id, as one shard. An attempt has files of its own; the row returned names them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, (encoder, own) = task.partitionId(), lexicon(tokenizer)
        name = f"shard-{shard:06d}-{task.taskAttemptId()}"
        files, path = opened(folder)
        n_docs = n_tokens = 0
        streams = {}
        for batch in batches:
            if batch.num_rows and not streams:
                streams = {end: files.open_output_stream(f"{path}/{name}.{end}") for end in ("bin", "off", "doc")}
                streams["off"].write(np.zeros(1, "<i8").tobytes())
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
            for texts in K.slices(batch.column("text")):
                flat, offsets = own.ids(*encoder.spans(texts))
                flat = np.insert(flat, offsets[1:], end_id)
                ends = offsets[1:] + np.arange(1, texts.n + 1)
                streams["bin"].write(flat.astype(kind).tobytes())
                streams["off"].write((n_tokens + ends).astype("<i8").tobytes())
                n_tokens += len(flat)
                n_docs += texts.n
            if batch.num_rows:
                streams["doc"].write(ids.tobytes())
        for stream in streams.values():
            stream.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": n_docs, "n_tokens": n_tokens}], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return rows


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = 64 << 20) -> dict:
    """Write the ids of every whole text, ``end_id`` behind each, in ascending doc_id order; return the manifest.

    A null or empty text is its end id alone. Null ids come first; rows of one id are ordered by a hash of the text.
    No rows give a manifest without shards. Other columns are ignored. What a lost task left is not in the manifest.
    """
    from tokenizers import Tokenizer

    d = texts_of(docs)
    spark = d.sparkSession
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    ordered = d.repartitionByRange(parts(spark, text_bytes(d), shard_bytes), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = written(ordered.mapInArrow(shard_rows(tokenizer, end_id, kind, folder), SHARD), "shards").orderBy("shard").collect()  # a row for each shard
    base, shards = 0, []
    for row in done:
        shards.append({"name": row.name, "n_docs": row.n_docs, "n_tokens": row.n_tokens, "base": base})
        base += row.n_tokens
    manifest = {"kind": kind, "n_tokens": base, "shards": shards}
    with files.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def mapped(files: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a file system, else read."""
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with files.open_input_file(path) as source:
        return np.frombuffer(source.read(), kind)


def document_rows(folder: str, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                flat, off, doc = (mapped(files, f"{path}/{shard['name']}.{end}", k) for end, k in (("bin", kind), ("off", "<i8"), ("doc", "<i8")))
                for a in range(0, len(doc), 2000):
                    own, ends = np.array(doc[a : a + 2000]), np.array(off[a : a + 2001])
                    wide = np.asarray(flat[ends[0] : ends[-1]]).astype("<u4")
                    crc = [zlib.crc32(wide[s:e]) for s, e in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NO_ID), pa.array(ends[:-1] + shard["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return rows


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as unsigned 32-bit)."""
    files, path = opened(folder)
    with files.open_input_file(f"{path}/manifest.json") as source:
        manifest = json.loads(source.read())
    shards = local_frame(spark, [(s["name"], s["base"]) for s in manifest["shards"]], "name string, base long")
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(document_rows(folder, manifest["kind"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
