"""Encode a whole corpus with a public byte-level BPE tokenizer, reusing content-defined chunks.

Texts are cut where a rolling hash of their bytes says so, so equal passages give equal
chunks wherever they stand. Each distinct chunk is encoded once; where chunks meet, the
text between the nearest certain token boundaries of both sides is encoded again, which
makes the joined ids equal to those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; the path is a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer pattern published with the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A cut falls on one byte position in 2**MASK_BITS; chunks have MIN_BYTES to MAX_BYTES.
MASK_BITS, MIN_BYTES, MAX_BYTES = 8, 96, 4096

#: Before a single space between two word characters there is always a token boundary: no
#: token of the pattern holds a space after a visible character.
_CERTAIN = re.compile(r"(?<=\w) (?=\w)")
_LAST_CERTAIN = re.compile(r".*(?<=\w)( )(?=\w)", re.S)


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of all texts of a batch, as positions in its bytes, and the text of each.

    A position is a candidate when the hash of the eight bytes before it has MASK_BITS zero
    bits and a character begins there. Every text, empty ones too, gets at least one chunk.
    """
    n = len(data)
    cand = np.zeros(0, np.int64)
    if n >= 9:
        x = data.astype(np.uint64)
        two = x[:-1] | (x[1:] << np.uint64(8))
        four = two[:-2] | (two[2:] << np.uint64(16))
        eight = four[:-4] | (four[4:] << np.uint64(32))
        mixed = (eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MASK_BITS)
        cand = np.flatnonzero(mixed == 0) + 8
        cand = cand[cand < n]
        cand = cand[(data[cand] & 0xC0) != 0x80]
    out, owner = [], []
    lo, hi = np.searchsorted(cand, starts + MIN_BYTES), np.searchsorted(cand, ends)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        last = s
        for c in cand[lo[i] : hi[i]].tolist():
            while c - last > MAX_BYTES:
                last = _forced(data, last + MAX_BYTES)
                out.append(last)
                owner.append(i)
            if c - last >= MIN_BYTES and e - c >= MIN_BYTES:
                out.append(c)
                owner.append(i)
                last = c
        while e - last > MAX_BYTES + MIN_BYTES:
            last = _forced(data, last + MAX_BYTES)
            out.append(last)
            owner.append(i)
        out.append(e)
        owner.append(i)
    return np.array(out, np.int64), np.array(owner, np.int64)


def _forced(data: np.ndarray, at: int) -> int:
    while (data[at] & 0xC0) == 0x80:
        at -= 1
    return at


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        key, text = batch.column(0), batch.column(1)
        text = text.fill_null("").cast(pa.large_string())
        text = pa.concat_arrays([text]) if text.offset == 0 else pa.array(text.to_pylist(), pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8, int(offsets[-1])) if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
        ends, owner = cut_points(data, offsets[:-1], offsets[1:])
        first = np.r_[True, owner[1:] != owner[:-1]]
        begins = np.where(first, offsets[:-1][owner], np.r_[0, ends[:-1]])
        view = memoryview(data)
        digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
        if with_text:
            bounds = pa.py_buffer(np.r_[begins[:1], ends].astype(np.int64).tobytes())
            chunks = pa.LargeStringArray.from_buffers(len(ends), bounds, raw if raw is not None else pa.py_buffer(b""))
            table = pa.table({"digest": pa.array(digests, pa.binary()), "chunk": chunks.cast(pa.string())})
            # copies within the batch go no further
            table = table.group_by("digest", use_threads=False).aggregate([("chunk", "first")]).rename_columns(["digest", "chunk"])
            yield from table.to_batches()
        else:
            seq = np.arange(len(ends)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            whole = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(owner)), pa.array(whole[owner]), pa.array(seq.astype(np.int32)), pa.array(digests, pa.binary())],
                names=["doc_id", "whole", "seq", "digest"],
            )


def _cut_digests(batches):
    return _cut(batches, False)


def _cut_texts(batches):
    return _cut(batches, True)


def encoder(vocabulary: bytes):
    """``text -> list of ids`` of the vocabulary file's content; special strings are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def split_certain(chunk: str) -> tuple[str, str | None, str]:
    """Text before the first, between, and after the last certain boundary; no core without one."""
    first = _CERTAIN.search(chunk)
    if first is None:
        return chunk, None, ""
    last = _LAST_CERTAIN.match(chunk)
    a, b = first.start(), last.start(1)
    return chunk[:a], chunk[a:b], chunk[b:]


def _encode_chunks(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value)
        for batch in batches:
            heads, cores, tails = [], [], []
            for chunk in batch.column(1).to_pylist():
                head, core, tail = split_certain(chunk)
                heads.append(head)
                cores.append(None if core is None else np.array(encode(core), np.uint32).astype("<u2").tobytes())
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string()), pa.array(cores, pa.binary()), pa.array(tails, pa.string())], names=["digest", "head", "core", "tail"])

    return run


def join_ids(parts: list[dict], encode) -> list[int]:
    """Ids of one text from its chunks in order: cores as they are, everything between encoded again."""
    ids: list[int] = []
    pending = ""
    for part in parts:
        pending += part["head"] or ""
        if part["core"] is not None:
            if pending:
                ids += encode(pending)
            ids += np.frombuffer(part["core"], "<u2").tolist()
            pending = part["tail"] or ""
    if pending:
        ids += encode(pending)
    return ids


def _assemble(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                out = [join_ids(parts, encode) for parts in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_corpus(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every document's text, without special tokens.

    ``vocabulary`` is the path of a byte-level BPE rank file of at most 65,536 ids.

    Nulls: a null or empty text gives an empty list; a null id is kept as it is. Repeated
    rows count once; one id with two texts gives a row for each. Very long texts are cut
    into chunks of at most MAX_BYTES, and one text is joined in one task, as one row needs.
    Ties do not occur. An empty table gives an empty table. Other columns are not read, so
    their names cannot clash.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.mapInArrow(_cut_digests, f"doc_id {id_type}, whole long, seq int, digest binary")
    chunks = docs.select("doc_id", "text").mapInArrow(_cut_texts, "digest binary, chunk string")
    encoded = chunks.dropDuplicates(["digest"]).mapInArrow(_encode_chunks(ranks), "digest binary, head string, core binary, tail string")
    parts = pieces.join(encoded, "digest")
    # a repeated row repeats its (seq, part) pairs: they are dropped by the set
    texts = parts.groupBy("doc_id", "whole").agg(F.array_sort(F.collect_set(F.struct("seq", "head", "core", "tail"))).alias("parts"))
    return texts.select("doc_id", "parts").mapInArrow(_assemble(ranks), f"doc_id {id_type}, ids array<int>")


def p7_ids(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return encode_corpus(docs, f"{tokenizers}/byte_bpe_50k.tiktoken")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
