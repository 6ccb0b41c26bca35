"""Records of evaluation splits that stand, exactly or almost, in the training split.

Normalised pages are cut where a rolling hash of their words says so. Chunk digests are
joined across splits and the lengths of shared chunks are summed into the share of each
page that the pair has in common. The join is on a prefix only: with chunks ordered from
rare to common, two pages that share at least ``least`` of either one's words must share a
chunk before the last ``least`` of both.

Chunks order the work but prove nothing about three-word sets, so a second join on the rarest
three-word hashes of each page adds every other pair that can reach the wanted share: with
the hashes of all pages in one order, rare before common, the first one that two pages share
leaves at least their common part behind it in both. An exact check on word sets follows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import source_key, strip, words
from sheafline.plans.storage import drop_stored, once, small_or_shuffled, stored
from sheafline.sources.tables import table

PAGE = ("stream_id", "original_position")
TRAIN, EVALUATION = "train", ("validation", "test")
#: A cut falls after one word in CUT_ONE_IN, not before MIN_WORDS of the chunk.
CUT_ONE_IN, MIN_WORDS = 5, 2
#: Share of either page's words that shared chunks must reach for a pair to be looked at by its chunks.
LEAST = 0.2
#: Chunks whose pages make more than so many pairs across splits are not joined. Pairs that this
#: or LEAST passes over are found by their three-word hashes, so both only order the work.
HOT = 2_500
#: Three-word hashes are ordered by counts in so many buckets; a bitmap of so many places for each
#: side tells those that the other side cannot have. Both are merged in slices of so many bytes and
#: are of one size whatever the input: full ones cost work, not pairs.
BUCKETS, PLACES, SLICE = 1 << 22, 1 << 26, 1 << 18
#: Bits of a three-word hash and of a page's sketch of them. Equal hashes of different words cost work, not pairs.
HASH_BITS, BITS = 48, 512
#: Pages of fewer words take no part.
LEAST_WORDS = 20

#: Texts are hashed in spans of about so many characters.
SPAN = 1 << 20
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def chunk_digests(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``digest, page`` of the chunks of a batch of pages given as word hashes."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    if not len(page):
        return np.zeros(0, np.int64), page
    at = np.arange(len(page)) - np.repeat(np.r_[0, np.cumsum(lengths)][:-1], lengths)
    wanted = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(CUT_ONE_IN) == 0
    # of two cuts in a row the second stands, so that chunks have MIN_WORDS words at least
    after = np.flatnonzero(wanted)
    keep = []
    previous_page, previous_cut = -1, -1
    for i, p, a in zip(after.tolist(), page[after].tolist(), at[after].tolist()):
        if p != previous_page:
            previous_page, previous_cut = p, i - a - 1
        if i - previous_cut >= MIN_WORDS:
            keep.append(i)
            previous_cut = i
    ends = np.zeros(len(page), bool)
    ends[keep] = True
    ends[np.cumsum(lengths)[lengths > 0] - 1] = True
    begins = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
    chunk = np.cumsum(np.r_[True, ends[:-1]]) - 1
    place = (np.arange(len(page)) - begins[chunk]).astype(np.uint64)
    mixed = (hashes ^ (place * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    digest = np.add.reduceat(mixed * np.uint64(0x9E3779B97F4A7C15), begins)
    count = np.diff(np.r_[begins, len(page)])
    # the last byte tells the words of the chunk, so that a shared digest tells the words shared
    return ((digest << np.uint64(8)) | np.minimum(count, 255).astype(np.uint64)).view(np.int64), page[begins]


_TALLY = "of boolean, slice int, packed binary"
_FIRST = "page long, words int, digests array<long>, of boolean, slice int, packed binary"


def _cut(keys: int):
    """``train, text`` and ``keys`` more columns to these, the hash of the words, and once for each
    text of a batch its chunks; at the end the counts and places of all three-word hashes, in packed slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, places = np.zeros((2, BUCKETS), np.uint32), np.zeros((2, PLACES // 8), np.uint8)
        kinds = None
        for batch in batches:
            kinds = kinds or [(f.name, f.type) for f in list(batch.schema)[2:]]
            of, side, ids, sizes, flat = _words(batch)
            digest, page = chunk_digests(flat, sizes)
            bounds = np.searchsorted(page, np.arange(len(ids) + 1))
            rows, first = np.unique(of, return_index=True)
            lengths = np.zeros(batch.num_rows, np.int64)
            at = np.where(of >= 0, of, 0)
            # the first row of a text takes its chunks, the others none
            own = np.zeros(batch.num_rows, bool)
            own[first[rows >= 0]] = True
            lengths[own] = np.diff(bounds)[at[own]]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(digest[_spans(bounds[at[own]], lengths[own])]))
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(ids[at] if len(ids) else at, pa.int64(), mask=of < 0), pa.array((sizes[at] if len(ids) else at).astype(np.int32), mask=~own), lists, empty.cast(pa.bool_()), empty.cast(pa.int32()), empty.cast(pa.binary())],
                names=["train", *[n for n, _ in kinds], *[c.split(" ")[0] for c in _FIRST.split(", ")]],
            )
            sizes, h = _triples(sizes, flat)
            for t in (0, 1):
                mine = h[np.repeat(side, sizes) == t]
                counts[t] += np.bincount(_bucket(mine), minlength=BUCKETS).astype(np.uint32)
                np.bitwise_or.at(places[t], _place(mine) >> 3, np.uint8(1) << (_place(mine) & 7).astype(np.uint8))
        if kinds is None:
            return
        # counts come first in the numbering of slices, then places
        whole = [np.concatenate([counts[t].view(np.uint8), places[t]]) for t in (0, 1)]
        rows = [(bool(t), i // SLICE, _pack(whole[t][i : i + SLICE], i // SLICE)) for t in (0, 1) for i in range(0, len(whole[t]), SLICE) if whole[t][i : i + SLICE].any()]
        n = len(rows)
        columns = [pa.nulls(n, pa.bool_()), *[pa.nulls(n, t) for _, t in kinds], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.bool_(), pa.int32(), pa.binary()))]]
        yield pa.RecordBatch.from_arrays(columns, names=["train", *[n for n, _ in kinds], *[c.split(" ")[0] for c in _FIRST.split(", ")]])

    return run


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of spans, one after the other."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``sizes, hashes``: the words of each text, one text after the other, as 64-bit hashes of their letters and digits.

    A word's hash is the sum of its bytes times the powers of an odd number, taken from running sums over all bytes.
    """
    sizes, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low = [t.lower() if t else "" for t in texts]
    ends = np.cumsum([len(t) for t in low])
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(SPAN, ends[-1] if len(ends) else 0, SPAN)) + 1, len(low)])
    for begin, end in zip(cuts[:-1], cuts[1:]):
        column = pa.array(low[begin:end], pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[: end - begin + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: at[-1]]
        inside = _IS_WORD[data]
        before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
        filled = np.diff(at) > 0
        before[at[:-1][filled]] = False
        after[at[1:][filled] - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = _powers(len(data))
        run = np.r_[np.uint64(0), np.cumsum(data * up)]
        h = (run[last] - run[first]) * down[first]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(h ^ (h >> np.uint64(29)))
        sizes.append(np.diff(np.searchsorted(first, at)))
    return np.concatenate(sizes), np.concatenate(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_held) == 0 or len(_held[0]) < n:
        base = 0x9E3779B97F4A7C15
        _held[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, SPAN) - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64))]
    return _held[0][:n], _held[1][:n]


_held: list[np.ndarray] = []


def _page_id(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes())


def _words(batch: pa.RecordBatch):
    """``of, side, pages, sizes, hashes``: the distinct texts of a batch of ``train, text``, the hashes of
    their words one text after the other, and the text of each row (-1 where it takes no part)."""
    seen: dict[tuple, int] = {}
    of, side, ids, rows = [], [], [], []
    lengths, flat = word_hashes(batch.column(1).to_pylist())
    begins = np.cumsum(lengths) - lengths
    for row, (train, begin, length) in enumerate(zip(batch.column(0).to_pylist(), begins.tolist(), lengths.tolist())):
        if length < LEAST_WORDS:
            of.append(-1)
            continue
        page = _page_id(flat[begin : begin + length])
        place = seen.setdefault((page, train), len(ids))
        of.append(place)
        if place == len(ids):
            side.append(train)
            ids.append(page)
            rows.append(row)
    rows = np.array(rows, np.int64)
    return np.array(of, np.int64), np.array(side, bool), np.array(ids, np.uint64).view(np.int64), lengths[rows], flat[_spans(begins[rows], lengths[rows])]


def with_split(pages: DataFrame, splits: DataFrame) -> DataFrame:
    """Pages of streams in the training or an evaluation split, as ``split`` and ``train``."""
    named = splits.select("stream_id", F.lower(strip("split_name")).alias("split")).where(F.col("split").isin(TRAIN, *EVALUATION)).distinct()
    return pages.join(small_or_shuffled(stored(named)), "stream_id").withColumn("train", F.col("split") == TRAIN)


_LENGTH = lambda c: c.bitwiseAND(F.lit(255)).cast("int")


def _chunk_prefixes(least: float):
    """``prefix, chunks`` of each page: its chunks, and those of them that a partner must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2).to_numpy()
            n = np.diff(batch.column(3).offsets.to_numpy())
            page = np.repeat(np.arange(len(n)), n)
            chunk = batch.column(3).flatten().to_numpy()
            chunk = chunk[np.lexsort((chunk, page))]
            hot = (chunk >> 56) & 1 == 1
            length = chunk & 255
            run_ = np.cumsum(length)
            whole = np.bincount(page, length, minlength=len(n))
            # words of this chunk and of all more common ones: where they fall under the least share, the prefix ends
            left = np.repeat(np.cumsum(whole), n) - run_ + length
            enough = whole >= least * words
            keep = (left >= least * words[page]) & ~hot & enough[page]
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k)].astype(np.int32)), pa.array(c)) for k, c in ((np.bincount(page[keep], minlength=len(n)), chunk[keep]), (n, chunk))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["page", "train", "words", "prefix", "chunks"]).filter(pa.array(enough))

    return run


def chunk_pairs(cut: DataFrame, least: float = LEAST) -> DataFrame:
    """``page_a, page_b, shared, share_a, share_b``: distinct texts of the training (a) and the
    evaluation splits (b), named by the 64-bit hash of their words, with the words in shared chunks.
    """
    length = _LENGTH
    # chunks that the evaluation pages cannot have are not sent
    asked = _asked(cut.where("not train").select(F.transform("digests", lambda c: F.shiftright(c, 8))))
    held = cut.sparkSession.sparkContext.broadcast(asked)
    rows = cut.select("page", "train", "words", "digests").mapInArrow(_shared(held), "page long, train boolean, words int, chunk long")
    side = F.when(F.col("train"), 1).otherwise(0)
    counts = rows.groupBy("chunk").agg(F.sum(side).alias("a"), F.sum(1 - side).alias("b")).where("a > 0 and b > 0")
    # in place of its first byte a chunk gets what orders it: quarters of a doubling of the pairs, and whether it is hot
    often = F.col("a").cast("double") * F.col("b")
    order = F.least(F.floor(4 * F.log2(often)), F.lit(63)).cast("long")
    counts = stored(counts.select("chunk", F.shiftleft(order * 2 + (often > HOT).cast("long"), 56).bitwiseOR(F.col("chunk").bitwiseAND(F.lit((1 << 56) - 1))).alias("code")))
    common = rows.join(small_or_shuffled(counts), "chunk")
    lists = common.groupBy("page", "train").agg(F.max("words").alias("words"), F.collect_set("code").alias("chunk"))
    packed = stored(lists.mapInArrow(_chunk_prefixes(least), "page long, train boolean, words int, prefix array<long>, chunks array<long>"))
    # pairs of pages first, their chunks after
    side = lambda x, cond, *c: packed.where(cond).select(F.col("page").alias(f"page_{x}"), *c)
    chunk = F.explode("prefix").alias("chunk")
    pairs = first = stored(side("a", "train", chunk).join(side("b", "not train", chunk), "chunk").select("page_a", "page_b").distinct())
    of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("words", "chunks")]
    pairs = pairs.join(side("a", "train", *of("a")), "page_a").join(side("b", "not train", *of("b")), "page_b")
    shared = F.aggregate(F.array_intersect("chunks_a", "chunks_b"), F.lit(0), lambda t, c: t + length(c))
    pairs = pairs.select("page_a", "page_b", "words_a", "words_b", shared.alias("shared"))
    pairs = pairs.where((F.col("shared") >= least * F.col("words_a")) & (F.col("shared") >= least * F.col("words_b")))
    found = stored(pairs.select("page_a", "page_b", "shared", (F.col("shared") / F.col("words_a")).alias("share_a"), (F.col("shared") / F.col("words_b")).alias("share_b")))
    drop_stored(counts, packed, first)
    return found


def _triples(sizes: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sizes, hashes``: the set of three-word hashes of each text, given as word hashes, one after the other."""
    if len(w) < 3:
        return np.zeros(len(sizes), np.int64), w[:0]
    h = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xD6E8FEB86659FD93) + w[2:] * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    page = np.repeat(np.arange(len(sizes)), sizes)
    whole = page[:-2] == page[2:]
    h, page = h[whole], page[:-2][whole]
    # page and hash in one number, so that a plain sort will do
    h >>= np.uint64(64 - HASH_BITS)
    parts = []
    for begin in range(0, len(sizes), 1 << 64 - HASH_BITS):
        own = slice(*np.searchsorted(page, (begin, begin + (1 << 64 - HASH_BITS))))
        key = np.sort(((page[own] - begin).astype(np.uint64) << np.uint64(HASH_BITS)) | h[own])
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        parts.append((begin + (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)))
    page, h = (np.concatenate(c) for c in zip(*parts))
    return np.bincount(page, minlength=len(sizes)), h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % BUCKETS


def _place(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(PLACES - 1)).astype(np.int64)


def _counted(at: int) -> bool:
    return at < 4 * BUCKETS // SLICE


def _pack(part: np.ndarray, at: int) -> bytes:
    """Bytes of slice ``at``: counts with their low bytes first, as most are small, places by frequency of their bytes alone."""
    if _counted(at):
        return zlib.compress(part.reshape(-1, 4).T.tobytes(), 1)
    packer = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, 9, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(part.tobytes()) + packer.flush()


def _unpack(packed: bytes, at: int) -> np.ndarray:
    part = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(part.reshape(4, -1).T).reshape(-1) if _counted(at) else part


def _merged(rows: pa.Table) -> pa.Table:
    at = rows.column("slice")[0].as_py()
    parts = [_unpack(x, at) for x in rows.column("packed").to_pylist()]
    whole = np.add.reduce([p.view(np.uint32) for p in parts], dtype=np.uint32).view(np.uint8) if _counted(at) else np.bitwise_or.reduce(parts)
    return pa.table({"of": rows.column("of")[:1], "slice": rows.column("slice")[:1], "packed": pa.array([_pack(whole, at)], pa.binary())})


def _sketch(page: np.ndarray, h: np.ndarray, pages: int) -> np.ndarray:
    """BITS parities of the hashes of each page, as longs: two sets differ in as many elements at least as in bits."""
    bits = np.bincount(page * BITS + (h >> np.uint64(37)).astype(np.int64) % BITS, minlength=pages * BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(pages, BITS), axis=1).view(np.int64)


_PACKED = ["page", "train", "size", "begin", "hashes", *[f"bits_{k}" for k in range(BITS // 64)]]


def _prefixes(held, least_jaccard: float):
    """``page, train, size, begin, hashes, bits``: the hashes of a page that can be the first one it shares with a partner,
    the first of them at place ``begin``, and the sketch of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, places = held.value
        for batch in batches:
            _, side, ids, sizes, flat = _words(batch)
            sizes, h = _triples(sizes, flat)
            page = np.repeat(np.arange(len(sizes)), sizes)
            bits = _sketch(page, h, len(sizes))
            # hashes that stand on one side only come first: no partner has them
            at = _place(h)
            n = np.where((places[at >> 3] >> (at & 7).astype(np.uint8)) & 1, often[_bucket(h)], 0)
            # h is in order within each page
            order = np.argsort(page * 256 + n, kind="stable")
            h, n = h[order], n[order]
            at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # a partner is not smaller than the wanted share, so this many hashes must be left from the first common one on
            keep = (n > 0) & (np.repeat(sizes, sizes) - at >= least_jaccard * np.repeat(sizes, sizes) - 1e-9)
            held_by = np.bincount(page[keep], minlength=len(sizes))
            begin = np.bincount(page[n == 0], minlength=len(sizes))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held_by)].astype(np.int32)), pa.array(h[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(side), pa.array(sizes.astype(np.int32)), pa.array(begin.astype(np.int32)), lists, *[pa.array(np.ascontiguousarray(b)) for b in bits.T]], names=_PACKED)

    return run


def triple_pairs(texts: DataFrame, tally: DataFrame, least_jaccard: float, near: DataFrame) -> DataFrame:
    """``page_a, page_b``: all distinct texts of the training (a) and the evaluation splits (b) of
    ``texts(train, text)`` whose three-word sets can have ``least_jaccard`` of their union in
    common; no such pair is left out, and of the pairs in ``near`` those that cannot are. ``tally``
    has the packed counts and places of their hashes, a row a slice.
    """
    whole = np.zeros((2, 4 * BUCKETS + PLACES // 8), np.uint8)
    for side, at, packed in tally.collect():
        whole[int(side), at * SLICE : (at + 1) * SLICE] = _unpack(packed, at)
    counts = whole[:, : 4 * BUCKETS].copy().view(np.uint32).astype(np.float32)
    # quarters of a doubling are fine enough for an order
    often = np.minimum(1 + 4 * np.log2(1 + counts[0] * counts[1]), 255).astype(np.uint8)
    held = texts.sparkSession.sparkContext.broadcast((often, whole[0, 4 * BUCKETS :] & whole[1, 4 * BUCKETS :]))
    packed = texts.mapInArrow(_prefixes(held, least_jaccard), "page long, train boolean, size int, begin int, hashes array<long>, " + ", ".join(f"{c} long" for c in _PACKED[5:])).where(F.size("hashes") > 0)
    packed = once(packed, "page", "train")
    # a train page sends only what the evaluation pages send too
    held = texts.sparkSession.sparkContext.broadcast(_asked(packed.where("not train").select("hashes")))
    # pages go by their row numbers, which take less room than hashes
    rows = packed.select("row", *_PACKED[1:5]).mapInArrow(_exploded(held), "row long, train boolean, sizes long, hash long")
    side = lambda x, cond: rows.where(cond).select("hash", F.col("row").alias(f"row_{x}"), F.col("sizes").alias(f"sizes_{x}"))
    size, left = (lambda x: F.shiftright(f"sizes_{x}", 32)), (lambda x: F.col(f"sizes_{x}").bitwiseAND(F.lit(0xFFFFFFFF)))
    # the first hash that a pair has in common leaves all its common ones behind it in both: other meetings are not sent on
    wanted = lambda a, b: (a + b) * (least_jaccard / (1 + least_jaccard)) - 1e-6
    met = side("a", "train").join(side("b", "not train"), "hash").where(F.least(left("a"), left("b")) >= wanted(size("a"), size("b")))
    number = lambda x: packed.where(F.col("train") == F.lit(x == "a")).select(F.col("page").alias(f"page_{x}"), F.col("row").alias(f"row_{x}"))
    near = near.select("page_a", "page_b").join(number("a"), "page_a").join(number("b"), "page_b")
    met = stored(met.select("row_a", "row_b").unionByName(near.select("row_a", "row_b")).distinct())
    bits = lambda x: packed.where(F.col("train") == F.lit(x == "a")).select(*[F.col(c).alias(f"{c}_{x}") for c in ("row", "page", "size", *_PACKED[5:])])
    # first by the parities of half as many bits, which are less to send, then by all
    half = lambda x: bits(x).select(f"row_{x}", f"size_{x}", *[F.col(f"{c}_{x}").bitwiseXOR(F.col(f"{d}_{x}")).alias(f"{c}_{x}") for c, d in zip(_PACKED[5::2], _PACKED[6::2])])
    apart = lambda names: sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names), F.lit(0))
    possible = lambda names: F.col("size_a") + F.col("size_b") - apart(names) >= 2 * wanted(F.col("size_a"), F.col("size_b"))
    some = stored(met.join(half("a"), "row_a").join(half("b"), "row_b").where(possible(_PACKED[5::2])).select("row_a", "row_b"))
    pairs = stored(some.join(bits("a"), "row_a").join(bits("b"), "row_b").where(possible(_PACKED[5:])).select("page_a", "page_b"))
    drop_stored(packed, met, some)
    return pairs


def _asked(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the places of all hashes of a column of lists."""
    asked = np.zeros(PLACES // 8, np.uint8)
    for _, at, packed in hashes.mapInArrow(_marks, _TALLY).groupBy("of", "slice").applyInArrow(_merged, _TALLY).collect():
        part, at = _unpack(packed, at), at - 4 * BUCKETS // SLICE
        asked[at * SLICE : (at + 1) * SLICE] = part
    return asked


def _shared(held):
    """A row for each chunk of a page; those of train pages that no evaluation page has are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for batch in batches:
            of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
            chunk = batch.column(3).flatten().to_numpy()
            place = _place((chunk >> 8).view(np.uint64))
            keep = ~batch.column(1).to_numpy(zero_copy_only=False)[of].astype(bool) | ((asked[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
            of = pa.array(of[keep])
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in range(3)], pa.array(chunk[keep])], names=["page", "train", "words", "chunk"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of all hashes, in packed slices."""
    places = np.zeros(PLACES // 8, np.uint8)
    for batch in batches:
        at = _place(batch.column(0).flatten().to_numpy().view(np.uint64))
        np.bitwise_or.at(places, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    rows = [(False, (4 * BUCKETS + i) // SLICE, _pack(places[i : i + SLICE], (4 * BUCKETS + i) // SLICE)) for i in range(0, len(places), SLICE) if places[i : i + SLICE].any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.bool_(), pa.int32(), pa.binary()))], names=["of", "slice", "packed"])


def _exploded(held):
    """A row for each hash of a page, with the size of its set and the hashes left from it on in one number; those of train pages that no evaluation page sends are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for batch in batches:
            row, train, size, begin = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            number = np.diff(batch.column(4).offsets.to_numpy())
            of = np.repeat(np.arange(len(row)), number)
            h = batch.column(4).flatten().to_numpy()
            at = begin[of] + np.arange(len(h)) - np.repeat(np.cumsum(number) - number, number)
            place = _place(h.view(np.uint64))
            keep = ~train[of].astype(bool) | ((asked[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
            of, at, h = of[keep], at[keep], h[keep]
            yield pa.RecordBatch.from_arrays([pa.array(row[of]), pa.array(train[of].astype(bool)), pa.array((size[of].astype(np.int64) << 32) | (size[of] - at)), pa.array(h)], names=["row", "train", "sizes", "hash"])

    return run


def _hashed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, flat = word_hashes(batch.column(0).to_pylist())
        ends = np.cumsum(lengths)
        out = [np.uint64(_page_id(flat[e - n : e])).astype(np.int64).item() if n >= LEAST_WORDS else None for n, e in zip(lengths.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["text", "page"])


def overlaps(pages: DataFrame, splits: DataFrame, least_jaccard: float = 0.5, least: float = LEAST) -> DataFrame:
    """Pairs of a training page (a) and an evaluation page (b) whose sets of three consecutive
    words have at least ``least_jaccard`` of their union in common, with the chunk shares.

    Nulls: pages without text or stream, and streams without a split, take no part; a null
    source is kept. Repeated pages and split rows count once. Copies are compared once and
    joined back as members of their text. Texts of any length are cut whole. Empty tables give
    an empty result. Only the named columns are read.
    """
    pages = pages.select(*PAGE, "source", F.col("text").cast("string").alias("text"))
    placed = with_split(pages, splits).where("text is not null")
    keys = placed.select("train", "text", *PAGE, "split", source_key("source").alias("source"))
    schema = "train boolean, " + ", ".join(f"{n} {t}" for n, t in keys.dtypes[2:]) + ", " + _FIRST
    whole = stored(keys.mapInArrow(_cut(len(keys.columns) - 2), schema))
    # the counts of all tasks are merged and let go at once
    first = stored(whole.where("page is not null").drop("of", "slice", "packed"))
    tally = stored(whole.where("slice is not null").select("of", "slice", "packed").groupBy("of", "slice").applyInArrow(_merged, _TALLY))
    drop_stored(whole)
    cut = first.where("words is not null").select("page", "train", F.array_distinct("digests").alias("digests"))
    # digests count once in a page
    cut = once(cut.select("page", "train", F.aggregate("digests", F.lit(0), lambda t, c: t + _LENGTH(c)).alias("words"), "digests"), "page", "train")
    pairs = triple_pairs(placed.select("train", "text"), tally, least_jaccard, chunk_pairs(cut, least))
    n = pairs.count()
    wanted = pairs.select(F.explode(F.array("page_a", "page_b")).alias("page")).distinct()
    members = stored(first.select("page", *PAGE, "split", "source").distinct().join(small_or_shuffled(stored(wanted)), "page", "left_semi"))
    # one place of each text, read again
    places = stored(members.groupBy("page").agg(F.min(F.struct(*PAGE)).alias("at")).select(*[F.col(f"at.{c}").alias(f"at_{c}") for c in PAGE]))
    same = [pages[c].eqNullSafe(places[f"at_{c}"]) for c in PAGE]
    texts = pages.join(small_or_shuffled(places), same, "left_semi").where("text is not null").select("text").mapInArrow(_hashed_pages, "text string, page long").where("page is not null")
    w = words("text")
    triples = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.slice("w", i, F.lit(3)))))
    sets = stored(texts.groupBy("page").agg(F.min("text").alias("text")).withColumn("w", w).select("page", triples.alias("s")))
    checked = pairs.join(sets.select(F.col("page").alias("page_a"), F.col("s").alias("s_a")), "page_a").join(sets.select(F.col("page").alias("page_b"), F.col("s").alias("s_b")), "page_b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    jaccard = both / (F.size("s_a") + F.size("s_b") - both)
    checked = stored(checked.select("page_a", "page_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least_jaccard))
    n = checked.count()
    own = small_or_shuffled(stored(checked.select(F.explode(F.array("page_a", "page_b")).alias("page")).distinct()), 2 * n)
    chunks = stored(cut.join(own, "page", "left_semi").select("page", "words", "digests").dropDuplicates(["page"]))
    for x in ("a", "b"):
        checked = checked.join(chunks.select(*[F.col(c).alias(f"{c}_{x}") for c in chunks.columns]), f"page_{x}")
    shared = F.aggregate(F.array_intersect("digests_a", "digests_b"), F.lit(0), lambda t, c: t + _LENGTH(c))
    checked = checked.withColumn("shared", shared).select("page_a", "page_b", "shared", (F.col("shared") / F.col("words_a")).alias("share_a"), (F.col("shared") / F.col("words_b")).alias("share_b"), "jaccard")
    checked = stored(checked)
    of = members
    side = lambda x, cond: of.where(cond).select(*[F.col(c).alias(f"{c}_{x}") for c in of.columns])
    return small_or_shuffled(checked, n).join(side("a", f"split = '{TRAIN}'"), "page_a").join(side("b", f"split <> '{TRAIN}'"), "page_b")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = overlaps(table(spark, folder, "stream_pages", *PAGE, "source", "text"), table(spark, folder, "stream_splits", "stream_id", "split_name"))
    a, b = [F.col(f"{c}_a") for c in PAGE], [F.col(f"{c}_b") for c in PAGE]
    turned = F.struct(*a) > F.struct(*b)
    return found.select(*[F.when(turned, y).otherwise(x).alias(f"{c}_a") for c, x, y in zip(PAGE, a, b)], *[F.when(turned, x).otherwise(y).alias(f"{c}_b") for c, x, y in zip(PAGE, a, b)]).distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation pages found in the training split, by split and source."""
    found = overlaps(table(spark, folder, "stream_pages", *PAGE, "source", "text"), table(spark, folder, "stream_splits", "stream_id", "split_name"))
    pages = found.groupBy("split_b", "source_b", *[f"{c}_b" for c in PAGE]).agg(F.max("share_b").alias("share"), F.count("*").alias("partners"))
    return pages.groupBy(F.col("split_b").alias("split_name"), F.col("source_b").alias("source")).agg(F.count("*").alias("pages"), F.sum("partners").alias("pairs"), F.max("share").alias("largest_share"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
_PAIRS = r"""
with s as (select distinct stream_id, trim(lower(split_name)) split_name from stream_splits),
     p as (select distinct stream_id, original_position, regexp_extract_all(lower(text), '[a-z0-9]+') w, split_name from stream_pages join s using (stream_id)
           where text is not null and len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 20 and split_name in ('train', 'validation', 'test')),
     g as (select distinct stream_id, original_position, split_name, array_to_string(w[k:k + 2], ' ') g from (select *, unnest(range(1, len(w) - 1)) k from p)),
     n as (select stream_id, original_position, count(*) n from g group by all),
     c as (select a.stream_id sa, a.original_position pa, b.stream_id sb, b.original_position pb, count(*) c from g a join g b using (g) where a.split_name = 'train' and b.split_name <> 'train' group by all),
     f as (select c.* from c join n x on sa = x.stream_id and pa = x.original_position join n y on sb = y.stream_id and pb = y.original_position where 2 * c >= x.n + y.n - c)
"""
SQL = {
    "p5_found": _PAIRS
    + """select case when sa < sb then sa else sb end stream_id_a, case when sa < sb then pa else pb end original_position_a,
                case when sa < sb then sb else sa end stream_id_b, case when sa < sb then pb else pa end original_position_b from f"""
}
