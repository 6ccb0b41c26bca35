import re
import zlib

import numpy as np
import pyarrow as pa

from sheafline.llm import split_overlap as O


def test_word_hashes_follow_the_words():
    texts = ["Ab1 c-d  \u00c9", None, "", "ab1", "c d", "\u0130x \u212a", "xxx end", "end x", " \u6f22\u5b57 ab1-", "-", "a" * 3_000 + " b"]
    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    sizes, hashes = O.word_hashes(texts)
    assert sizes.tolist() == [len(w) for w in words]
    known = {}
    for word, h in zip((w for ws in words for w in ws), hashes.tolist()):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert [len(x) for x in O.word_hashes([])] == [0, 0]


def test_word_hashes_do_not_depend_on_spans(monkeypatch):
    texts = [f"Page {i} of the {i * 7} lines" for i in range(200)]
    whole = O.word_hashes(texts)
    monkeypatch.setattr(O, "SPAN", 50)
    O._held.clear()
    parts = O.word_hashes(texts)
    assert all(np.array_equal(x, y) for x, y in zip(whole, parts))


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 48, 120, dtype=np.uint64)
    b = np.r_[a[:80], rng.integers(0, 1 << 48, 30, dtype=np.uint64)]
    bits = O._sketch(np.repeat([0, 1], [120, 110]), np.r_[a, b], 2)
    apart = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
    assert 0 < apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_packed_slices_are_read_back_and_merged():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(0, O.SLICE // 4, 20_000), minlength=O.SLICE // 4).astype(np.uint32)
    places = rng.integers(0, 256, O.SLICE).astype(np.uint8) & (rng.random(O.SLICE) < 0.1).astype(np.uint8) * 255
    first = 4 * O.BUCKETS // O.SLICE
    for part, at, twice in ((counts.view(np.uint8), 0, (2 * counts).view(np.uint8)), (places, first, places)):
        packed = O._pack(part, at)
        assert np.array_equal(O._unpack(packed, at), part) and len(packed) < len(zlib.compress(part.tobytes(), 1))
        rows = pa.table({"of": [True] * 2, "slice": [at] * 2, "packed": [packed] * 2})
        assert np.array_equal(O._unpack(O._merged(rows).column("packed")[0].as_py(), at), twice)
