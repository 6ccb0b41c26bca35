"""Words and broken words of a page's lines, without Spark."""

import time

import pyarrow as pa

from sheafline.llm import scan_repair as S


def test_long_lines_are_split_in_proportion_to_their_length():
    began = time.process_time()
    assert [len(tokens) for _, _, tokens, _, _, _ in S._parts("x" * 40_000 + "\n" + "ab " * 20_000)] == [1, 20_000]
    assert time.process_time() - began < 1


def test_broken_words_end_with_any_hyphen_before_any_space():
    tails = [tail for _, _, _, _, tail, _ in S._parts("har-\nhar¬  \nhar‐\t\nhar­\n-\n\nhar- x\nbour")]
    assert tails == ["har", "har", "har", "har", None, None, None, None]


def test_words_are_counted_over_the_pages_of_a_batch():
    text = pa.array(["old harbour well-known\nhar-\nbour", None, "Old  harbour", ""])
    counted = list(S._count(iter([pa.RecordBatch.from_arrays([text], names=["text"])])))
    assert dict(zip(*[c.to_pylist() for c in counted[0].columns])) == {"old": 2, "harbour": 2, "well": 1, "known": 1, "well-known": 1}
