"""Encoding, leakage, repeated lines, overlap, truncation and scan repair on small cases and dirt."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheafline.llm import corpus_encoding as E
from sheafline.llm import eval_leakage as V
from sheafline.llm import repeated_lines as R
from sheafline.llm import scan_repair as S
from sheafline.llm import split_overlap as O
from sheafline.llm import truncated_texts as T

VOCABULARY = f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken"
WORDS = "the of harbour invoice rented copper must be within days unless signed 2024 kettle".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def clash(df):
    """Other columns whose names the operators use inside."""
    return df.withColumns({c: F.lit(i) for i, c in enumerate(("digest", "page", "line", "key", "n", "words", "seq", "word")) if c not in df.columns})


# encoding


def test_ids_equal_those_of_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    texts = ["", " ", "a", "\r\n\n x  y", "don't  we'll", "<|endoftext|> x", "日本語" * 900, "é́ ñ 𐍈𝄞", "a" * 9000, "  lead", prose(1, 3000), prose(1, 3000)[700:], "x " * 4000, "  y " * 300, "1 2  3   4" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, ""), (50, None), (None, "null id")], "doc_id long, text string")
    rows = E.encode_corpus(clash(df), VOCABULARY).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r.ids for r in rows}
    assert got[50] == [] and got[0] == [] and got[None] == tokenizer.encode("null id", add_special_tokens=False).ids
    for i, t in enumerate(texts):
        assert got[i] == tokenizer.encode(t, add_special_tokens=False).ids, i


def test_equal_passages_are_cut_alike(spark):
    passage = prose(3, 800)
    df = spark.createDataFrame([(1, prose(4, 100) + passage), (2, prose(5, 130) + passage)], "doc_id long, text string")
    chunks = [set(r.c) for r in df.mapInArrow(E._cut_digests, "doc_id long, whole long, seq int, digest binary").groupBy("doc_id").agg(F.collect_set(F.hex("digest")).alias("c")).collect()]
    assert len(chunks[0] & chunks[1]) > 0.6 * min(map(len, chunks))


def test_no_documents_to_encode(spark):
    assert E.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


# leakage


def leaked(docs, items, run=10):
    out = set()
    for d, t in docs:
        text = V.words(t)
        have = {tuple(text[i : i + run]) for i in range(len(text) - run + 1)}
        for k, x in items:
            w = V.words(x)
            if any(tuple(w[i : i + run]) in have for i in range(len(w) - run + 1)):
                out.add((d, k))
    return out


def test_leaks_equal_a_search_of_all_windows(spark):
    items = [(i, prose(100 + i, 30)) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = [(i, prose(i, 200)) for i in range(40)]
    docs += [(100 + i, prose(i, 50) + " " + " ".join(items[i % 12][1].split()[5 : 5 + 8 + i % 5]).upper() + ". " + prose(900 + i, 20)) for i in range(24)]
    docs += [(200, None), (201, ""), (202, items[3][1]), (203, prose(7, 60_000) + " " + items[2][1])]
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in V.leaks(clash(d), clash(i)).collect()}
    assert got == leaked(docs, items) and len(got) > 10


def test_no_documents_or_items_to_leak(spark):
    d, i = spark.createDataFrame([(1, prose(1, 50))], "doc_id long, text string"), spark.createDataFrame([(1, prose(1, 50))], "item_id long, text string")
    assert V.leaks(d.limit(0), i).count() == 0 and V.leaks(d, i.limit(0)).count() == 0 and V.leaks(d, i).count() == 1


# repeated lines


def pages(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, original_position int, source string, text string")


def test_lines_on_enough_pages_of_a_source(spark):
    rows = [(f"s{i}", 0, " Web " if i % 2 else "web", f"Page  {i} of 99\nown {chr(97 + i) * 4}\n\nLegal Notice\nShare THIS") for i in range(10)]
    rows += rows[:4]  # delivered twice: counts once
    rows += [(f"t{i}", 0, "other", "Legal notice\nx") for i in range(9)] + [(f"n{i}", 0, None, "free line") for i in range(12)]
    rows += [("e", 0, "web", None), ("e", 1, "web", ""), (None, None, "web", "Legal notice"), ("z", 0, "  ", "Legal notice")]
    df = clash(pages(spark, rows))
    got = {(r.stream_id, r.original_position, r.line_no) for r in R.repeated_lines(df).collect()}
    assert got == {(f"s{i}", 0, k) for i in range(10) for k in (0, 3, 4)} | {(None, None, 0)}
    clean = {(r.stream_id, r.original_position): r.text for r in R.without_repeated_lines(df).collect()}
    assert clean["s3", 0] == "own dddd\n" and clean["e", 0] is None and clean["t1", 0] == "Legal notice\nx" and clean[None, None] == ""
    levels = {(r.length, r.pages) for r in R.frequent_sequences(df).collect()}
    assert levels == {(1, 10), (1, 11), (2, 10), (3, 10)}


def test_sequences_of_any_length_and_with_gaps(spark):
    lines = list("abcdef")
    notice = [("s", i, "web", "\n".join(x for line in lines for x in (line, f"only {'x' * (i + 1)} {line}"))) for i in range(12)]
    # c and e in the order e, c; a twice; d left out: with gaps a, b, c stand on these pages too
    other = [("t", i, "web", "a\nb\ne\na\nc") for i in range(3)]
    got = {r.length: (r.n, r.most) for r in R.frequent_sequences(pages(spark, notice + other)).groupBy("length").agg(F.count("*").alias("n"), F.max("pages").alias("most")).collect()}
    assert got == {k: (math.comb(6, k), 15 if k <= 3 else 12) for k in range(1, 7)}


def test_one_source_holding_most_rows_and_no_rows(spark):
    rows = [(f"s{i}", 0, "hot", f"same line\nline {'x' * (i % 7)}\n" + "y" * 20_000) for i in range(300)]
    assert R.repeated_lines(pages(spark, rows)).count() == 900
    assert R.repeated_lines(pages(spark, [])).count() == 0 and R.frequent_sequences(pages(spark, [])).count() == 0


# overlap across splits


def near(a, b):
    s = [set(zip(w, w[1:], w[2:])) for w in (V.words(a), V.words(b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_pairs_across_splits(spark):
    words = [f"w{i}" for i in range(3000)]
    text = lambda seed, n=100: " ".join(random.Random(seed).choices(words, k=n))
    edited = lambda t, every: " ".join("edit" + str(i) if i % every == 5 else w for i, w in enumerate(t.split()))
    train = [("a", i, text(i)) for i in range(30)]
    test = [("b", i, edited(text(i), 9 + i)) for i in range(20)] + [("b", 50, text(0).upper() + " tail"), ("b", 51, "short text"), ("b", 52, None), ("c", 0, text(3)), ("d", 0, text(3))]
    rows = [(s, p, "src", t) for s, p, t in train + test] * 2
    splits = spark.createDataFrame([("a", " Train"), ("b", "TEST"), ("b", "test"), ("c", "validation"), ("d", None)], "stream_id string, split_name string")
    got = {(r.stream_id_a, r.original_position_a, r.stream_id_b, r.original_position_b) for r in O.overlaps(clash(pages(spark, rows)), clash(splits)).collect()}
    want = {("a", i, s, p) for _, i, t in train for s, p, x in test if s != "d" and x and len(x.split()) >= 20 and near(t, x) >= 0.5}
    # nothing wrong is found; a copy edited every few words may keep too few whole chunks
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 15


@pytest.mark.parametrize("hot", [2, float("inf")])
def test_no_pair_is_lost_whatever_counts_as_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(O, "HOT", hot)
    words = [f"w{i}" for i in range(3000)]
    form = [random.Random(f"form{i}").choices(words, k=60) for i in range(3)]
    # forms take 45 to 49 % of a page; the rest is edited often enough to leave few whole chunks
    page = lambda i: form[i % 3] + random.Random(i).choices(words, k=64 + i % 9)
    edited = lambda t, every: " ".join(f"x{k}{every}" if k >= 60 and k % every == 0 else w for k, w in enumerate(t))
    train = [("a", i, " ".join(page(i))) for i in range(40)]
    test = [("b", 10 * i + every, edited(page(i), every)) for i in range(40) for every in (4, 5, 6, 7)]
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "stream_id string, split_name string")
    found = O.overlaps(pages(spark, [(s, p, "src", t) for s, p, t in train + test]), splits).collect()
    want = {(i, p) for _, i, t in train for _, p, x in test if near(t, x) >= 0.5}
    assert {(r.original_position_a, r.original_position_b) for r in found} == want and len(want) > 80
    assert all(0 <= r.share_a <= 1 and 0 <= r.share_b <= 1 for r in found)


def test_pairs_of_common_chunks_that_miss_the_share_are_not_compared(spark):
    words = [f"w{i}" for i in range(3000)]
    form = random.Random("form").choices(words, k=60)
    page = lambda i: " ".join(form + random.Random(i).choices(words, k=100))
    rows = [(True, page(i)) for i in range(4)] + [(False, page(i)) for i in (0, 7, 8)]
    df = spark.createDataFrame(rows, "train boolean, text string")
    whole = df.mapInArrow(O._cut(0), "train boolean, " + O._FIRST).cache()
    cut = whole.where("words is not null").select("page", "train", "words", "digests")
    tally = whole.where("slice is not null").select("of", "slice", "packed").groupBy("of", "slice").applyInArrow(O._merged, O._TALLY)
    near = O.chunk_pairs(cut)
    assert near.count() > 1
    found = O.triple_pairs(df, tally, 0.5, near).collect()
    assert len(found) == 1 and found[0].page_a == found[0].page_b


def test_many_copies_of_one_page(spark):
    t = prose(1, 60)
    rows = [("a", i, "s", t) for i in range(80)] + [("b", i, None, t.title()) for i in range(5)]
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "stream_id string, split_name string")
    assert O.overlaps(pages(spark, rows), splits).count() == 400
    assert O.overlaps(pages(spark, []), splits).count() == 0 and O.overlaps(pages(spark, rows), splits.limit(0)).count() == 0


# truncation


def test_cut_texts_are_told_from_whole_ones(spark):
    r = random.Random(5)
    sentence = lambda: " ".join(r.choice(WORDS) for _ in range(12)).capitalize() + "."
    whole = [" ".join(sentence() for _ in range(r.randint(3, 9))) + r.choice(["", "", "\nRef: ABC-123/XYZ", "\n- one item (1990 to 2001)"]) for _ in range(900)]
    cut = [t[: r.randint(100, 200)] + r.choice(["", "...", "…"]) for t in whole[:150]]
    cut = [t for t in cut if not t.rstrip().endswith((".", ")")) or t.endswith("...")]
    rows = [(i, t, f"s{i % 3}", False) for i, t in enumerate(whole)] + [(5000 + i, t, "s1", True) for i, t in enumerate(cut)]
    df = spark.createDataFrame([x[:3] for x in rows] + [(9000, None, None), (9001, "", "s1"), (9002, "   ", "s1"), (9003, "ok", None)], "doc_id long, text string, source string")
    got = {x.doc_id: x.truncated for x in T.truncated(clash(df.union(df.limit(20)))).collect()}
    truth = {i: c for i, _, _, c in rows}
    assert not any(got[i] for i in (9000, 9001, 9002))
    hits = sum(got[i] for i in truth if truth[i])
    assert hits >= 0.9 * sum(truth.values()) and sum(got[i] for i in truth if not truth[i]) <= 0.02 * len(whole)


def test_nothing_to_score(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert T.truncated(empty).count() == 0
    assert [x.truncated for x in T.truncated(spark.createDataFrame([(1, None, None)], empty.schema)).collect()] == [False]


# scans


def test_reading_confusions():
    assert S.reads_as("iinder", "under", [("ii", "u")]) and S.reads_as("rcfur6ished", "refurbished", [("c", "e"), ("6", "b")])
    assert not S.reads_as("under", "under", [("ii", "u")]) and not S.reads_as("cat", "eat", [("b", "h")])


@pytest.fixture(scope="module")
def scans(spark):
    text = "the harbour must be rented under copper rules within twelve days unless the up-to-date kettle is signed today"
    clean = [(f"n{i}", "clean", i, text, "native") for i in range(30)]
    head = "Vinpitik cable record"
    pages = [(f"o{i}", "k", i, f"{head}\n- {120 + i} -\nThe har-\nbour must be rented iinder copper ru1es within an up-\nto-date kettle\nplain line {i}\n7777\nend of {chr(97 + i) * 4}", " OCR ") for i in range(4)]
    pages += [("o9", "k", 9, None, "ocr"), ("o8", "k", 8, "", "Ocr"), ("x", None, None, "har-", "ocr"), (None, "k", 1, "iinder", "ocr")]
    rows = clean + pages + pages[:1]
    stream = [("s", 0, "Bef0re the har¬\nbour signed\n- 3 -"), ("s", 1, None), (None, 0, "iinder"), ("t", None, "iinder"), ("s", 2, "before " * 20 + "x" * 30_000)]
    schema = "page_id string, packet_id string, page_number int, text string, extraction_method string"
    return clash(spark.createDataFrame(rows, schema)), clash(spark.createDataFrame(stream, "stream_id string, original_position int, text string"))


def test_noise_of_scans(scans):
    got = {(r.page_key, r.line_no, r.noise) for r in S.scan_noise(*scans).collect()}
    want = {(f"o{i}", *x) for i in range(4) for x in ((0, "header"), (1, "page_number"), (2, "hyphen"), (3, "chars"))}
    assert got - {("x", 0, "hyphen")} == want | {("s_page_0001", 0, "hyphen"), ("s_page_0001", 0, "chars")}


def test_repaired_scans(scans):
    got = {r.page_key: r.text for r in S.repaired_text(*scans).collect()}
    assert "The harbour must be rented under copper rules within an up- to-date" in got["o2"].replace("\n", " ") and "Vinpitik" not in got["o2"] and "122" not in got["o2"]
    assert got["s_page_0001"].startswith("Before the harbour\nsigned") and got["o9"] == "" and got["s_page_0002"] == ""


def test_unmarked_scans_become_paragraphs(spark, scans, monkeypatch):
    extractions, stream = scans
    lines = "Vinpitik cable record\n- {} -\nThe har-\nbour must be rented under {}\nrules within twelve {}"
    rows = [("u", i, lines.format(i + 1, chr(97 + i) * 4, chr(97 + i) * 4)) for i in range(4)] + [("u", 4, "Vinpitik cable record\nthe harbour\nmust be rented")]
    tables = {"page_extractions": extractions, "stream_pages": stream.select("stream_id", "original_position", "text").unionByName(spark.createDataFrame(rows, "stream_id string, original_position int, text string"))}
    monkeypatch.setattr(S, "table", lambda spark, folder, name, *columns: tables[name].select(*columns))
    got = {r.page_key: r.text for r in S.p6_text(spark, "").collect()}
    assert all(got[f"u_page_000{i}"] == f"The harbour must be rented under {chr(96 + i) * 4} rules within twelve {chr(96 + i) * 4}" for i in range(1, 5))
    # a page without findings is not scanned and stays as it is
    assert got["u_page_0005"] == rows[4][2]


def test_no_scans(scans):
    assert S.scan_noise(scans[0].limit(0), scans[1].limit(0)).count() == 0


def test_inserted_swapped_and_changed_words_are_passed_over(spark):
    words = [f"w{i}" for i in range(400)]
    item = random.Random(1).sample(words, 20)
    inserted = [x for i, w in enumerate(item) for x in ([w, "new"] if i == 9 else [w])]
    swapped = [*item[:4], item[5], item[4], *item[6:14], item[15], item[14], *item[16:]]
    changed = ["other" if i % 6 == 2 else w for i, w in enumerate(item)]
    noise = lambda seed: random.Random(seed).sample(words, 60)
    docs = [(i, " ".join(noise(i) + x + noise(50 + i))) for i, x in enumerate((item, inserted, swapped, changed, ["other" if i % 2 else w for i, w in enumerate(item)], item[:9]))] + [(9, None)]
    d, i = spark.createDataFrame(docs + docs[:2], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, "short"), (3, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.share, 2) for r in V.near_leaks(clash(d), clash(i)).collect()}
    assert set(got) >= {(k, 1) for k in range(4)} and not set(got) & {(4, 1), (9, 1)} and {k for _, k in got} == {1}
    assert got[0, 1] == got[1, 1] == got[2, 1] == 1.0 and got[3, 1] >= 0.7
    assert {(r.doc_id, r.item_id) for r in V.leaks(d, i).collect()} == {(0, 1), (1, 1)}


def test_words_of_any_script_and_length_have_an_anagram_hash(spark):
    counts = [("漢字", 5), ("日本語", 9), ("한국어", 12), ("𐍈𝄞x", 10), ("under", 40), ("iinder", 1), ("a" * 50 + "rn", 1), ("a" * 50 + "m", 40)]
    fixed = {r.word: r.correct for r in S.corrections(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert fixed == {"iinder": "under", "a" * 50 + "rn": "a" * 50 + "m"}
    rows = spark.createDataFrame(counts, "word string, n long").select("word", S.anagram_hash(F.col("word")).alias("h")).collect()
    assert all(r.h == S._fifth(r.word) for r in rows)


def test_short_texts_can_be_cut(spark):
    r = random.Random(8)
    sentence = lambda n=9: " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."
    whole = [" ".join(sentence() for _ in range(r.randint(1, 6))) for _ in range(800)] + [sentence(r.randint(3, 5)) for _ in range(200)]
    cut = ["The committee decided that the", "The harbour must be signed within", "Rented copper invoice days unl", "Within the kettle signed 2024 un"]
    rows = [(i, t, "s") for i, t in enumerate(whole)] + [(5000 + i, t, "s") for i, t in enumerate(cut)]
    got = {x.doc_id: x.truncated for x in T.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(20 <= len(t) <= 35 and got[5000 + i] for i, t in enumerate(cut))
    assert sum(got[i] for i in range(len(whole))) <= 20
