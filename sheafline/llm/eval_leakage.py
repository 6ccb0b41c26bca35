"""Find evaluation passages in training text with a distributed positional inverted index.

The training documents are indexed in blocks: for each term, by its hash, the sorted positions
of its occurrences. The index is stored as a table, one row a block, and serves any number of
test items. Term counts over all documents come from it and rank the test terms; each run of
``run`` consecutive words of an item is then looked up by intersecting the offset-adjusted
position lists of its rarest terms, and the survivors are compared word by word. Proximity
matches let the lists, and each word, differ by a few places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.plans.storage import stored
from sheafline.sources.tables import table

_WORD = re.compile("[a-z0-9]+")
#: Limits of one index block: rows and words. A longer document is a block of its own.
BLOCK_ROWS, BLOCK_WORDS = 8_192, 2_000_000
#: Test items are searched in blocks of so many, each over the whole index.
ITEM_BLOCK = 20_000
#: Proximity matches: a word counts when it stands at most SLACK places off, and a run matches when
#: all but MISSING of its words count.
SLACK, MISSING = 3, 2


def words(text: str | None) -> list[str]:
    """Longest runs of ASCII letters and digits of the lower-cased text; none for null."""
    return _WORD.findall(text.lower()) if text else []


def _term(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _index_block(flat: np.ndarray, terms: np.ndarray, lengths: list[int], gap: int) -> dict:
    """Inverted lists of one block, words given as places in ``terms``; positions of different documents are ``gap`` apart at least."""
    lengths = np.array(lengths, np.int64)
    starts = np.cumsum(lengths + gap) - lengths - gap
    where = np.arange(len(flat)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    by_hash = np.argsort(terms)
    place = np.empty(len(terms), np.int64)
    place[by_hash] = np.arange(len(terms))
    flat = place[flat]
    return {"starts": starts, "terms": terms[by_hash].view(np.int64), "counts": np.bincount(flat, minlength=len(terms)), "positions": where[np.argsort(flat, kind="stable")].astype("<u4").tobytes()}


def _build_index(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, known, lengths, kinds = [], [], {}, [], None

        def block():
            row = _index_block(np.array(ids, np.int32), np.array([_term(w) for w in known], np.uint64), lengths, gap)
            lists = [pa.array([row[c]], pa.list_(pa.int64())) for c in ("starts", "terms", "counts")]
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(kinds)), *lists, pa.array([row["positions"]], pa.binary())], names=["docs", "starts", "terms", "counts", "positions"])

        for batch in batches:
            kinds = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if keys and (len(keys) >= BLOCK_ROWS or len(ids) + len(found) > BLOCK_WORDS):
                    yield block()
                    keys, ids, known, lengths = [], [], {}, []
                keys.append(key)
                ids.extend([known.setdefault(w, len(known)) for w in found])
                lengths.append(len(found))
        if keys:
            yield block()

    return run


def rarest_pairs(item: np.ndarray, counts: np.ndarray, run: int, of: int = 2) -> set[tuple[int, int, int]]:
    """For each window of ``run`` words all pairs of places of its ``of`` rarest terms, least frequent in the corpus.

    With two, windows are not told apart and begin at 0.
    """
    cost = counts[item]
    out = set()
    for s in range(len(item) - run + 1):
        rare = sorted((np.lexsort((np.arange(run), cost[s : s + run]))[:of] + s).tolist())
        out |= {(a, b, s if of > 2 else 0) for i, a in enumerate(rare) for b in rare[i + 1 :]}
    return out


def _block(batch: pa.RecordBatch, i: int, vocabulary: np.ndarray):
    """Documents, starts, positions and the span of each term of the vocabulary in one block of the index (empty where it is absent)."""
    docs, starts, terms, counts = (batch.column(k)[i].values for k in range(4))
    positions = np.frombuffer(batch.column(4)[i].as_py(), "<u4").astype(np.int64)
    terms, ends = terms.to_numpy().view(np.uint64), np.cumsum(counts.to_numpy())
    at = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
    here = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
    begin = np.r_[0, ends[:-1]] if len(ends) else ends
    return docs, starts.to_numpy(), positions, np.where(here, begin[at] if len(terms) else 0, 0), np.where(here, ends[at] if len(terms) else 0, 0)


def _words_of(positions: np.ndarray, first: np.ndarray, last: np.ndarray, edge: int) -> np.ndarray:
    """The block's words in order, by their place in the vocabulary (-1 for others), with ``edge`` more at both ends."""
    text = np.full(int(positions.max()) + 1 + 2 * edge, -1, np.int32)
    for t in np.flatnonzero(last > first).tolist():
        text[positions[first[t] : last[t]] + edge] = t
    return text


def _found(p: dict, positions: np.ndarray, first: np.ndarray, last: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair's two lists meet, less the places in the item: start of the item in the block, and the pair."""
    there = np.flatnonzero((last > first)[p["ta"]] & (last > first)[p["tb"]])
    starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in there.tolist():
        a, b, ta, tb = p["a"][k], p["b"][k], p["ta"][k], p["tb"][k]
        la, lb = positions[first[ta] : last[ta]] - a, positions[first[tb] : last[tb]] - b
        if len(lb) < len(la):
            la, lb = lb, la
        at = np.searchsorted(lb, la - slack)
        both = la[(at < len(lb)) & (lb[np.minimum(at, len(lb) - 1)] <= la + slack)]
        starts.append(both)
        which.append(np.full(len(both), k))
    return np.concatenate(starts), np.concatenate(which)


def _match(plan, run: int):
    """Exact matches: ``doc_id, item_id``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        items, begins, lengths = p["words"], p["begins"], p["lengths"]
        for batch in batches:
            for i in range(batch.num_rows):
                docs, starts, positions, first, last = _block(batch, i, p["vocabulary"])
                diagonal, k = _found(p, positions, first, last, 0)
                if not len(k):
                    continue
                # the block's words, seen again in order, confirm each survivor word by word
                text = _words_of(positions, first, last, run)
                item, at = p["item_of"][k], p["a"][k]
                left, right = np.zeros(len(k), int), np.zeros(len(k), int)
                for step, total in ((-1, left), (1, right)):
                    alive = np.ones(len(k), bool)
                    for o in range(1, run):
                        j = at + step * o
                        alive &= (j >= 0) & (j < lengths[item])
                        here = np.where(alive, j, 0)
                        place = np.clip(diagonal + here + run, 0, len(text) - 1)
                        alive &= text[place] == items[begins[item] + here]
                        total += alive
                hit = left + right + 1 >= run
                if hit.any():
                    doc = np.searchsorted(starts, diagonal[hit] + at[hit], side="right") - 1
                    pairs = np.unique(np.c_[doc, item[hit]], axis=0)
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(pairs[:, 0])), p["ids"].take(pa.array(pairs[:, 1]))], names=["doc_id", "item_id"])

    return search


def _near(plan, run: int):
    """Proximity matches: ``doc_id, item_id, place, words``: each word of the item that counts in a matching run."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        edge = run + SLACK
        for batch in batches:
            for i in range(batch.num_rows):
                docs, starts, positions, first, last = _block(batch, i, p["vocabulary"])
                diagonal, k = _found(p, positions, first, last, SLACK)
                if not len(k):
                    continue
                text = _words_of(positions, first, last, edge)
                item, window = p["item_of"][k], p["window"][k]
                offsets = window[:, None] + np.arange(run)
                wanted = p["words"][p["begins"][item][:, None] + offsets]
                place = diagonal[:, None] + offsets + edge
                counts = np.zeros(place.shape, bool)
                for d in range(-SLACK, SLACK + 1):
                    counts |= text[np.clip(place + d, 0, len(text) - 1)] == wanted
                hit = counts.sum(1) >= run - MISSING
                row, word = np.nonzero(counts & hit[:, None])
                if len(row):
                    doc = np.searchsorted(starts, diagonal[row] + p["a"][k[row]], side="right") - 1
                    found = np.unique(np.c_[doc, item[row], offsets[row, word]], axis=0)
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(found[:, 0])), p["ids"].take(pa.array(found[:, 1])), pa.array(found[:, 2].astype(np.int32)), pa.array(p["lengths"][found[:, 1]].astype(np.int32))], names=["doc_id", "item_id", "place", "words"])

    return search


def build_index(docs: DataFrame, gap: int) -> DataFrame:
    """Stored positional index of all terms of ``docs(doc_id, text)``; runs of up to ``gap`` words can be looked up."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_build_index(gap), f"docs array<{key}>, starts array<bigint>, terms array<bigint>, counts array<bigint>, positions binary"))


def _counted(held):
    """``term, n``: occurrences of each term of the vocabulary in the blocks of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, _, first, last = _block(batch, i, held.value)
                total += last - first
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    return run


def leaks(docs: DataFrame, items: DataFrame, run: int = 10) -> DataFrame:
    """Distinct ``doc_id, item_id`` where the document holds ``run`` consecutive words of the item in a row.

    Nulls: a null or empty text has no words, hence no match; null ids are kept. Items of fewer
    than ``run`` words match nothing. Repeated rows and ties change nothing, as the result is
    distinct. Long texts are indexed whole. Empty tables give an empty result. Only the named
    columns are read, so others cannot clash.
    """
    return _searched(build_index(docs, 2 * run), items, run, _match, "").distinct()


def near_leaks(docs: DataFrame, items: DataFrame, run: int = 10) -> DataFrame:
    """``doc_id, item_id, share``: documents that hold ``run`` consecutive words of an item exactly or in
    proximity, and the share of the item's words that such runs cover.

    A run is there when all but MISSING of its words stand at most SLACK places from where they
    would stand, counted from two of its four rarest terms. So inserted, dropped, changed and
    swapped words are passed over. Other cases as in ``leaks``.
    """
    found = _searched(build_index(docs, 2 * run), items, run, _near, ", place int, words int")
    return found.groupBy("doc_id", "item_id", "words").agg((F.count_distinct("place") / F.col("words")).alias("share")).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _searched(index: DataFrame, items: DataFrame, run: int, match, more: str) -> DataFrame:
    """Matches of all items in the index, block of items by block of items."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    key = index.schema["docs"].dataType.elementType.simpleString()
    schema = f"doc_id {key}, item_id {items.schema['item_id'].dataType.simpleString()}{more}"
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        matches = index.mapInArrow(match(_plan(index, part, run, 4 if match is _near else 2), run), schema)
        found = matches if found is None else found.unionByName(matches)
    return found


def _plan(index: DataFrame, items: DataFrame, run: int, rare: int):
    """Broadcast terms, words and looked-up pairs of one block of test items."""
    context = index.sparkSession.sparkContext
    rows = items.toArrow()  # one block of the stated test set
    texts = [words(t) for t in rows.column("text").to_pylist()]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts if len(t) >= run for w in t))}
    vocabulary = np.array([_term(w) for w in known], np.uint64)
    counts = np.zeros(len(known), np.int64)
    for term, n in index.mapInArrow(_counted(context.broadcast(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # one row a test term
        counts[term] = n
    coded = [np.array([known[w] for w in t], np.int32) if len(t) >= run else np.zeros(0, np.int32) for t in texts]
    pairs = np.array([(a, b, s, t[a], t[b], i) for i, t in enumerate(coded) for a, b, s in sorted(rarest_pairs(t, counts, run, rare))], np.int64).reshape(-1, 6)
    lengths = np.array([len(t) for t in coded], np.int64)
    plan = dict(zip(("a", "b", "window", "ta", "tb", "item_of"), pairs.T)) | {
        "vocabulary": vocabulary,
        "words": np.concatenate([*coded, np.zeros(1, np.int32)]),
        "begins": np.cumsum(lengths) - lengths,
        "lengths": lengths,
        "ids": pa.concat_arrays(rows.column("item_id").chunks) if rows.num_rows else pa.array([], rows.schema.field("item_id").type),
    }
    return context.broadcast(plan)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items with their suite and the number of documents that hold them."""
    found = p8_found(spark, folder).groupBy("item_id").agg(F.count("doc_id").alias("documents"))
    return table(spark, folder, "eval_items", "item_id", "suite").distinct().join(found, "item_id")


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and proximity matches with the share of the item's words that they cover."""
    found = near_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))
    return found.withColumn("share", F.round("share", 6))


_RUNS = """
with i as (select distinct item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items where text is not null),
     d as (select distinct doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null),
     ig as (select distinct item_id, array_to_string(w[k:k + 9], ' ') g from (select item_id, w, unnest(range(1, len(w) - 8)) k from i where len(w) >= 10)),
     dg as (select doc_id, array_to_string(w[k:k + 9], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 8)) k from d where len(w) >= 10)),
     f as (select distinct doc_id, item_id from dg join ig using (g))
"""
QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_near": p8_near}
SQL = {
    "p8_found": _RUNS + "select doc_id, item_id from f",
    "p8_items": _RUNS + "select item_id, suite, count(*) as documents from f join (select distinct item_id, suite from eval_items) using (item_id) group by item_id, suite",
}
