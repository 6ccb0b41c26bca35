"""Most similar vectors for every vector by additive quantisation.

Vectors are written as sums of full-dimensional codewords, one from each residual codebook,
found by beam search. The first codeword names a cell; a vector is compared with the vectors
of the cells nearest to it. Tables of products between query and codewords give the score of
every code, stored norms turn it into a cosine, and the best of them are ranked again with
the vectors themselves.

Vectors of one direction form a class, named by the hash of the direction. Classes are
searched; ids are mapped to them at the end, so that an id may have several vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.plans.storage import small_or_shuffled, stored
from sheafline.sources.tables import table

DIMENSIONS = 96
#: Codebooks are fitted on a sample of at most so many vectors; every vector is then indexed.
SAMPLE_ROWS = 40_000
#: Cells number the root of the rows, as far as the sample has so many rows for each.
ROWS_A_CELL = 8
#: Codebooks after the first, their size, and the width of the encoding beam.
BOOKS, BOOK_SIZE, BEAM = 15, 256, 3
#: Cells looked at for a vector, or twice the root of the number of cells where that is more. Vectors
#: of a cosine of 0.85 or more lie in the nearest cells: fewer find them all.
PROBES, CLOSE_PROBES = 64, 12
#: Best codes kept for a query of each of its nearest NEAR cells and of each other one, and those of
#: one task that are ranked again with their vectors.
NEAR, NEAR_BEST, FAR_BEST, SHORTLIST = 8, 192, 32, 640
#: A code's cosine is taken to be at most so much under the true one: with a least cosine, codes
#: that stay further below it are passed over, and all others are ranked again.
MARGIN = 0.4
#: Vectors at home in one task, and vectors that ask in it, about: fuller groups of cells are
#: split on both sides.
TASK_ROWS = 48_000
#: Queries scored together.
QUERY_BLOCK = 4_096


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = 0.5 * (centers * centers).sum(1)
    for s in range(0, len(x), 8192):
        out[s : s + 8192] = (x[s : s + 8192] @ centers.T - half).argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of at most ``k`` clusters; empty clusters restart at a random row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        centers[used] = np.add.reduceat(x[order], first) / np.diff(np.r_[first, len(x)])[:, None]
        gone = np.setdiff1d(np.arange(k), used)
        centers[gone] = x[rng.choice(len(x), len(gone))]
    return centers


def _cells(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of cells; a cell with over four times its share of the sample is divided again."""
    first = kmeans(sample, wanted)
    at = _nearest(sample, first)
    held = np.bincount(at, minlength=len(first))
    full = np.flatnonzero(held > 4 * len(sample) / len(first))
    parts = [kmeans(sample[at == c], int(held[c] * len(first) // len(sample)), seed=5) for c in full]
    return np.concatenate([np.delete(first, full, 0), *parts]) if len(full) else first


def _halved(centers: np.ndarray, held: np.ndarray, times: int) -> np.ndarray:
    """Groups of near cells with about as many rows each: cells are halved along their main direction again and again."""
    group = np.zeros(len(centers), np.int64)
    for _ in range(times):
        for g in range(int(group.max()) + 1):
            own = np.flatnonzero(group == g)
            if len(own) < 2:
                continue
            x = centers[own] - centers[own].mean(0)
            order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
            before = np.cumsum(held[own[order]]) - held[own[order]]
            upper = own[order[before * 2 >= held[own].sum()]]
            if 0 < len(upper) < len(own):
                group[upper] = group.max() + 1
    return np.unique(group, return_inverse=True)[1]


def _look(x: np.ndarray, model: dict, probes: int | None = None) -> np.ndarray:
    """Which cells each vector looks at, as a row of flags."""
    score = x @ model["first"].T - model["half"]
    n, probes = score.shape[1], probes or model["probes"]
    if probes >= n:
        return np.ones(score.shape, bool)
    return score >= np.partition(score, n - probes, axis=1)[:, n - probes, None]


def fit(sample: np.ndarray, total: int, probes: int = PROBES, exact: bool = False) -> dict:
    """Residual codebooks of a sample of unit vectors, and the groups of cells for ``total`` vectors.

    ``exact`` looks at all cells.
    """
    wanted = 2 ** round(np.log2(max(total, 1) ** 0.5))
    first = _cells(sample, int(np.clip(wanted, 1, max(1, len(sample) // ROWS_A_CELL))))
    at = _nearest(sample, first)
    residual, books = sample - first[at], []
    for m in range(BOOKS):
        book = kmeans(residual, BOOK_SIZE, rounds=4, seed=11 + m)
        books.append(book)
        residual = residual - book[_nearest(residual, book)]
    n = len(first)
    model = {"first": first, "half": 0.5 * (first * first).sum(1), "books": books, "probes": n if exact else max(probes, round(2 * n**0.5 * probes / PROBES))}
    group = _halved(first, np.bincount(at, minlength=n), max(0, round(np.log2(max(total, 1) / TASK_ROWS))))
    groups = int(group.max()) + 1
    # the rows at home in a group and those that ask in it, as the sample tells them, are split into parts
    scale = total / max(len(sample), 1) / TASK_ROWS
    asks = np.zeros(groups)
    for s in range(0, len(sample), 4096):
        seen = _look(sample[s : s + 4096], model)
        asks += [seen[:, group == g].any(1).sum() for g in range(groups)]
    split = lambda count: np.maximum(1, np.round(count * scale)).astype(np.int64)
    return model | {"group": group, "groups": groups, "home_parts": split(np.bincount(group[at], minlength=groups)), "ask_parts": split(asks)}


def _least(a: np.ndarray, few: int) -> np.ndarray:
    """Places of the ``few`` least numbers of each row, least first; they are overwritten."""
    out, rows = np.empty((len(a), few), np.intp), np.arange(len(a))
    for k in range(few):
        out[:, k] = a.argmin(1)
        a[rows, out[:, k]] = np.inf
    return out


def encode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cell, codes, norm`` of unit vectors: the best sum of codewords that a beam search finds."""
    first = model["first"]
    score = 0.5 * (first * first).sum(1) - x @ first.T
    width = min(BEAM, len(first))
    cell = _least(score, width)
    rows = np.arange(len(x))[:, None]
    residual = x[:, None, :] - first[cell]
    codes = np.zeros((len(x), width, 0), np.uint8)
    for book in model["books"]:
        b, k = residual.shape[1], len(book)
        distance = (residual.reshape(-1, x.shape[1]) @ (-2 * book.T)).reshape(len(x), b, k)
        distance += (book * book).sum(1)
        distance += np.einsum("nbd,nbd->nb", residual, residual)[:, :, None]
        flat = distance.reshape(len(x), -1)
        keep = min(BEAM, flat.shape[1])
        best = _least(flat, keep)
        parent, code = best // k, best % k
        codes = np.concatenate([codes[rows, parent], code[:, :, None].astype(np.uint8)], 2)
        cell = cell[rows, parent]
        residual = residual[rows, parent] - book[code]
    best = (residual**2).sum(2).argmin(1)
    pick = np.arange(len(x)), best
    return cell[pick], codes[pick], np.linalg.norm(x - residual[pick], axis=1)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("nd,nd->n", raw, raw, dtype=np.float64)).astype(np.float32)[:, None]


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.Array.from_buffers(pa.binary(a.shape[1] * a.itemsize), len(a), [None, pa.py_buffer(a)]).cast(pa.binary())


def _floats(column: pa.Array | pa.ChunkedArray, kind, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def _prepare(dims: int):
    """``id, vector`` to ``id, v, vector``: rows that take part, their class and their numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            long = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), dims), False)
            batch = batch.filter(pa.compute.and_(long, batch.column(0).is_valid()))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null numbers become nan
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[fine]
            largest = np.abs(x).max(1, keepdims=True, initial=0)
            # numbers beyond the range of floats are scaled, all others stay as they are
            raw = np.where((largest > 1e15) | (largest < 1e-15), x / largest, x).astype(np.float32)
            direction = _unit(raw) + np.float32(0)
            v = np.array([xxhash.xxh3_64_intdigest(d.tobytes()) for d in direction], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), pa.array(v), _binary(raw)], names=["id", "v", "vector"])

    return run


_ROUTED = "group int, home_part int, ask_part int, v long, asks boolean, home int, codes binary, norm float, vector binary"


def _route(held, dims: int):
    """One row for each class and each task that it is at home in, asks in, or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        flags = np.zeros((len(m["first"]), m["groups"]), np.float32)
        flags[np.arange(len(flags)), m["group"]] = 1
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                batch = whole.slice(s, 1024)
                v, raw = batch.column(0).to_numpy(), _floats(batch.column(1), np.float32, dims)
                x = _unit(raw)
                cell, codes, norm = encode(x, m)
                home = m["group"][cell]
                asks = (_look(x, m).astype(np.float32) @ flags) > 0
                asks[np.arange(len(x)), home] = True
                mixed = v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                own_home = ((mixed >> np.uint64(40)) % m["home_parts"][home].astype(np.uint64)).astype(np.int64)
                # as a query: to every home part of each group it asks
                row, group = np.nonzero(asks)
                own_ask = ((mixed[row] >> np.uint64(20)) % m["ask_parts"][group].astype(np.uint64)).astype(np.int64)
                q, q_part = _repeated(m["home_parts"][group])
                # as a base vector: to every ask part of its group; where both meet, one row has both roles
                b, b_part = _repeated(m["ask_parts"][home])
                mine = np.flatnonzero(group == home[row])
                b, b_part = b[b_part != own_ask[mine][b]], b_part[b_part != own_ask[mine][b]]
                at = np.r_[row[q], b]
                to_group, to_home, to_ask = np.r_[group[q], home[b]], np.r_[q_part, own_home[b]], np.r_[own_ask[q], b_part]
                based = (to_group == home[at]) & (to_home == own_home[at])
                asking = np.r_[np.ones(len(q), bool), np.zeros(len(b), bool)]
                out = [pa.array(a.astype(np.int32)) for a in (to_group, to_home, to_ask)] + [pa.array(v[at]), pa.array(asking), pa.array(np.where(based, cell[at], -1).astype(np.int32))]
                take = pa.array(np.where(based, at, 0), mask=~based)
                out += [_binary(codes).take(take), pa.array(norm.astype(np.float32)).take(take), _binary(raw[at])]
                yield pa.RecordBatch.from_arrays(out, names=[c.split(" ")[0] for c in _ROUTED.split(", ")])

    return run


def _repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as told, and the number of each repeat."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _scored(x: np.ndarray, m: dict, cells: list, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int, np.ndarray, float]]:
    """For each cell: its number, the queries that look at it, the span of its codes, their products (code by query) as whole numbers, and the scale of these."""
    seen = _look(x, m)
    # a table for each codebook: product of every codeword with every query, so small that all sums fit in 16 bits
    tables, heads = [book @ x.T for book in m["books"]], m["first"] @ x.T
    scale = 32_000 / max(sum(float(np.abs(t).max()) for t in [heads, *tables]), 1e-9)
    heads = np.rint(heads * scale).astype(np.int16)
    # the products of one codeword number and query lie side by side, so that the queries of a cell are picked for all codebooks at once
    beside = np.zeros((max(len(t) for t in tables), len(x), -(-len(tables) // 4) * 4), np.int16)
    for j, products in enumerate(tables):
        beside[: len(products), :, j] = np.rint(products * scale)
    for cell, a, b in cells:
        q = np.flatnonzero(seen[:, cell])
        if len(q):
            score = np.repeat(heads[cell, q][None], b - a, 0)
            part = np.empty_like(score)
            own = np.take(beside, q, axis=1)
            for j in range(len(tables)):
                np.take(np.ascontiguousarray(own[:, :, j]), codes[a:b, j], axis=0, out=part, mode="clip")
                score += part
            yield cell, q, a, b, score, scale


def _over(x: np.ndarray, base: np.ndarray, m: dict, cells: list, codes: np.ndarray, norm: np.ndarray, least: float, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and place of the ``few`` best vectors of each query among all those whose code reaches ``least`` less MARGIN."""
    queries, places, cosines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for cell, q, a, b, score, scale in _scored(x, m, cells, codes):
        i, j = np.nonzero(score >= np.clip((least - MARGIN) * scale * norm[a:b, None], -32_000, 32_000).astype(np.int16))
        # one product of all is quicker than one for each code that is left
        cosine = (base[a:b] @ x[q].T)[i, j]
        fine = cosine >= least - 1e-5
        queries.append(q[j[fine]])
        places.append(i[fine] + a)
        cosines.append(cosine[fine])
    q, place, cosine = np.concatenate(queries), np.concatenate(places), np.concatenate(cosines)
    order = np.lexsort((-cosine, q))
    q, place = q[order], place[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < few
    return q[best], place[best]


def _best(x: np.ndarray, base: np.ndarray, m: dict, cells: list, codes: np.ndarray, norm: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and place of the ``few`` best vectors of each query among the SHORTLIST of best codes."""
    scored = np.full((len(x), NEAR * NEAR_BEST + m["probes"] * FAR_BEST), -np.inf, np.float32)
    place = np.zeros(scored.shape, np.int32)
    used = np.zeros(len(x), np.int64)
    close = _look(x, m, NEAR)
    for cell, q, a, b, score, scale in _scored(x, m, cells, codes):
        score = np.ascontiguousarray((score / (scale * norm[a:b, None])).T)
        for which, most in ((close[q, cell], NEAR_BEST), (~close[q, cell], FAR_BEST)):
            own, part, keep = q[which], score[which], min(most, b - a)
            if len(own):
                at = np.argpartition(part, b - a - keep, axis=1)[:, b - a - keep :]
                to = (own[:, None], used[own, None] + np.arange(keep))
                scored[to], place[to] = np.take_along_axis(part, at, 1), at + a
                used[own] += keep
    n = min(SHORTLIST, max(int(used.max()), 1))
    at = np.argpartition(scored, scored.shape[1] - n, axis=1)[:, scored.shape[1] - n :]
    none, place = np.take_along_axis(scored, at, 1) == -np.inf, np.take_along_axis(place, at, 1)
    cosine = np.empty(place.shape, np.float32)
    for s in range(0, len(x), 64):
        cosine[s : s + 64] = np.matmul(base[place[s : s + 64]], x[s : s + 64, :, None])[:, :, 0]
    cosine[none] = -np.inf
    few = min(few, n)
    at = np.argpartition(cosine, n - few, axis=1)[:, n - few :]
    q, at = np.repeat(np.arange(len(x)), few), at.ravel()
    return q[cosine[q, at] > -np.inf], place[q, at][cosine[q, at] > -np.inf]


def _search(held, k: int, least: float, exact: bool, dims: int):
    def run(rows: pa.Table) -> pa.Table:
        m = held.value
        # a repeated row counts once; a row with codes stands before one without
        v, home = rows.column("v").to_numpy(), rows.column("home").to_numpy()
        first = np.unique(v, return_index=True)[1]
        v, home, asks = v[first], home[first], rows.column("asks").to_numpy()[first]
        raw = _floats(rows.column("vector").take(pa.array(first)), np.float32, dims)
        x = _unit(raw)
        based = np.flatnonzero(home >= 0)
        based = based[np.argsort(home[based], kind="stable")]
        at = pa.array(first[based])
        codes = _floats(rows.column("codes").take(at), np.uint8, len(m["books"])).astype(np.intp)
        norm = np.maximum(rows.column("norm").take(at).to_numpy().astype(np.float32), 1e-9)
        cell, begin = np.unique(home[based], return_index=True)
        cells = list(zip(cell.tolist(), begin.tolist(), [*begin[1:].tolist(), len(based)]))
        asking = np.flatnonzero(asks)
        asking = asking[np.argsort(_nearest(x[asking], m["first"]), kind="stable")]
        found, base = [], x[based]
        for s in range(0, len(asking) if len(based) else 0, QUERY_BLOCK):
            q = asking[s : s + QUERY_BLOCK]
            # a few more than wanted, whose cosines are then those of the vectors as given
            few = k + 5
            if exact:
                cosine = x[q] @ base.T
                few = min(few, len(based))
                place = np.argpartition(cosine, len(based) - few, axis=1)[:, len(based) - few :].ravel()
                a = np.repeat(np.arange(len(q)), few)
            elif least - MARGIN > -1:
                a, place = _over(x[q], base, m, cells, codes, norm, least, few)
            else:
                a, place = _best(x[q], base, m, cells, codes, norm, few)
            y = based[place]
            a, y = a[y != q[a]], y[y != q[a]]
            left, right = raw[q[a]].astype(np.float64), raw[y].astype(np.float64)
            cosine = np.round(np.einsum("ij,ij->i", left, right) / (np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)), 9)
            order = np.lexsort((v[y], -cosine, a))
            a, y, cosine = a[order], y[order], cosine[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            keep = (rank < k) & (cosine >= least)
            found.append((v[q[a[keep]]], v[y[keep]], cosine[keep]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("v", "other", "cosine"), columns)))

    return run


def neighbours(records: DataFrame, k: int = 10, least: float = -1.0, probes: int = PROBES, exact: bool = False, dims: int = DIMENSIONS) -> DataFrame:
    """``id, other, cosine, rank``: the ``k`` most similar other rows of every row, of cosine ``least`` or more.

    Rows with a null id or with a null, short, empty, all-zero or not-finite vector take no
    part. Repeated rows count once; an id with several vectors is as near as its nearest one.
    Vectors of one direction are searched once. Cosines have nine digits; equal ones are ranked
    by id, and which of them stands at the last place is open. An empty table gives an empty
    result. Only ``chunk_id`` and ``vector`` are read. ``exact`` compares every vector with
    every other one, in blocks; without it a small part of the neighbours may be missed.
    """
    spark = records.sparkSession
    schema = f"id {records.schema['chunk_id'].dataType.simpleString()}, v long, vector binary"
    rows = records.select("chunk_id", "vector").mapInArrow(_prepare(dims), schema)
    members = stored(rows.select("id", "v").distinct())
    counts = members.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    total = counts.count()
    if not total:
        return spark.createDataFrame([], f"id {members.schema['id'].dataType.simpleString()}, other string, cosine double, rank int")
    # the smallest id of a class stands for it
    copies = stored(members.join(counts.where("n > 1").select("v", F.col("id").alias("rep")), "v").where("id <> rep").select("id", "v"))
    single = rows.join(small_or_shuffled(copies), ["id", "v"], "left_anti").select("v", "vector")
    share = int(min(1.0, SAMPLE_ROWS / total) * 1_000_000)
    sample = single.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < share).limit(SAMPLE_ROWS).toArrow()
    sample = sample if sample.num_rows else single.limit(SAMPLE_ROWS).toArrow()
    held = spark.sparkContext.broadcast(fit(_unit(_floats(sample.column("vector"), np.float32, dims)), total, probes, exact))
    routed = single.mapInArrow(_route(held, dims), _ROUTED)
    # ids with several vectors can take more than one place of a list
    several = members.groupBy("id").count().agg(F.max("count")).first()[0]
    wanted = k * min(several, 4) + (several > 1)
    found = routed.groupBy("group", "home_part", "ask_part").applyInArrow(_search(held, wanted, least, exact, dims), "v long, other long, cosine double")
    best = Window.partitionBy("v").orderBy(F.desc("cosine"), "other")
    top = stored(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted).drop("rank"))
    # the first ids of a class are enough for anyone's list
    first = Window.partitionBy("v").orderBy("id")
    few = stored(members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= wanted + 1).drop("r"))
    named = top.join(few.select(F.col("v").alias("other"), F.col("id").alias("name")), "other").select("v", "name", "cosine")
    own = few.join(copies.select("v").distinct(), "v", "left_semi").select("v", F.col("id").alias("name"), F.lit(1.0).alias("cosine"))
    entry = F.struct((-F.col("cosine")).alias("order"), "name")
    lists = named.unionByName(own).groupBy("v").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, wanted + 1).alias("near"))
    each = members.join(lists, "v").select("id", F.filter("near", lambda x: x["name"] != F.col("id")).alias("near"))
    if several > 1:
        pairs = each.select("id", F.explode("near").alias("x")).groupBy("id", "x.name").agg(F.min("x.order").alias("order"))
        each = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("order", "name"))).alias("near"))
    ranked = each.select("id", F.posexplode(F.slice("near", 1, k)).alias("rank", "x"))
    return ranked.select("id", F.col("x.name").alias("other"), (-F.col("x.order")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours(table(spark, folder, "vector_records", "chunk_id", "vector"), least=0.85, probes=CLOSE_PROBES)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar chunks of each chunk, whatever their cosine."""
    near = neighbours(table(spark, folder, "vector_records", "chunk_id", "vector"))
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))


_COSINES = """
with v as (select distinct chunk_id, vector from vector_records where chunk_id is not null and len(vector) = 96),
     f as (select chunk_id, cast(vector as double[96]) vector from v
           where len(list_filter(vector, lambda e: e is not null and isfinite(e))) = 96 and len(list_filter(vector, lambda e: e <> 0)) > 0),
     c as (select a.chunk_id a, b.chunk_id b, max(round(array_cosine_similarity(a.vector, b.vector), 9)) s from f a join f b on a.chunk_id <> b.chunk_id group by all)"""
QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}
SQL = {
    "p1_found": _COSINES
    + """, r as (select a, b, row_number() over (partition by a order by s desc, b) r from c where s >= 0.85)
select distinct least(a, b) chunk_id_a, greatest(a, b) chunk_id_b from r where r <= 10""",
    "p1_neighbours": _COSINES
    + """, r as (select a, b, s, cast(row_number() over (partition by a order by s desc, b) as int) r from c)
select a chunk_id, b neighbour_id, r as rank, round(s, 6) cosine from r where r <= 10""",
}
