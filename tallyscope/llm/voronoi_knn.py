"""Exact top-k inner products by a Voronoi kNN join.

Inner products become distances: with M the greatest candidate norm, a candidate x gets the coordinate
sqrt(M^2 - |x|^2) more and a query q a zero, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x. So the largest scores of a
query are its nearest neighbours, ties included.

1. A fixed number of pivots, taken by hash over all candidates, divides both sides into Voronoi cells.
2. Summaries of cells (greatest and least distance to the pivot; for candidates also the least distances of the k + 1
   nearest ids, each id once, since all rows of the query's own id are excluded) bound the distance of the
   k-th neighbour of any query of a cell, by the triangle inequality.
3. A candidate is replicated to a group of query cells only if its distance to its own pivot lets it come as near as
   the group's bound. Groups of cells hold about as many queries as a block.
4. Query blocks and candidate blocks of a group meet by (group, slice): candidates are dealt over slices by hash and
   query blocks copied to them, so no cell, however full, meets in one task. Scores are exact integers; each task keeps
   the k best of its blocks, and a last step the k best of all.

Vectors that are null or hold null or non-finite components take no part; vectors of different length are compared
over their common components (the shorter is filled with zeros). Ties go to the smaller id; a query never returns
rows of its own id. Repeated ids are candidates each. Components are floor(scale * x), scores 64-bit integers (the
components' absolute values must stay under 2^31). An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.llm.words import short_batches
from tallyscope.session import stored

PIVOTS, GROUPS, BLOCK = 64, 12, 1024
#: Room for rounding in distances, as a share of the largest numbers involved.
SLACK = 1e-6


def whole_vectors(vectors: DataFrame, ids: str, vector: str, scale: int) -> DataFrame:
    """(id, v): components as integers, for the rows that take part."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & F.col(ids).isNotNull()).where(finite) \
        .select(F.col(ids).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).cast("array<long>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length from a list column."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Candidates with the coordinate that gives all of them the greatest norm."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, ids: str = "vec_id", vector: str = "embedding", scale: int = 256,
          pivots: int = PIVOTS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row that ``is_query`` marks (a column over ``id``)."""
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, ids, vector, scale))
    schema = "query_id long, rank int, vec_id long, score long"
    size = F.size("v")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width, most, largest, total = rows.agg(F.max(size), F.max(norm), F.max(F.when(size > 0, F.greatest(F.array_max("v"), -F.array_min("v")))), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], schema)
    width = max(1, width)
    exact = width * float(largest or 0) ** 2 < 2 ** 53  # then doubles hold every partial sum
    heads = rows.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).collect()
    pivot = lifted(np.unique(np.array([[*r.v, *[0] * (width - len(r.v))] for r in heads], np.int64), axis=0), most)
    between = distances(pivot, pivot)
    slack = SLACK * (np.sqrt(most) + 1)
    cells = len(pivot)

    def measured(batches):
        for batch in batches:
            x = matrix(batch.column("v"), width)
            yield batch, x

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x, pivot)
        cell = d.argmin(1)
        return cell, d[np.arange(len(cell)), cell]

    # Summaries, for each task a row for each near id of a cell and one for the queries of each cell.
    def summaries(batches):
        least: list[dict[int, float]] = [{} for _ in range(cells)]
        reach, count = np.full(cells, -1.0), np.zeros(cells, np.int64)
        for batch, x in measured(batches):
            own = batch.column("id").to_numpy()
            cell, d = near(lifted(x, most))
            by = np.lexsort((d, own, cell))
            by = by[np.r_[True, (own[by[1:]] != own[by[:-1]]) | (cell[by[1:]] != cell[by[:-1]])][:len(by)]]
            by = by[np.lexsort((d[by], cell[by]))]
            by = by[np.arange(len(by)) - np.searchsorted(cell[by], cell[by]) <= k]
            for c, i, far in zip(cell[by].tolist(), own[by].tolist(), d[by].tolist()):
                least[c][i] = min(far, least[c].get(i, far))
            for c in np.unique(cell).tolist():
                least[c] = dict(sorted(least[c].items(), key=lambda e: (e[1], e[0]))[:k + 1])
            query = batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            if query.any():
                cell, d = near(np.concatenate([x[query].astype(np.float64), np.zeros((query.sum(), 1))], 1))
                np.maximum.at(reach, cell, d)
                count += np.bincount(cell, minlength=cells)
        out = [(c, i, far, -1.0, 0) for c in range(cells) for i, far in least[c].items()]
        out += [(c, None, None, float(reach[c]), int(count[c])) for c in range(cells) if count[c]]
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(list(zip(*out)) or [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names=["cell", "near", "far", "reach", "n"])

    marked = rows.withColumn("query", F.coalesce(is_query, F.lit(False)))
    parts = marked.mapInArrow(summaries, "cell long, near long, far double, reach double, n long") \
        .groupBy("cell", "near").agg(F.min("far").alias("far"), F.max("reach").alias("reach"), F.sum("n").alias("n"))
    nearest = F.collect_list(F.when(F.col("near").isNotNull(), F.struct("far", "near")))
    summary = parts.groupBy("cell").agg(F.slice(F.array_sort(nearest), 1, k + 1).alias("least"), F.max("reach").alias("reach"), F.sum("n").alias("n")).collect()
    reach, count, least = np.full(cells, -1.0), np.zeros(cells, np.int64), []
    for row in summary:
        reach[row.cell], count[row.cell] = row.reach, row.n
        least += [(row.cell, e.near, e.far) for e in row.least]
    asked = np.flatnonzero(count)
    if not len(asked):
        return spark.createDataFrame([], schema)

    # The k-th neighbour of a query of cell i is at most this far: k + 1 ids, one of which may be its own.
    bound = np.full(cells, np.inf)
    at, known, far = (np.array(column) for column in zip(*least))
    for i in asked.tolist():
        upper = reach[i] + between[i, at] + far
        by = np.argsort(upper, kind="stable")
        first = np.sort(np.unique(known[by], return_index=True)[1])  # of each id the least
        if len(first) > k:
            bound[i] = upper[by[first[k]]] + slack
    # Groups of neighbouring cells, each with about the same number of queries.
    order = asked[np.argsort(between[asked[0], asked], kind="stable")]
    group = np.full(cells, -1)
    group[order] = np.minimum((np.cumsum(count[order]) - count[order]) * groups // count.sum(), groups - 1)
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)

    def blocks(batches):
        """Candidates for each group they may serve, in blocks of one slice."""
        held: dict[tuple[int, int], list] = {}

        def packed(key):
            own, x = map(np.concatenate, zip(*held.pop(key)))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["group", "slice", "cid", "c"])

        for batch, x in measured(batches):
            own = batch.column("id").to_numpy()
            cell, d = near(lifted(x, most))
            part = ((own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % slices
            for g in range(groups):
                mine = np.flatnonzero(group == g)
                if not len(mine):
                    continue
                # |d(x, p_j) - d(p_i, p_j)| - reach_i is the least distance to a query of cell i.
                wanted = (np.abs(between[mine][:, cell] - d) - reach[mine][:, None] <= bound[mine][:, None] + slack).any(0)
                for s in np.unique(part[wanted]).tolist():
                    take = wanted & (part == s)
                    held.setdefault((g, s), []).append((own[take], x[take]))
                    if sum(len(o) for o, _ in held[g, s]) >= 2 * block:
                        yield packed((g, s))
        for key in list(held):
            yield packed(key)

    def questions(batches):
        for batch, x in measured(batches):
            own = batch.column("id").to_numpy()
            cell, _ = near(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], 1))
            for g in np.unique(group[cell]).tolist():
                at = np.flatnonzero(group[cell] == g)
                for begin in range(0, len(at), block):
                    some = at[begin:begin + block]
                    n = slices
                    yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([own[some].tobytes()] * n, pa.binary()), pa.array([x[some].astype(kind).tobytes()] * n, pa.binary())], names=["group", "slice", "qid", "q"])

    kind = np.int16 if (largest or 0) < 2 ** 15 else np.int64

    def best(own: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each row, ties to the smaller id; columns are in order of id, so a stable sort settles ties."""
        take = np.argsort(-score, axis=1, kind="stable")[:, :k] if score.shape[1] <= 4 * k else None
        if take is None:
            edge = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]  # the k-th best score
            take = np.argsort(np.where(score > edge, 0, np.where(score == edge, 1, 2)), axis=1, kind="stable")[:, :k]
        return own[take], np.take_along_axis(score, take, 1)

    def meet(batches):
        lowest = -(1 << 62)  # below every score; its negative is still a number
        for batch in batches:
            for qid, q, cid, c in zip(*(batch.column(n).to_pylist() for n in ("qid", "q", "cid", "c"))):
                asking, own = np.frombuffer(qid, np.int64), np.frombuffer(cid, np.int64)
                a, b = np.frombuffer(q, kind).reshape(-1, width), np.frombuffer(c, kind).reshape(-1, width)
                by = np.argsort(own, kind="stable")
                own, b = own[by], b[by]
                score = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T
                self_at = asking[:, None] == own[None, :]
                score[self_at] = lowest
                found, value = best(own, score)
                there = value > lowest
                row, column = np.nonzero(there)
                # Rows of one query id answer together, so their k best suffice.
                by = np.lexsort((found[row, column], -value[row, column], asking[row]))
                by = by[np.arange(len(by)) - np.searchsorted(asking[row][by], asking[row][by]) < k]
                row, column = row[by], column[by]
                yield pa.RecordBatch.from_arrays([pa.array(asking[row]), pa.array(found[row, column]), pa.array(value[row, column])], names=["query_id", "vec_id", "score"])

    candidate = rows.mapInArrow(blocks, "group long, slice long, cid binary, c binary")
    query = marked.where("query").select("id", "v").mapInArrow(questions, "group long, slice long, qid binary, q binary")
    found = query.join(candidate, ["group", "slice"]).select("qid", "q", "cid", "c").mapInArrow(meet, "query_id long, vec_id long, score long")
    with short_batches(spark):
        found = stored(found)
    # At most k rows of each pair of blocks; the k best of a query are kept while they are gathered.
    ranked = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.low")).alias("score"))
