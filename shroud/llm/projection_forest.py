"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves a bounded sample of the vectors again and again at the median of their projections on
a random direction, down to leaves of `leaf_size` sample rows. Every vector of the table is indexed:
it goes down each tree to one leaf. A query searches all trees at once through one priority queue:
the open branch nearest to the query (the sum of squared distances to the cutting planes on its way)
is opened next, until the leaves reached hold `search_share` of the table's rows, counted with
repeats, or `search_least` rows. All rows of these leaves are compared with the query by their exact
distance in double precision.

On Spark: trees go out by broadcast (their size depends on the sample alone) and give every row its
leaves in a narrow step; leaves are counted over all rows. Neighbouring leaves of a tree form cells
of about `cell_rows` rows, a larger leaf is dealt to several cells. A query is sent once to each cell
that holds a leaf it opened, with the set of these leaves; rows and queries meet by an equi-join on
(tree, cell), in blocks of bounded size, and each block answers with `k` rows a query, folded by one
aggregation and one ranked window. So a leaf with a third of all rows becomes many blocks, and no
task holds more than one block of rows and one of queries.

Recall depends on the data: where near neighbours are hardly nearer than others, any tree search
must look at a large share of the rows, and `search_share` says how large. (The test vectors are
such: 64 nearly independent directions. With the defaults, recall there is 0.95 to 0.98, see README.)
On clustered vectors a share of a few hundredths is enough.

Defined cases: a vector that is null, zero, holds a null or non-finite value, or has another length
than most, takes no part; nor does a null id. A query is an id: rows of the query's own id are not
its candidates, and rows that share an id count once, by the nearest. Fewer candidates than `k` are
all returned; a table without usable vectors gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table
from .common import tidy
from .vectors import matrix, usable_vectors

QUERY_BLOCK = 64  # queries compared with a block's rows at once


@dataclass
class Tree:
    """Inner node i: direction, cut, left and right child; children below 0 are leaves ~child, which
    are numbered from left to right."""
    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    root: int
    leaves: int

    def leaf_of(self, X: np.ndarray) -> np.ndarray:
        at = np.full(len(X), self.root, dtype=np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", X[inner], self.directions[node]) > self.cuts[node]
            at[inner] = self.children[node, right.astype(int)]
        return ~at


def grow_tree(sample: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    directions, cuts, children, leaves = [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf_size:
            way = rng.standard_normal(sample.shape[1])
            way /= np.linalg.norm(way)
            along = sample[rows] @ way
            cut = float(np.median(along))
            right = along > cut
            if not right.any():  # more than half lie on the median: cut off what is below it
                below = along[along < cut]
                cut = float(below.max()) if below.size else cut
                right = along > cut
            if right.any() and not right.all():
                at = len(cuts)
                directions.append(way), cuts.append(cut), children.append([0, 0])
                children[at] = [grow(rows[~right]), grow(rows[right])]
                return at
        leaves += 1
        return ~(leaves - 1)

    root = grow(np.arange(len(sample)))
    return Tree(np.array(directions).reshape(len(cuts), sample.shape[1]), np.array(cuts), np.array(children, dtype=np.int64).reshape(-1, 2), root, leaves)


def open_leaves(forest: list[Tree], sizes: list[np.ndarray], query: np.ndarray, want: float) -> list[list[int]]:
    """Per tree, the leaves that one shared queue opens until they hold `want` rows (or all are open)."""
    offsets = [t.directions @ query - t.cuts for t in forest]
    opened: list[list[int]] = [[] for _ in forest]
    queue, held = [(0.0, t, tree.root) for t, tree in enumerate(forest)], 0
    heapq.heapify(queue)
    while queue and held < want:
        far, t, node = heapq.heappop(queue)
        while node >= 0:
            off = offsets[t][node]
            left, right = forest[t].children[node]
            near, other = (right, left) if off > 0 else (left, right)
            heapq.heappush(queue, (far + off * off, t, int(other)))
            node = int(near)
        opened[t].append(~node)
        held += int(sizes[t][~node])
    return opened


def bounded_sample(rows: DataFrame, total: int, most: int) -> np.ndarray:
    """At most `most` vectors, by the hash of their ids and values (so that rows that repeat an id are
    drawn apart)."""
    near = rows
    if total > most:  # a hash threshold a little above, then the least hashes: no sort of the table
        near = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < F.lit(int((most + 6 * most ** 0.5) / total * (1 << 30))))
    drawn = near.select(F.xxhash64(F.lit(1), "id", "vec").alias("h"), "vec").orderBy("h").limit(most).toArrow()
    return np.array(drawn.column("vec").to_pylist(), dtype=np.float64)


def _cells(sizes: list[np.ndarray], cell_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per tree and leaf: its first cell and over how many cells it is dealt. Leaves that share a cell
    are neighbours; a leaf dealt to several cells has them alone."""
    out = []
    for size in sizes:
        first, parts, cell, filled = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
        for leaf, rows in enumerate(size):
            n = max(1, -(-int(rows) // cell_rows))
            if filled and (filled + rows > cell_rows or n > 1):
                cell, filled = cell + 1, 0
            first[leaf], parts[leaf] = cell, n
            filled += int(rows)
            if n > 1:
                cell, filled = cell + n, 0
        out.append((first, parts))
    return out


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
            trees: int = 8, leaf_size: int = 32, sample_rows: int = 16_384, search_share: float = 0.8, search_least: int = 4_096,
            cell_rows: int = 32_768, query_rows: int = 32_768, seed: int = 5) -> DataFrame:
    """(query_id, rank, <id>, score): the `k` nearest rows found for every row where `is_query`
    (a condition on the id column) holds."""
    rows, dim = usable_vectors(table, id_col, vec_col)
    id_type, vec_type = (rows.schema[c].dataType.simpleString() for c in ("id", "vec"))
    spark = table.sparkSession
    rows = rows.where(F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0))
    queries = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    counted = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"] if dim else 0
    asked = queries.count() if counted else 0
    if not asked:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, `{id_col}` {id_type}, score double")

    rng = np.random.default_rng(seed)
    sample = bounded_sample(rows, counted, sample_rows)
    forest = [grow_tree(sample, leaf_size, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)

    def leaves(batches):
        for batch in batches:
            X = matrix(batch.column(1), dim)
            of = np.stack([t.leaf_of(X) for t in shared.value], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, of.size + 1, trees, dtype=np.int32)), pa.array(of.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "vec", "leaves"])

    indexed = cut_lineage(rows.mapInArrow(tidy(leaves), f"id {id_type}, vec {vec_type}, leaves array<int>"))
    # the counts of all leaves: as many as the forest has
    counts = indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in counts:
        sizes[r["tree"]][r["leaf"]] = r["count"]
    cells = _cells(sizes, cell_rows)
    plan = spark.sparkContext.broadcast((sizes, cells))
    want = max(search_share * counted, search_least)

    def opened(batches):
        for batch in batches:
            X = matrix(batch.column(1), dim)
            out = []
            for at in range(batch.num_rows):
                for t, found in enumerate(open_leaves(shared.value, plan.value[0], X[at], want)):
                    first, parts = plan.value[1][t]
                    found = np.sort(np.array(found, dtype=np.int32))
                    for cell in np.unique(first[found]):
                        here = found[first[found] == cell]
                        out += [(at, t, cell + p, here) for p in range(int(parts[here].max()))]
                if len(out) >= 2_048 or at == batch.num_rows - 1:
                    take = pa.array([o[0] for o in out], pa.int32())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()),
                        batch.column(0).take(take), batch.column(1).take(take), pa.array([o[3] for o in out], pa.list_(pa.int32()))],
                        names=["tree", "cell", "id", "vec", "leaves"])
                    out = []

    def placed(batches):
        for batch in batches:
            of = batch.column(2).flatten().to_numpy().reshape(-1, trees)
            n = batch.num_rows
            cell = np.empty((n, trees), np.int32)
            for t in range(trees):
                start, parts = plan.value[1][t]
                cell[:, t] = start[of[:, t]] + batch.column(3).to_numpy() % parts[of[:, t]]
            each = pa.array(np.repeat(np.arange(n, dtype=np.int32), trees))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(cell.ravel()), batch.column(0).take(each),
                batch.column(1).take(each), pa.array(of.ravel().astype(np.int32))], names=["tree", "cell", "id", "vec", "leaf"])

    query_blocks = -(-asked // query_rows)
    salt = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))
    right = (indexed.select("id", "vec", "leaves", salt.alias("salt"))
             .mapInArrow(tidy(placed), f"tree int, cell int, id {id_type}, vec {vec_type}, leaf int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    left = queries.mapInArrow(tidy(opened), f"tree int, cell int, id {id_type}, vec {vec_type}, leaves array<int>")
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))

    def compare(queries_here: pa.Table, rows_here: pa.Table) -> pa.Table:
        return _best(queries_here, rows_here, dim, k, id_col)

    found = (left.groupBy("tree", "cell", "block").cogroup(right.groupBy("tree", "cell", "block"))
             .applyInArrow(compare, f"query_id {id_type}, `{id_col}` {id_type}, score double"))
    best = found.groupBy("query_id", id_col).agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", id_col))
    return best.select("query_id", rank.alias("rank"), id_col, "score").where(F.col("rank") <= k)


def _best(queries: pa.Table, rows: pa.Table, dim: int, k: int, id_col: str) -> pa.Table:
    """For each query the `k` nearest, by distance and id, of the rows in leaves it opened."""
    out: list[tuple] = []
    if queries.num_rows and rows.num_rows:
        leaf = rows.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf = leaf[order]
        X = matrix(rows.column("vec").combine_chunks(), dim)[order]
        ids, asked = rows.column("id").take(pa.array(order)), queries.column("id")
        own_key, row_key = _keys(asked, ids)
        repeated = len(np.unique(row_key)) < len(row_key)  # rows that share an id count once
        norms = np.einsum("ij,ij->i", X, X)
        Q, opened = matrix(queries.column("vec").combine_chunks(), dim), queries.column("leaves").to_pylist()
        by_leaf = np.argsort([o[0] for o in opened], kind="stable")  # alike queries open the same leaves
        known, start = np.unique(leaf, return_index=True)
        counts = np.diff([*start, len(leaf)])
        for at in range(0, len(Q), QUERY_BLOCK):
            some = by_leaf[at:at + QUERY_BLOCK]
            open_here = np.zeros((len(some), len(known)), bool)
            for i, q in enumerate(some):
                open_here[i] = np.isin(known, opened[q], assume_unique=True)
            used = np.repeat(open_here.any(axis=0), counts)
            cols = np.flatnonzero(used)
            if not cols.size:
                continue
            seen = np.repeat(open_here, counts, axis=1)[:, cols]
            near = norms[cols] - 2 * (Q[some] @ X[cols].T)
            near[~seen | (own_key[some][:, None] == row_key[cols][None, :])] = np.inf
            for i, q in enumerate(some):
                line = near[i]
                if len(line) > k:
                    last = _kth(line, row_key[cols], k, repeated)
                    # the quick formula rounds; keep all that might be among the nearest
                    slack = 1e-12 * (abs(last) + 4 * (Q[q] @ Q[q]) + 1e-300) if np.isfinite(last) else 0
                    line = np.where(line <= last + slack, line, np.inf)
                pick = cols[np.isfinite(line)]
                d = X[pick] - Q[q]
                score = np.sqrt((d * d).sum(axis=1))
                if len(pick) > k:  # ties with the last go by id
                    keep = score <= _kth(score, row_key[pick], k, repeated)
                    pick, score = _least_ids(ids, pick[keep], score[keep], k)
                out.append((np.full(len(pick), q), pick, score))
    if not out:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ids, asked = rows.column("id").slice(0, 0), queries.column("id").slice(0, 0)
    q, row, score = (np.concatenate(x) for x in zip(*out))
    return pa.table([asked.take(pa.array(q)), ids.take(pa.array(row)), pa.array(score)], names=["query_id", id_col, "score"])


def _keys(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the ids are."""
    joined = pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode()
    codes = (joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined).indices.to_numpy()
    return codes[:len(a)], codes[len(a):]


def _kth(values: np.ndarray, keys: np.ndarray, k: int, repeated: bool) -> float:
    """The k-th least of the values, or of each key's least value where keys repeat."""
    if repeated:
        least = np.full(int(keys.max()) + 1, np.inf)
        np.minimum.at(least, keys, values)
        values = least
    return np.partition(values, k - 1)[k - 1] if len(values) >= k else np.inf


def _least_ids(ids: pa.ChunkedArray, pick: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` first by (score, id), each id once."""
    here = pa.table([pa.array(score), ids.take(pa.array(pick)), pa.array(pick)], names=["score", "id", "pick"])
    here = here.sort_by([("score", "ascending"), ("id", "ascending")])
    codes = here.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.sort(np.unique(codes, return_index=True)[1])[:k]
    return here.column("pick").to_numpy()[first], here.column("score").to_numpy()[first]


def op12_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
