"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles are `n` consecutive words (white space apart, as written); texts with fewer words are one
shingle. A shingle weighs 1 + ln(occurrences). ProbMinHash: each shingle is a Poisson process whose
rate is its weight and whose random numbers follow from its hash; every point falls on one of the
registers, each register keeps the earliest point, and a shingle stops once its next point is later
than all registers, so most shingles end after a few points. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles.

Registers are banded (`rows` to a band); texts that share a band hash are candidates, and a pair is
a link if its exact probability Jaccard or plain Jaccard similarity is `threshold` or more. Repeated
lines push the two measures apart, so a text with repeated shingles has a second signature, in which
every shingle weighs 1; texts without have one that serves as both. With 25 bands of 5 rows a pair at
0.8 by either measure is a candidate with probability 0.99995.

Texts with the same words are one node from the start, so copies never meet as pairs. Within a
bucket each node is first compared with the bucket's least node only. Then components are formed;
in buckets that still hold several, all pairs between different components are looked at (pairs
inside a component could add nothing): finer ProbMinHash sketches of `fine` one-byte registers, one
for each measure, pass the pairs that could reach the threshold by either (4.5 standard errors under
it), and these are verified. The buckets are dealt out in cells of two blocks of bounded size, so a bucket of any size
is many small tasks and only passing pairs are ever rows. So no bucket is capped, no link between
classes is lost, and a family of near copies costs one comparison a bucket and member.

Everything about a corpus stays in tables: narrow signatures and the texts of candidate nodes are
checkpointed in the shared folder.

Defined cases: null text = empty; texts without words are one class; texts with the same words are
one class whatever their white space; repeated rows and ids get their text's class; a null id is
larger than any; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table
from .common import WS_RUN, let, text_or_empty, tidy
from .components import components

GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def _mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _draw(seed: np.ndarray, k: int) -> np.ndarray:
    """The k-th random number of each seed."""
    return _mix(seed + np.uint64((k + 1) * GOLDEN & MASK))


def shingles(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts given as word hashes and offsets: (text number, hash, count),
    by text and hash."""
    words, sizes = words.view(np.uint64), np.diff(starts)
    texts = np.repeat(np.arange(len(sizes)), np.maximum(sizes - n + 1, 0))
    first = np.arange(len(words))
    whole = first + n <= np.repeat(starts[1:], sizes) if len(words) else np.zeros(0, bool)
    first = first[whole]
    h = np.full(len(first), n, np.uint64)
    for i in range(n):
        h = _mix(h * np.uint64(GOLDEN) + words[first + i])
    for t in np.nonzero((sizes > 0) & (sizes < n))[0]:
        one = np.array([sizes[t]], np.uint64)
        for w in words[starts[t]:starts[t + 1]]:
            one = _mix(one * np.uint64(GOLDEN) + w)
        texts, h = np.append(texts, t), np.append(h, one)
    order = np.lexsort((h, texts))
    texts, h = texts[order], h[order]
    new = np.append(True, (texts[1:] != texts[:-1]) | (h[1:] != h[:-1]))[:len(h)]
    at = np.nonzero(new)[0]
    return texts[at], h[at], np.diff(np.append(at, len(h)))


def probminhash(texts: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """The shingle that holds each register of each text, (n_texts, registers)."""
    earliest = np.full(n_texts * registers, np.inf)
    holder = np.zeros(n_texts * registers, np.uint64)
    rate, time, k = 1 + np.log(counts), np.zeros(len(hashes)), 0
    while len(hashes):
        u = ((_draw(hashes, 2 * k) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        time = time - np.log(u) / rate
        at = texts * registers + (_draw(hashes, 2 * k + 1) % np.uint64(registers)).astype(np.int64)
        better = np.nonzero(time < earliest[at])[0]
        better = better[np.argsort(-time[better], kind="stable")]  # of several on one register the earliest is written last
        earliest[at[better]] = time[better]
        holder[at[better]] = hashes[better]
        go_on = time < earliest.reshape(n_texts, registers).max(axis=1)[texts]
        texts, hashes, rate, time, k = texts[go_on], hashes[go_on], rate[go_on], time[go_on], k + 1
    return holder.reshape(n_texts, registers)


def both_measures(texts: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weighted signatures, which texts have repeated shingles, and these texts' unweighted ones."""
    repeats = np.bincount(texts[counts > 1], minlength=n_texts) > 0
    of = repeats[texts]
    plain = probminhash((np.cumsum(repeats) - 1)[texts[of]], hashes[of], np.ones(int(of.sum())), int(repeats.sum()), registers)
    return probminhash(texts, hashes, counts, n_texts, registers), repeats, plain


def band_hashes(holder: np.ndarray, rows: int) -> np.ndarray:
    """One hash a band, different between bands, (n_texts, bands)."""
    bands = holder.shape[1] // rows
    parts = holder[:, :bands * rows].reshape(len(holder), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        h = _mix(h * np.uint64(GOLDEN) + parts[:, :, i])
    return h


def similarity(a: tuple, b: tuple, enough: float) -> float:
    """The larger of plain and probability Jaccard of two weighted sets (sorted hashes, counts); the
    latter only where the former is under `enough`."""
    (ha, ca), (hb, cb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    plain = len(common) / max(1, len(ha) + len(hb) - len(common))
    if plain >= enough or not len(common) or (ca.max() == 1 and cb.max() == 1):
        return plain
    va, vb = 1 + np.log(ca), 1 + np.log(cb)
    x, y = va[ia], vb[ib]  # of the common shingles; the others have ratio infinity or 0
    order = np.argsort(-(x / y), kind="stable")
    x, y, ratio = x[order], y[order], (x / y)[order]
    only_a, only_b = va.sum() - x.sum(), vb.sum() - y.sum()
    upto = np.searchsorted(-ratio, -ratio, side="right")  # how many have this ratio or more
    above = only_a + np.concatenate([[0], np.cumsum(x)])[upto]
    below = only_b + y.sum() - np.concatenate([[0], np.cumsum(y)])[upto]
    return max(plain, float((1 / (above / x + below / y)).sum()))


def _arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of an Arrow list column."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy()[starts[0]:starts[-1]], (starts - starts[0]).astype(np.int64)


def _chunk_end(starts: np.ndarray, a: int, words: int, texts: int = 2000) -> int:
    """Where the chunk of texts from a on ends that has about so many words and at most so many texts."""
    return min(len(starts) - 1, a + texts, max(a + 1, int(np.searchsorted(starts, starts[a] + words, side="right")) - 1))


def _words(text):
    return F.array_remove(F.split(text, WS_RUN, -1), "")


def word_hashes(text):
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, chunk_words: int = 200_000) -> DataFrame:
    """One narrow row per input row: id, text_hash, node (128-bit hash of the words), bands (the
    weighted ones, then, if shingles repeat, the unweighted ones)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = text_or_empty(text_col)
    sent = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
                       let(_words(text), lambda w: F.struct(F.unhex(F.md5(F.array_join(w, " "))).alias("node"), F.transform(w, lambda x: F.xxhash64(x)).alias("words"))).alias("_s")
                       ).select("id", "text_hash", "_s.node", "_s.words")

    def run(batches):
        for batch in batches:
            values, starts = _arrays(batch.column(3))
            out, a = [], 0
            while a < batch.num_rows:
                b = _chunk_end(starts, a, chunk_words)
                t, h, c = shingles(values[starts[a]:starts[b]], starts[a:b + 1] - starts[a], n)
                some = np.bincount(t, minlength=b - a) > 0
                at = np.cumsum(some) - 1  # texts without words get no registers
                weighted, repeats, plain = both_measures(at[t], h, c, int(some.sum()), bands * rows)
                sets = np.zeros(b - a, np.int64)
                sets[some] = 1 + repeats
                of = np.concatenate([np.arange(len(repeats)), np.nonzero(repeats)[0]])
                hashes = np.concatenate([band_hashes(weighted, rows), band_hashes(plain, rows)])
                out.append((sets, hashes[np.argsort(of, kind="stable")]))
                a = b
            sets = np.concatenate([s for s, _ in out]) if out else np.zeros(0, np.int64)
            flat = np.concatenate([h.ravel() for _, h in out]) if out else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum(sets * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                                             names=["id", "text_hash", "node", "bands"])

    return sent.mapInArrow(tidy(run), f"id {kind}, text_hash bigint, node binary, bands array<bigint>")


def sketches(texts: DataFrame, n: int, registers: int, chunk_words: int = 100_000) -> DataFrame:
    """(node, sketch): the low byte of each register's holder, weighted, then, if shingles repeat,
    unweighted."""
    sent = texts.select("node", word_hashes("text").alias("words"))

    def run(batches):
        for batch in batches:
            values, starts = _arrays(batch.column(1))
            out, a = [], 0
            while a < batch.num_rows:
                b = _chunk_end(starts, a, chunk_words)
                t, h, c = shingles(values[starts[a]:starts[b]], starts[a:b + 1] - starts[a], n)
                weighted, repeats, plain = both_measures(t, h, c, b - a, registers)
                low = [(x & np.uint64(255)).astype(np.uint8) for x in (weighted, plain)]
                second = np.cumsum(repeats) - 1
                out += [low[0][i].tobytes() + (low[1][second[i]].tobytes() if repeats[i] else b"") for i in range(b - a)]
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "sketch"])

    return sent.mapInArrow(tidy(run), "node binary, sketch binary")


def _cell_pairs(rows: list[tuple], least: int, registers: int, n_bands: int) -> list[tuple[bytes, bytes]]:
    """Of one cell's rows (block, k, node, root, bands, sketch) the pairs between its two blocks (or in
    its one block) that have different roots, share no band before the cell's and agree in `least`
    registers of the weighted or of the unweighted sketch."""
    block = np.array([r[0] for r in rows])
    k = rows[0][1]
    _, root = np.unique(np.array([r[3] for r in rows], dtype=object), return_inverse=True)
    repeats = any(len(r[4]) > n_bands for r in rows)
    twice = lambda x, n: (x if len(x) > n else x + x) if repeats else x  # noqa: E731 - one set serves as both
    bands = np.array([twice(r[4], n_bands) for r in rows], dtype=np.int64).reshape(len(rows), -1, n_bands)[:, :, :k]
    sketch = np.frombuffer(b"".join(twice(r[5], registers) for r in rows), np.uint8).reshape(len(rows), -1, registers)
    measures = range(sketch.shape[1])
    one, out = block.min() == block.max(), []
    for i in np.nonzero(block == block.min())[0]:
        others = np.arange(i + 1, len(rows)) if one else np.nonzero(block != block[i])[0]
        others = others[root[others] != root[i]]
        for x in measures:
            for y in measures:
                others = others[(bands[others, x] != bands[i, y]).all(axis=1)]
        agree = [(sketch[others, x] == sketch[i, x]).sum(axis=1) >= least for x in measures]
        out += [(rows[i][2], rows[j][2]) for j in others[np.logical_or.reduce(agree)]]
    return out


def open_pairs(rooted: DataFrame, fine: DataFrame, threshold: float, registers: int, n_bands: int, block_rows: int = 512) -> DataFrame:
    """The pairs (a, b) of nodes with different roots that share a bucket and whose sketches could
    reach the threshold by one of the measures. rooted: bucket, k (its band), node, root; fine: node, bands, sketch."""
    mixed = (rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where("lo <> hi").select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    rows = rooted.join(mixed, "bucket").join(fine, "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))).alias("cell")
    dealt = (rows.select("bucket", cell, "block", "k", "node", "root", "bands", "sketch")
             .select("bucket", "cell.i", "cell.j", "block", "k", "node", "root", "bands", "sketch")
             .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
    least = int(registers * (threshold - 4.5 * (threshold * (1 - threshold) / registers) ** 0.5))

    def run(batches):
        now, rows = None, []

        def done():
            pairs = _cell_pairs(rows, least, registers, n_bands) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], names=["a", "b"])

        for batch in batches:
            for bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, i, j) != now:
                    if rows:
                        yield done()
                    now, rows = (bucket, i, j), []
                rows.append(row)
        if rows:
            yield done()

    return dealt.mapInArrow(tidy(run), "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", word_hashes("text_a").alias("words_a"), word_hashes("text_b").alias("words_b"))

    def weighted(values, starts, i):
        _, h, c = shingles(values[starts[i]:starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]), n)
        return h, c

    def run(batches):
        last, known = None, None  # pairs come sorted by b: its set is kept from row to row
        for batch in batches:
            va, sa = _arrays(batch.column(2))
            vb, sb = _arrays(batch.column(3))
            keep = []
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py()
                if b != last:
                    last, known = b, weighted(vb, sb, i)
                keep.append(similarity(weighted(va, sa, i), known, threshold) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
            bands: int = 25, rows: int = 5, fine: int = 1000) -> DataFrame:
    """One row per input row: id, text_hash, class_id (the least id of its class), kept (the row that
    stays: least id, then least text hash), class_size."""
    signed = cut_lineage(signatures(docs, id_col, text_col, n, bands, rows))
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    members = (nodes.select("node", "bands", F.posexplode("bands").alias("at", "bucket"))  # of two equal bands of a text one
               .where((F.col("at") < bands) | (F.col("bucket") != F.get("bands", F.col("at") - bands)))
               .select("node", F.pmod("at", F.lit(bands)).alias("k"), "bucket"))
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub")
    shared = cut_lineage(members.join(hubs, "bucket"))  # rows of nodes that share a bucket
    asked = shared.select("node").distinct()
    texts = cut_lineage(docs.select(F.unhex(F.md5(F.array_join(_words(text_or_empty(text_col)), " "))).alias("node"), F.col(text_col).alias("text"))
                        .groupBy("node").agg(F.first("text").alias("text")).join(asked, "node", "left_semi"))
    tried = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut_lineage(verified(tried, texts, n, threshold))
    roots = cut_lineage(components(links))

    # pairs between components that share a bucket
    rooted = cut_lineage(shared.join(roots, "node", "left").select("bucket", "k", "node", F.coalesce("root", "node").alias("root")))
    unsettled = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    doubtful = rooted.join(unsettled.select("bucket"), "bucket", "left_semi").select("node").distinct()
    sketched = sketches(texts.join(doubtful, "node", "left_semi"), n, fine).join(nodes, "node")
    rest = cut_lineage(open_pairs(rooted, sketched, threshold, fine, bands).distinct())
    more = cut_lineage(verified(rest, texts, n, threshold))
    if not more.isEmpty():
        merged = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
            roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        joined = components(merged.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        all_nodes = roots.union(merged.select(F.explode(F.array("a", "b")).alias("node"), F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        roots = cut_lineage(all_nodes.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
                            .select("node", F.coalesce("top", "root").alias("root")))

    named = signed.select("id", "text_hash", "node").join(roots, "node", "left").select("id", "text_hash", F.coalesce("root", "node").alias("root"))
    named = cut_lineage(named.withColumn("row", F.monotonically_increasing_id()))  # tells rows that repeat apart
    first = cut_lineage(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "row")).alias("first"),
                                                  F.count(F.lit(1)).alias("class_size")))  # so that a large class's join can be split
    return named.join(first, "root").select(
        F.col("id").alias(id_col), "text_hash", F.col("first.id").alias("class_id"), "class_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("as_kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows, all of their columns, of which one of each class stays. Of rows that repeat the
    id and text of the one that stays, any one does."""
    found = classes(docs, id_col, text_col, **options).select(F.col(id_col).alias("_id"), "text_hash", "kept", "as_kept")
    gone = found.where("not as_kept").select("_id", "text_hash").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_row_id"),
                       F.xxhash64(text_or_empty(text_col)).alias("_here"))

    def on(other):
        return rows["_row_id"].eqNullSafe(other["_id"]) & (rows["_here"] == other["text_hash"])
    rows = rows.join(gone, on(gone), "left_anti")
    again = found.where("as_kept and not kept").select("_id", "text_hash").distinct()
    if again.isEmpty():
        return rows.select("_row.*")
    repeated = rows.join(again, on(again), "left_semi").groupBy("_row_id", "_here").agg(F.first("_row").alias("_row"))
    return rows.join(again, on(again), "left_anti").select("_row.*").union(repeated.select("_row.*"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
