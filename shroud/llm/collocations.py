"""Phrase collocations from FM-indexes: one per shard of words, their counts summed across shards.

A shard holds up to `shard_words` words of one language as local word ids, pieces divided by a mark
that no phrase crosses. Its FM-index is the Burrows-Wheeler transform (BWT) of that sequence and of its
reverse, sorted by the first eight ids, which is as deep as phrases of five words need. A phrase is a pair of
intervals, one in each transform. Extending it to the left by a word c maps the interval [lo, hi) to
the occurrences of c in bwt[lo:hi), carried on by the last-to-first map; the interval in the reverse
transform moves by the number of smaller symbols. All phrases of one length are extended together, as
arrays of bounded size: a portion of a level is carried on to its longest phrases before the next
portion begins. An interval's width is the phrase's count; the words (not marks) in bwt[lo:hi) and in its
reverse interval are its occurrences with a left and with a right neighbour.

Counting is exact and needs no list of words or phrases on the driver. Levels go upwards: a phrase of
m words is counted only if its two parts of m - 1 words are frequent in all shards together. For
two and three words, shards send (64-bit hash, count); hashes whose sum is `min_count` or more set bits in a
filter of bounded size (at most `filter_bits`), which goes out to the next level. Equal hashes and
equal bits of different phrases only let more through (so does a filter that grows full on larger
data): the last pass sends the phrases themselves, and their sums alone decide.

Index shards are Parquet files in the shared folder (about eight bytes a word); every pass is a narrow scan
of them and one aggregation that combines before the shuffle. A task holds one shard at a time, in its
reader, on the way to Python (where Spark would gather 64 MB of them) and there. A text that fills a shard goes on in the
next one, where its last four words are repeated; the repeats are indexed once more with sign -1, so
every occurrence counts once.

Defined cases: null text = empty; null language = `und`; a piece or text without words adds nothing;
repeated rows and null ids count as often as they stand; an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import read_table
from .common import each, text_or_empty, tidy

#: On UTF-8 bytes: A-Z to a-z, every character that ends a piece to a line feed, tab to blank.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
TEXT_STRETCH = 1 << 20  # most bytes of a text split into words at once
MARK = 0  # the local id that divides pieces; words have ids from 1
ROWS_OUT = 32_768  # rows of a batch given back
PAGE_BITS = 1 << 15  # bits of a filter gathered as one row
PORTION = 1 << 16  # occurrences extended at once, and those of one phrase more
BATCH_BYTES = 1 << 20  # of texts or shards sent to Python at once, and one of them more
TEXTS_READ = 256  # texts that a reader holds at once
#: A page a shard, so that one can be read without the others; row groups are cut by size after every row, not every hundred.
INDEX_FILES = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(64 << 20)}
SHARD_SCHEMA = "lang string, sign int, tokens bigint, words array<string>, counts array<bigint>, bwt binary, back_bwt binary"


# ---------------------------------------------------------------- index of one shard

def stable_order(key: np.ndarray) -> np.ndarray:
    """The stable sorting order of non-negative numbers; their places are sorted along with them in
    one number where both fit, which is several times faster than sorting places by key."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits <= 63:
        both = key.astype(np.int64)
        both <<= bits
        both |= np.arange(len(key))
        both.sort()
        both &= (1 << bits) - 1
        return both
    return np.argsort(key, kind="stable")


def transform(ids: np.ndarray) -> np.ndarray:
    """The BWT of a sequence that ends with a mark, its suffixes sorted by their first eight ids."""
    rank = ids.astype(np.int64)
    n = len(ids)
    for span in (1, 2, 4):
        key = rank * (int(rank.max()) + 2)
        key[:max(n - span, 0)] += rank[span:] + 1
        order = stable_order(key)
        if span < 4:
            key = key[order]
            fresh = key[1:] != key[:-1]
            key[0] = 0
            np.cumsum(fresh, out=key[1:])
            rank[order] = key
    order -= 1
    return ids[order]


class FmIndex:
    """Both transforms of one shard, and the intervals of its single words."""

    def __init__(self, bwt: np.ndarray, back_bwt: np.ndarray, symbols: int):
        self.bwt, self.back_bwt = bwt, back_bwt
        self.last_to_first = np.empty(len(bwt), np.int32)
        self.last_to_first[stable_order(bwt)] = np.arange(len(bwt), dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=symbols))])
        self.words_before: tuple[np.ndarray, np.ndarray] | None = None

    def single_words(self) -> dict[str, np.ndarray]:
        lo, hi = self.starts[1:-1], self.starts[2:]
        ids = np.arange(1, len(self.starts) - 1, dtype=np.int32)[:, None]
        return {"lo": lo, "back": lo.copy(), "count": hi - lo, "ids": ids}

    def extend_left(self, level: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """All phrases that are one word longer to the left."""
        lo, count = level["lo"], level["count"]
        of = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + lo[of]
        key = of * len(self.starts) + self.bwt[at]
        order = stable_order(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(key)]]))
        of, symbol = key[first] // len(self.starts), key[first] % len(self.starts)
        smaller = first - np.concatenate([[0], np.cumsum(count)])[of]  # symbols below this one, in its interval
        word = symbol != MARK
        return {"lo": self.last_to_first[at[order[first]]][word], "back": (level["back"][of] + smaller)[word], "count": size[word],
                "ids": np.column_stack([symbol[word].astype(np.int32), level["ids"][of[word]]])}

    def neighbours(self, level: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences with a word to the left, and with one to the right, in their piece."""
        if self.words_before is None:  # once a shard
            self.words_before = tuple(np.concatenate([np.zeros(1, np.int32), np.cumsum(x != MARK, dtype=np.int32)]) for x in (self.bwt, self.back_bwt))

        def words(before, lo):
            return before[lo + level["count"]].astype(np.int64) - before[lo]

        return words(self.words_before[0], level["lo"]), words(self.words_before[1], level["back"])


def phrase_hashes(word_hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of word ids, from the words' own hashes; alike in all shards."""
    h = np.full(len(ids), np.uint64(0x9E3779B97F4A7C15) + np.uint64(ids.shape[1]), np.uint64)
    for column in ids.T:
        h = (h ^ word_hashes[column]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


class Shard:
    """One row of the index table, ready to be searched."""

    def __init__(self, lang: str, words: list[str], bwt: pa.Buffer, back_bwt: pa.Buffer | None):
        self.words = [None, *words]
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hashes = np.array([0, *(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words)], np.uint64)
        self.index = FmIndex(np.frombuffer(bwt, "<i4"), np.frombuffer(b"" if back_bwt is None else back_bwt, "<i4"), len(self.words))

    def levels(self, filters: list[np.ndarray], deepest: int):
        """(length, phrases, hashes), portion by portion; a phrase goes on if all its parts pass `filters`
        (by length, from 1). Lengths without a filter are given whole."""
        return self._carried_on(self.index.single_words(), 1, filters, deepest)

    def _carried_on(self, level: dict[str, np.ndarray], m: int, filters: list[np.ndarray], deepest: int):
        if part := min(m - 1, len(filters)):  # its last words passed before; the first ones too?
            level = _rows(level, passing(filters[part - 1], phrase_hashes(self.hashes, level["ids"][:, :part])))
        hashes = phrase_hashes(self.hashes, level["ids"])
        if m - 1 < len(filters):
            keep = passing(filters[m - 1], hashes)
            level, hashes = _rows(level, keep), hashes[keep]
        yield m, level, hashes
        if m < deepest:
            del hashes
            for some in portions(level):
                yield from self._carried_on(self.index.extend_left(some), m + 1, filters, deepest)


def portions(level: dict[str, np.ndarray]):
    """The phrases of a level in stretches of at most PORTION occurrences and those of one phrase more."""
    ends = np.cumsum(level["count"])
    at = 0
    while at < len(ends):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION)) + 1
        yield _rows(level, slice(at, end))
        at = end


def _rows(level: dict[str, np.ndarray], keep: np.ndarray | slice) -> dict[str, np.ndarray]:
    return {k: v[keep] for k, v in level.items()}


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


# ---------------------------------------------------------------- jobs

@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings for the jobs run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


class _Ids(dict):
    """Word -> local id, given at first sight; the mark is 0, the empty string between two blanks -1."""

    def __init__(self):
        super().__init__({b"\n": MARK, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


class _Builder:
    """Gathers the words of a task's texts by language and gives a shard when one is full."""

    def __init__(self, shard_words: int, longest: int):
        self.shard_words, self.overlap = shard_words, longest - 1
        self.stretch = min(TEXT_STRETCH, 8 * shard_words)
        self.open: dict[tuple[str, int], tuple[_Ids, list[np.ndarray]]] = {}
        self.sizes: dict[tuple[str, int], int] = {}

    def add(self, lang: str, text: bytes):
        """The shards that fill up while a text is added: words divided by blanks, pieces by line feeds."""
        start = 0
        while start < len(text):  # a stretch at a time: few words at once are Python objects
            end = len(text) if (cut := text.find(b" ", start + self.stretch)) < 0 else cut
            known, parts = self.open.setdefault((lang, 1), (_Ids(), []))
            ids = np.fromiter(map(known.__getitem__, text[start:end].replace(b"\n", b" \n ").split(b" ")), np.int32)
            start = end + 1
            parts.append(ids[ids >= 0])
            self.sizes[lang, 1] = self.sizes.get((lang, 1), 0) + len(parts[-1])
            if start < len(text) and self.sizes[lang, 1] >= self.shard_words:
                # the text goes on in the next shard: repeat the last words there, and take them off again
                words = {i: w for w, i in known.items()}
                again = b" ".join(words[i] for i in np.concatenate(parts)[-self.overlap:].tolist())
                yield self._close((lang, 1))
                for sign in (1, -1):
                    known, parts = self.open.setdefault((lang, sign), (_Ids(), []))
                    parts.append(np.array([known[w] for w in again.split(b" ")], np.int32))
                    if sign < 0:
                        parts.append(np.array([MARK], np.int32))
                    self.sizes[lang, sign] = self.sizes.get((lang, sign), 0) + len(parts[-1])
        if (lang, 1) in self.open:
            self.open[lang, 1][1].append(np.array([MARK], np.int32))
        for key in [(lang, 1), (lang, -1)]:
            if self.sizes.get(key, 0) >= self.shard_words:
                yield self._close(key)
        if sum(self.sizes.values()) >= 2 * self.shard_words:  # many languages at once: the largest goes first
            yield self._close(max(self.sizes, key=self.sizes.get))

    def _close(self, key: tuple[str, int]):
        known, parts = self.open.pop(key)
        del self.sizes[key]
        ids = np.concatenate([*parts, np.array([MARK], np.int32)])
        # marks in a row divide no better than one
        ids = ids[np.concatenate([[ids[0] != MARK], (ids[1:] != MARK) | (ids[:-1] != MARK)])]
        if not len(ids):
            ids = np.array([MARK], np.int32)
        words = [w.decode("utf-8", "surrogatepass") for w in list(known)[2:]]
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        back = np.concatenate([ids[:-1][::-1], ids[-1:]])
        return (key[0], key[1], int(counts.sum()), words, counts.tolist(),
                transform(ids).astype("<i4").tobytes(), transform(back).astype("<i4").tobytes())

    def rest(self):
        for key in list(self.open):
            yield self._close(key)


def index_shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int, longest: int) -> DataFrame:
    """The index table: one row per shard."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       text_or_empty(F.col(f"`{text_col}`")).cast("binary").alias("text"))
    fields = ["lang", "sign", "tokens", "words", "counts", "bwt", "back_bwt"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches):
        def row(shard):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(shard, types)], names=fields)

        builder = _Builder(shard_words, longest)
        for batch in batches:
            for lang, text in zip(each(batch.column(0)), each(batch.column(1))):
                for shard in builder.add(lang, text.translate(FOLD)):
                    yield row(shard)
        for shard in builder.rest():
            yield row(shard)

    return rows.mapInArrow(tidy(run), SHARD_SCHEMA)


def _each_shard(index: DataFrame, work, schema: str, both_ways: bool) -> DataFrame:
    """`work(shard, lang, sign)` gives the columns of a batch, or batches, for every shard; the reverse
    transform is read only if it is used."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                lang, sign, words = (c[at].as_py() for c in batch.columns[:3])
                bwt, *back = (c[at].as_buffer() for c in batch.columns[3:])
                for columns in work(Shard(lang, words, bwt, *(back or [None])), lang, sign):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return index.select("lang", "sign", "words", "bwt", *(["back_bwt"] if both_ways else [])).mapInArrow(tidy(run), schema)


def _hash_counts(index: DataFrame, filters, m: int) -> DataFrame:
    """(hash, count) of all phrases of m words whose parts pass."""
    shared = index.sparkSession.sparkContext.broadcast(filters)

    def work(shard, lang, sign):
        for length, level, hashes in shard.levels(shared.value, m):
            if length == m:
                for at in range(0, len(hashes), ROWS_OUT):
                    yield hashes[at:at + ROWS_OUT].view(np.int64), level["count"][at:at + ROWS_OUT].astype(np.int64) * sign

    return _each_shard(index, work, "hash bigint, count bigint", both_ways=False)


def bounded_filter(hashes: DataFrame, filter_bits: int) -> np.ndarray:
    """A bit for every hash, in a power of two of bits: eight to sixteen a hash, `filter_bits` at most."""
    wanted = hashes.count()
    bits = min(filter_bits, max(PAGE_BITS, 1 << (8 * wanted).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    pages = (hashes.select(F.shiftright(at, 15).alias("page"), at.bitwiseAND(F.lit(PAGE_BITS - 1)).cast("int").alias("bit"))
             .groupBy("page").agg(F.collect_set("bit").alias("bits")))

    def fill(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                page = np.zeros(PAGE_BITS, np.uint8)
                page[batch.column(1)[at].values.to_numpy()] = 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([np.packbits(page, bitorder="little").tobytes()], pa.binary())],
                                                 names=["page", "bytes"])

    out = np.zeros(bits // 8, np.uint8)
    for r in pages.mapInArrow(fill, "page bigint, bytes binary").toLocalIterator():  # filter_bits / 8 bytes at most
        out[r["page"] * PAGE_BITS // 8:(r["page"] + 1) * PAGE_BITS // 8] = np.frombuffer(r["bytes"], np.uint8)
    return out


def frequent_phrases(index: DataFrame, min_count: int, longest: int, filter_bits: int, save) -> DataFrame:
    """(lang, phrase, words, a, left, right) of all phrases of 1 to `longest` words found `min_count`
    times or more (neighbours from two words on); `save` writes a frame and gives it back read again."""
    filters: list[np.ndarray] = []
    word = F.explode(F.arrays_zip("words", "counts")).alias("w")
    single = (index.select("lang", "sign", word)
              .groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum(F.col("w.counts") * F.col("sign")).alias("a"))
              .where(F.col("a") >= min_count))
    single = save("words", single)

    def word_hash(batches):
        for batch in batches:
            seeds: dict = {}
            out = np.empty(batch.num_rows, np.uint64)
            for at, (lang, w) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if lang not in seeds:
                    seeds[lang] = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
                out[at] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seeds[lang])
            ids = np.arange(len(out))[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(out, ids).view(np.int64))], names=["hash"])

    filters.append(bounded_filter(single.select("lang", "phrase").mapInArrow(word_hash, "hash bigint"), filter_bits))
    for m in range(2, min(longest, 4)):  # few phrases of four words are left whose parts are frequent
        sums = _hash_counts(index, list(filters), m).groupBy("hash").agg(F.sum("count").alias("count"))
        hashes = save(f"hashes{m}", sums.where(F.col("count") >= min_count).select("hash"))
        filters.append(bounded_filter(hashes, filter_bits))
    shared = index.sparkSession.sparkContext.broadcast(filters)

    def work(shard, lang, sign):
        for m, level, _ in shard.levels(shared.value, longest):
            if m == 1 or not len(level["count"]):
                continue
            left, right = shard.index.neighbours(level)
            for at in range(0, len(left), ROWS_OUT):
                here = slice(at, at + ROWS_OUT)
                phrase = [" ".join([shard.words[i] for i in ids]) for ids in level["ids"][here].tolist()]
                yield ([lang] * len(phrase), phrase, np.full(len(phrase), m, np.int32), level["count"][here].astype(np.int64) * sign,
                       left[here] * sign, right[here] * sign)

    found = _each_shard(index, work, "lang string, phrase string, words int, a bigint, left bigint, right bigint", both_ways=True)
    sums = found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"), F.sum("left").alias("left"), F.sum("right").alias("right"))
    single = single.select("lang", "phrase", F.lit(1).alias("words"), "a", F.lit(None).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("right"))
    return save("phrases", sums.where(F.col("a") >= min_count)).union(single)


def score_phrases(frequent: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Scores, drops phrases that stand as often in a longer one, and ranks each language's."""
    phrases = frequent.where("words > 1")
    parts = F.split("phrase", " ")

    def span(start, length):
        return F.array_join(F.slice(parts, start, length), " ")

    cuts = phrases.select("lang", "phrase", "words", "a", "left", "right", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", span(F.lit(1), F.col("k")).alias("head"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    known = frequent.select("lang", "phrase", "a")
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
            .join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
            .join(totals, "lang"))  # one row a language
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", (F.col("a") * 1000).cast("decimal(19,0)") * wide("n")).withColumn("bottom", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = (cuts.groupBy("lang", "phrase", "words", "a", "left", "right", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # a longer candidate that holds all occurrences holds them through one that is a single word longer
    longer = phrases.where("words > 2").select("lang", "a", F.explode(F.array(
        span(F.lit(1), F.col("words") - 1), span(F.lit(2), F.col("words") - 1))).alias("phrase")).distinct()
    kept = best.join(longer, ["lang", "phrase", "a"], "left_anti")
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
                       F.col("left").alias("left_neighbours"), F.col("right").alias("right_neighbours"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000,
                 shard_words: int = 1_000_000, filter_bits: int = 1 << 28, folder: str | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, left_neighbours, right_neighbours. `folder` is a new
    shared folder for the index and the sums; by default one under the shared checkpoint folder."""
    if not 2 <= longest <= 8:
        raise ValueError("phrases have 2 to 8 words at most")
    spark = docs.sparkSession
    base = folder or f"{checkpoint_dir(spark)}/collocations-{uuid.uuid4().hex}"

    def save(name: str, frame: DataFrame, rows_read: int = 1, **options: str) -> DataFrame:
        with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(rows_read)}):
            frame.write.options(compression="zstd", **options).parquet(f"{base}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{base}/{name}")

    index = save("index", index_shards(docs, text_col, lang_col, shard_words, longest), rows_read=TEXTS_READ, **INDEX_FILES)
    totals = index.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("sign")).alias("n"))
    frequent = frequent_phrases(index, min_count, longest, filter_bits, save)
    return score_phrases(frequent, totals, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_neighbours", "right_neighbours")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), grams AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m
  FROM starts, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, m, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS tail
  FROM f, (SELECT unnest(range(1, 5)) AS k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, x.a AS l, y.a AS r, t.n,
         (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = b.lang AND g.m = b.m + 1 AND g.a = b.a
      AND (array_to_string(string_split(g.phrase, ' ')[1:g.m - 1], ' ') = b.phrase
           OR array_to_string(string_split(g.phrase, ' ')[2:g.m], ' ') = b.phrase))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
), around AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) FILTER (i > 1) AS left_neighbours,
         count(*) FILTER (i + m - 1 < len(w)) AS right_neighbours
  FROM starts, (SELECT unnest(range(2, 6)) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL
)
SELECT k.lang, k.rank::INT AS rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, k.n::BIGINT AS n, k.score::BIGINT AS score,
       left_neighbours::BIGINT AS left_neighbours, right_neighbours::BIGINT AS right_neighbours
FROM ranked k JOIN around o ON o.lang = k.lang AND o.phrase = k.phrase AND o.m = k.m WHERE rank <= 2000
"""
