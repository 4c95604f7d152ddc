"""Collocations from FM-indexes against counting by definition."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shroud.llm import collocations as co

ROWS = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small inputs: most of the time would go into empty partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def brute(docs, min_count=100, longest=5, top=2000):
    grams, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                grams.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang in n:
        f = {g[1:]: c for g, c in grams.items() if g[0] == lang and c >= min_count}
        held = {(p, c) for g, c in f.items() for i in range(len(g)) for j in range(i + 1, len(g) + 1) if len(p := g[i:j]) < len(g)}
        rows = []
        for g, a in f.items():
            if len(g) > 1 and (g, a) not in held:
                score, k = min((1000 * a * n[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ROWS) for r in df.collect())


def docs_frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2, 3) for i, (lang, t) in enumerate(docs)],
                                 "doc_id bigint, text string, lang string, phrase string, a bigint, score string, rank int, n bigint")


def noise(seed, size):
    r = random.Random(seed)
    return "".join(r.choice("aBcdé日🙂Z") + r.choice([" "] * 8 + ["  ", "\t", ".", ", ", "\n", "\r\n", "!", ""]) for _ in range(size))


@pytest.mark.parametrize("shard_words, filter_bits", [(1_000_000, 1 << 28), (37, 1 << 15), (7, 1 << 16)])
def test_equals_counting(spark, shard_words, filter_bits):
    docs = [("en", noise(1, 4000)), ("de", noise(2, 3000)), (None, noise(3, 2000)), ("en", None), ("fr", ""), ("en", "A a a a a a a a a a " * 30),
            ("de", "ß z " * 200), ("en", " . , ;\n"), ("en", noise(1, 4000))]
    got = rows(co.collocations(docs_frame(spark, docs), min_count=5, shard_words=shard_words, filter_bits=filter_bits))
    assert got == brute(docs, min_count=5) and len(got) > 50


def test_sums_across_shards_and_languages(spark):
    many = [(f"l{i % 40}", "one two three four five six. " * (i % 3 + 1)) for i in range(200)]
    got = rows(co.collocations(docs_frame(spark, many).repartition(7), min_count=4, top=3, shard_words=50))
    assert got == brute(many, min_count=4, top=3)


def test_neighbours_and_other_lengths(spark):
    docs = [("en", "x a b y. a b. x a b, a b y")] * 3
    got = co.collocations(docs_frame(spark, docs), min_count=3, longest=2).where("phrase = 'a b'").first()
    assert (got["a"], got["left_neighbours"], got["right_neighbours"]) == (12, 6, 6)
    assert rows(co.collocations(docs_frame(spark, docs), min_count=3, longest=3)) == brute(docs, min_count=3, longest=3)


def test_empty_and_odd_tables(spark, odd_docs, no_docs):
    assert rows(co.collocations(no_docs)) == []
    assert rows(co.collocations(docs_frame(spark, [(None, None), ("en", ""), ("en", "...")]), min_count=1)) == []
    got = rows(co.collocations(odd_docs, min_count=2))
    assert got == brute([(r["lang"], r["text"]) for r in odd_docs.collect()], min_count=2) and got


def test_products_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", "a", 1, 4 * 10**11, 0, 0), ("en", "b", 1, 3 * 10**11, 0, 0), ("en", "a b", 2, 2 * 10**11, 0, 0)],
                                     "lang string, phrase string, words int, a bigint, left bigint, right bigint")
    totals = spark.createDataFrame([("en", 9 * 10**12)], "lang string, n bigint")
    assert co.score_phrases(frequent, totals, 10).first()["score"] == 1000 * 2 * 10**11 * 9 * 10**12 // (12 * 10**22)


def test_index_intervals():
    """Counts from interval extension equal those of the text, in both transforms."""
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(0, 5, size=400), [0]]).astype(np.int32)
    index = co.FmIndex(co.transform(ids), co.transform(np.concatenate([ids[:-1][::-1], ids[-1:]])), 5)
    level = index.single_words()
    for m in range(1, 6):
        if m > 1:
            level = index.extend_left(level)
        want = Counter(tuple(ids[i:i + m]) for i in range(len(ids) - m + 1) if (ids[i:i + m] > 0).all())
        got = dict(zip(map(tuple, level["ids"].tolist()), level["count"].tolist()))
        assert got == want
        left, right = index.neighbours(level)
        before = Counter(tuple(ids[i:i + m]) for i in range(1, len(ids) - m + 1) if (ids[i - 1:i + m] > 0).all())
        after = Counter(tuple(ids[i:i + m]) for i in range(len(ids) - m) if (ids[i:i + m + 1] > 0).all())
        assert all(before[tuple(p)] == b and after[tuple(p)] == a for p, b, a in zip(level["ids"].tolist(), left, right))


def test_levels_in_portions(monkeypatch):
    """No more than PORTION occurrences and those of one phrase are extended at once, however many phrases pass."""
    r = np.random.default_rng(2)
    words = 300
    ids = np.concatenate([r.integers(0, words + 1, size=6000), [0]]).astype(np.int32)
    monkeypatch.setattr(co, "PORTION", 500, raising=False)
    extended, extend = [], co.FmIndex.extend_left
    monkeypatch.setattr(co.FmIndex, "extend_left", lambda self, level: extended.append(level["count"]) or extend(self, level))
    shard = co.Shard("en", [f"w{i}" for i in range(words)], co.transform(ids).tobytes(), co.transform(np.concatenate([ids[:-1][::-1], ids[-1:]])).tobytes())
    got = Counter()
    for m, level, hashes in shard.levels([], 4):
        assert len(hashes) == len(level["count"])
        got.update(dict(zip(map(tuple, level["ids"].tolist()), level["count"].tolist())))
    assert got == Counter(tuple(ids[i:i + m].tolist()) for m in range(1, 5) for i in range(len(ids) - m + 1) if (ids[i:i + m] > 0).all())
    assert len(extended) > 12 and all(c.sum() < 500 + c[-1] for c in extended)


def test_one_shard_at_a_time(spark, tmp_path, monkeypatch):
    """Shards that lie in one file reach Python in batches of few bytes, from pages and row groups of few."""
    monkeypatch.setattr(co, "BATCH_BYTES", 2000, raising=False)
    monkeypatch.setattr(co, "INDEX_FILES", {**getattr(co, "INDEX_FILES", {}), "parquet.block.size": "4096"}, raising=False)
    sizes, frequent = [], co.frequent_phrases

    def seen(index, min_count, longest, filter_bits, save):
        def rows_of_batches(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], names=["n"])

        sizes.extend(x["n"] for x in save("seen", index.select("words", "bwt").mapInArrow(rows_of_batches, "n int")).collect())
        return frequent(index, min_count, longest, filter_bits, save)

    monkeypatch.setattr(co, "frequent_phrases", seen)
    keys = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(k, None) for k in keys]
    docs = [("en", noise(i, 400)) for i in range(40)]
    got = rows(co.collocations(docs_frame(spark, docs).coalesce(1), min_count=5, shard_words=300, folder=str(tmp_path / "index")))
    assert got == brute(docs, min_count=5) and len(got) > 50
    assert sum(sizes) > 20 and max(sizes) <= 2
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "index" / "index").glob("*.parquet")]
    assert max(m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)) <= 4
    assert [spark.conf.get(k, None) for k in keys] == before


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = co.op11_collocations(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(co.OP11_SQL).fetchall())
