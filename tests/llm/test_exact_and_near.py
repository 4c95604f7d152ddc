import collections
import hashlib
import re

import numpy as np
import pytest

from shroud.llm import components, exact_dedup, near_dedup
from shroud.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm.conftest import contract_words


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups_on_odd_rows(odd_docs):
    rows = exact_dedup.assign_groups(odd_docs).collect()
    texts = [(r.doc_id, norm(r.text)) for r in odd_docs.collect()]
    assert len(rows) == len(texts)
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    kept = collections.Counter()
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}  # of rows that repeat the smallest id, too, one stays


def test_exact_keep_first_returns_whole_rows(odd_docs, no_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len({norm(r.text) for r in odd_docs.collect()})
    assert {r.doc_id for r in rows if norm(r.text) == norm("The same text here.")} == {1}
    assert exact_dedup.keep_first(no_docs).count() == 0 and exact_dedup.assign_groups(no_docs).count() == 0


def test_exact_keeps_texts_apart_that_share_a_hash(odd_docs, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(exact_dedup, "content_hash", lambda norm: F.unhex(F.md5(F.lit("one hash for all"))))
    texts = {norm(r.text) for r in odd_docs.collect()}
    assert exact_dedup.keep_first(odd_docs).count() == len(texts)
    assert exact_dedup.assign_groups(odd_docs).where("kept").count() == len(texts)


def probability_jaccard(v, w):
    return sum(1 / sum(max(v.get(e, 0) / v[d], w.get(e, 0) / w[d]) for e in {*v, *w}) for d in v if d in w)


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(3):
        a = {int(k): int(c) for k, c in zip(rng.integers(1, 90, 60), rng.integers(1, 7, 60))}
        b = {int(k): int(c) for k, c in zip(rng.integers(30, 120, 60), rng.integers(1, 7, 60))}
        sets = []
        for x in (a, b):
            h = near_dedup._mix(np.array(sorted(x), np.uint64))
            order = np.argsort(h)
            sets.append((h[order], np.array([x[k] for k in sorted(x)])[order]))
        exact = probability_jaccard(*({k: 1 + np.log(c) for k, c in x.items()} for x in (a, b)))
        signed = [near_dedup.probminhash(np.zeros(len(h), int), h, c, 1, 8000)[0] for h, c in sets]
        assert abs((signed[0] == signed[1]).mean() - exact) < 0.03
        plain = len({*a} & {*b}) / len({*a} | {*b})
        assert near_dedup.similarity(*sets, 2.0) == pytest.approx(max(plain, exact))


def brute_classes(texts, n=5, threshold=0.8):
    words = [tuple(contract_words(t)) for t in texts]
    sets = [frozenset(w[i:i + n] for i in range(len(w) - n + 1)) or frozenset([w]) for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in holders[g])
        for j, k in common.items():
            if k / (len(s) + len(sets[j]) - k) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return [find(i) for i in range(len(texts))]


def test_near_classes_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    roots = brute_classes([t for _, t in docs])
    rows = {r.doc_id: r for r in near_dedup.op2_near_dedup(spark, SF_SMALL).collect()}
    assert len(rows) == len(docs)
    for k, (i, _) in enumerate(docs):
        assert rows[i].class_id == docs[roots[k]][0]
        assert rows[i].kept == (rows[i].class_id == i)


def test_near_classes_of_families_chains_and_strangers(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(6):  # families whose members are edits of one text
        base = list(rng.choice(vocab, 200))
        for _ in range(12):
            t = list(base)
            for p in rng.integers(0, 200, rng.integers(0, 4)):
                t[p] = str(rng.choice(vocab))
            texts.append(" ".join(t))
    t = list(rng.choice(vocab, 300))
    for _ in range(12):  # a chain: the ends are unlike, each step is a link
        texts.append(" ".join(t))
        at = int(rng.integers(0, 280))
        t[at:at + 12] = list(rng.choice(vocab, 12))
    passage = list(rng.choice(vocab, 80))
    for _ in range(20):  # strangers that share a passage
        texts.append(" ".join([*rng.choice(vocab, 60), *passage, *rng.choice(vocab, 60)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = near_dedup.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(brute_classes(texts)))
    assert sum(r.kept for r in rows) == len(set(brute_classes(texts)))


def test_near_classes_of_texts_with_repeated_lines(spark):
    """Of each trio, two are a link by plain Jaccard only (probability Jaccard is about 0.6) and a third
    shares buckets with one of them; whichever is the least node, the classes are brute force's."""
    rng = np.random.default_rng(21)
    vocab = [f"w{i}" for i in range(20_000)]
    texts = []
    for _ in range(30):
        base = [str(w) for w in rng.choice(vocab, 1000, replace=False)]
        passage, edited = base[100:500], [*base[:600], *rng.choice(vocab, 90), *base[690:]]
        texts += [" ".join(base), " ".join([*edited, *passage * 40]), " ".join([*base[:500], *rng.choice(vocab, 500), *passage * 40])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = near_dedup.classes(docs).collect()
    want = brute_classes(texts)
    assert want[1] == want[0] and len(set(want)) == 60
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))


def test_cells_pass_pairs_by_either_measure():
    """Three texts of one bucket, of which the last two agree in the unweighted sketch only."""
    w = [bytes([i]) * 1000 for i in range(4)]
    rows = [(0, 1, b"a", b"a", [1, 9], w[0]), (0, 1, b"b", b"b", [2, 9], w[1]), (0, 1, b"c", b"c", [3, 8, 4, 9], w[2] + w[1])]
    assert near_dedup._cell_pairs(rows, 743, 1000, 2) == [(b"b", b"c")]
    rows[2] = (0, 1, b"c", b"c", [3, 8, 2, 9], w[2] + w[1])  # they share a band before this one
    assert near_dedup._cell_pairs(rows, 743, 1000, 2) == []


def test_near_odd_rows(odd_docs, no_docs):
    rows = near_dedup.classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == {1} and by[3] == by[4] == by[5] == {3} and by[6] == by[7] == {6} and by[8] == {8}
    assert near_dedup.classes(no_docs).count() == 0
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 8, 9, 10, 11, 12]
    assert sorted(r.kept for r in rows if r.doc_id == 8) == [False, True]
    assert sum(r.kept for r in rows) == kept.count()


def test_near_repeated_rows_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " more"), (1, text), (None, "x y z a b c"), (None, "x y z a b c"), (3, "other words stand in this one here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = near_dedup.keep_one(docs)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", text), ("3", rows[-1][1]), ("None", "x y z a b c")]
    assert sum(r.kept for r in near_dedup.classes(docs).collect()) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (300, 200), (300, 201), (5, 5)]
    got = dict(components.components(spark.createDataFrame(edges, "a int, b int")).collect())
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 300: 200, 200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0
