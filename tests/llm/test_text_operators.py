import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import language_id, pii_sanitise, quality_rules, toxicity
from shroud.sources.tables import read_table
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.conftest import contract_words

SF_LARGE = "/root/testdata/sf0.1"


# --- personal data -------------------------------------------------------------------------------

def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15)]


def brute_spans(text):
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m[0]))


def as_contract(spans):
    s = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
    n = collections.Counter(name for *_, name in spans)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(s.encode()).hexdigest()


def random_texts(n=1500):
    rng = random.Random(3)
    letters = list("0123456789") * 3 + list("ab@..@+-- ()é🙂_%\n")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return texts + ["a" * 3000 + "@", "1" * 3000, "1 " * 3000, "1.2.3.4 " * 900, "+" + "1(" * 3000, "4111 1111 1111 1111 and x@y.z_q@r.st", None, "",
                    "001.002.3.4 and 1.2.3.4.5.6.7.8 or 256.1.1.1", "a@b.c@d.e", "5555 5555 5555 4444 1", "é" * 50 + "q@w.de"]


def test_base_spans_equal_brute_force(spark, odd_docs):
    docs = spark.createDataFrame(list(enumerate(random_texts())), "doc_id bigint, text string")
    for d in (docs, odd_docs.select("doc_id", "text"), read_table(spark, SF_SMALL, "documents").select("doc_id", "text")):
        rows = pii_sanitise.span_report(d).collect()
        want = collections.Counter((r.doc_id, *as_contract(brute_spans(r.text))) for r in d.collect())
        assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 200_000 + "@ ", "1" * 200_000, "9 " * 100_000, "1.2.3." * 40_000, "+1(" * 60_000, "x@" * 80_000]
    rows = pii_sanitise.span_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(rows) == len(texts)


def test_text_of_many_spans(spark):
    """20,000 addresses in one text: words near each, across the borders of pieces and beyond the BMP, and the text in between."""
    text = " ".join(f"name\U0001F600 lord{'e' * (i % 7)} u{i}@host{i % 50}.org met" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "\U0001F600" * 2047 + " word jo@ex.org")], "doc_id bigint, text string")
    rows = {r._id: r for r in pii_sanitise.scan(docs).collect()}
    ends = [m.span() for m in re.finditer(r"u[0-9]+@host[0-9]+[.]org", text)]
    assert [(x.start, x.end) for x in rows[1].base] == ends and rows[2].base == [] and rows[2].near == []
    near = set()
    for a, b in ends:
        names = [f"email:{text[a:b]}", f"email-group:{text[text.index('@', a):b]}", "kind:email"]
        padded = f" {text} "
        for part in (padded[max(a - 100, 0):a + 1], padded[b + 1:b + 101]):
            words = re.findall(r"(?<=[\s\"'(])[^\W\d_]{4,}(?=[.,;:!?\"')]*\s)", part)
            near |= {(e, w.lower()) for e in names for w in words}
    assert {(x.entity, x.term) for x in rows[1].near} == near and len(rows[1].near) == len(near)
    assert ("kind:email", "word") in {(x.entity, x.term) for x in rows[3].near}
    out = docs.join(pii_sanitise.scan(docs).select("_id", "base"), F.col("_id") == F.col("doc_id")).select(
        "_id", pii_sanitise.replaced(F.col("text"), F.transform("base", lambda x: x.withField("value", F.lit("[E]")))).alias("t")).collect()
    done = {r._id: r.t for r in out}
    assert done[1] == re.sub(r"u[0-9]+@host[0-9]+[.]org", "[E]", text) and done[2] == "" and done[3].endswith("\U0001F600 word [E]")


def test_overlapping_spans_are_replaced_once(spark):
    rng, rows = random.Random(3), []
    for i in range(40):
        text = "".join(rng.choice("ab\U0001F600 ") for _ in range(rng.choice([0, 5, 3000])))
        cuts = sorted(sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.choice([0, 1, 600]) if len(text) > 5 else 0))
        out, at = [], 0
        for a, b in cuts:
            out += [] if a < at else [text[at:a], "<>"]
            at = max(at, b)
        rows.append((i, text, [(a, 0, b, "email", "<>") for a, b in cuts], "".join(out) + text[at:]))
    df = spark.createDataFrame(rows, f"i int, text string, spans array<{pii_sanitise.SPAN}>, expected string")
    assert df.where(pii_sanitise.replaced(F.col("text"), F.col("spans")) != F.col("expected")).count() == 0


def disclosure_docs():
    """The word `zubrowkan` stands beside one address and nowhere else; `ordinary` beside it and all
    over; `rarely` beside it in one text only, which has many copies."""
    near = [f"text {w} ordinary zubrowkan jo@ex.org closing {w}" for w in "alpha beta gamma delta".split()]
    copies = ["ordinary letter rarely kim@ex.org closing"] * 6
    rest = [f"an ordinary closing text about nothing number {w}" for w in range(60)]
    return list(enumerate(near + copies + rest))


def test_terms_that_disclose_an_entity(spark):
    docs = spark.createDataFrame(disclosure_docs(), "doc_id bigint, text string")
    rows = {r.doc_id: r.spans for r in pii_sanitise.span_report(docs).collect()}
    texts = dict(disclosure_docs())
    for i, t in texts.items():
        terms = [t[int(a):int(b)] for k, a, b in (s.split(":") for s in rows[i].split(",") if s) if k == "term"]
        assert terms == (["zubrowkan"] if i < 4 else [])
    found = {(r.entity, r.term): r.disclosure for r in pii_sanitise.disclosing(docs, pii_sanitise.scan(docs), generalise_at=-9.0).collect()}
    n = len(texts)
    for term in ("zubrowkan", "ordinary", "closing"):
        n_t, n_te, n_e = sum(term in t for t in texts.values()), 4, 4
        assert found["email:jo@ex.org", term] == pytest.approx(math.log(n * n_te / (n_t * n_e)) / math.log(n / n_e))
    assert not any(e == "email:kim@ex.org" for e, _ in found)  # copies of one text prove nothing


def test_sanitised_texts(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(disclosure_docs() + [(900, "call +1 555 010 9999 4111 1111 1111 1111"), (901, "clean 12 text")], "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in pii_sanitise.sanitise(docs).collect()}
    assert out[0] == "text alpha ordinary  [EMAIL] closing alpha"  # removed: it occurs nowhere else
    assert out[4] == "ordinary letter rarely [EMAIL] closing"
    assert out[901] == "clean 12 text" and not brute_spans(out[900])
    softer = {r.doc_id: r.text for r in pii_sanitise.sanitise(docs, remove_at=1.5).collect()}
    assert softer[0] == "text alpha ordinary [TERM] [EMAIL] closing alpha"
    odd = pii_sanitise.sanitise(odd_docs)
    assert odd.columns == odd_docs.columns and odd.schema["n_chars"].dataType == odd_docs.schema["n_chars"].dataType
    rows = collections.Counter((r.doc_id, r.text, r.n_chars) for r in odd.collect())
    assert rows[10, "mail [EMAIL], [PHONE] now", 25] == 1 and sum(rows.values()) == odd_docs.count()
    assert {k: v for k, v in rows.items() if k[0] != 10} == {k: v for k, v in collections.Counter((r.doc_id, r.text, r.n_chars) for r in odd_docs.collect()).items() if k[0] != 10}
    assert pii_sanitise.sanitise(no_docs).count() == 0 and pii_sanitise.span_report(no_docs).count() == 0


def test_entities_of_one_text_are_pooled(spark):
    """Each address stands in one text; what they share is the domain, `letter` and `nephrolog` go with it."""
    held = [f"letter {w} ordinary nephrolog {w}@ward.org closing" for w in "alpha beta gamma delta".split()]
    rest = [f"an ordinary closing text about nothing number {w}" for w in range(60)] + [f"ordinary {w} closing kim{w}@ex{w}.org or" for w in "unus duos tres".split()]
    docs = spark.createDataFrame(list(enumerate(held + rest)), "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in pii_sanitise.sanitise(docs).collect()}
    for i, w in enumerate("alpha beta gamma delta".split()):
        assert out[i] == f" {w} ordinary  [EMAIL] closing"  # `letter` too is in these texts only
    assert out[64] == "ordinary unus closing [EMAIL] or"  # `unus` was met in one text only


def test_pooled_terms_on_a_given_table(spark):
    """A word put before each address of the table, all of them in one text each, is found; of the table's own words one goes with a kind."""
    docs = read_table(spark, SF_MID, "documents").select("doc_id", "text")
    marked = docs.withColumn("text", F.regexp_replace("text", "(?<= )(?=[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.])", "zubrowkan "))
    texts = {r.doc_id: r.text for r in marked.collect()}
    rows = {r.doc_id: r.spans for r in pii_sanitise.span_report(marked).collect()}
    terms = {i: [texts[i][int(a):int(b)] for k, a, b in (x.split(":") for x in s.split(",") if x) if k == "term"] for i, s in rows.items()}
    assert sum("zubrowkan" in t for t in texts.values() if t) >= 10
    assert all([x for x in terms[i] if x == "zubrowkan"] == ["zubrowkan"] * (t or "").count("zubrowkan") for i, t in texts.items())
    assert {x for t in terms.values() for x in t} == {"zubrowkan", "token"}  # `token` stands in 12 texts, 7 with a phone number


def test_terms_far_from_their_entity(spark):
    """`zubrowkan` stands near the address in 3 of the 6 texts that hold both, elsewhere 500 characters off."""
    far = " ordinary text" * 40
    near = [f"one {w} zubrowkan jo@ex.org end" for w in "alpha beta gamma".split()]
    off = [f"Zubrowkan, {w}{far} jo@ex.org end (zubrowkan) zubrowkan-{w}" for w in "delta epsilon zeta".split()]
    rest = [f"an ordinary closing text about nothing number {w}" for w in range(60)] + ["a zubrowk and jo@else.org end"]
    docs = spark.createDataFrame(list(enumerate(near + off + rest)), "doc_id bigint, text string")
    found = {(r.entity, r.term): r.disclosure for r in pii_sanitise.disclosing(docs, pii_sanitise.scan(docs), generalise_at=-9.0).collect()}
    assert found["email:jo@ex.org", "zubrowkan"] == pytest.approx(1.0)
    out = {r.doc_id: r.text for r in pii_sanitise.sanitise(docs).collect()}
    assert not any("zubrowkan" in t.lower() for t in out.values())
    assert out[3] == f", delta{far} [EMAIL] end () -delta" and out[66] == "a zubrowk and [EMAIL] end"


def test_pairs_of_many_entities_and_many_terms(spark):
    """Both ways of meeting an entity's terms with a text's words give the pairs that a plain search gives."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    texts = [" ".join(x for _ in range(rng.choice([3, 60])) for x in (rng.choice(vocab), rng.choice(["or", f"u{rng.randint(0, 6)}@h{rng.randint(0, 2)}.org"]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:9])), "doc_id bigint, text string")
    scanned = pii_sanitise.scan(docs)
    rows = pii_sanitise.folded(scanned)
    pairs = spark.createDataFrame([(e, t) for e in ["email:u1@h1.org", "email-group:@h2.org", "kind:email"] for t in vocab[:{"k": 150}.get(e[0], 20)]], "entity string, term string")
    got = collections.Counter((r.entity, r.term) for r in pii_sanitise._together(rows, pairs).collect() for _ in range(r.copies))
    sign = {"email:u1@h1.org": "u1@h1.org", "email-group:@h2.org": "@h2.org", "kind:email": "@"}
    want = {(p.entity, p.term): sum(sign[p.entity] in t and p.term in t.split() for t in texts + texts[:9]) for p in pairs.collect()}
    assert got == collections.Counter({k: n for k, n in want.items() if n})


# --- quality rules -------------------------------------------------------------------------------

def brute_quality(text):
    text = text or ""
    w = contract_words(text)
    count, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if contract_words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_columns_equal_brute_force(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(1000, "a b c " * 2), (1001, "a a a a"), (1002, "x\nx\n \n \nx"), (1003, "one two three"), (1004, "  nbsp em")], "doc_id bigint, text string")
    for d in (odd_docs.select("doc_id", "text").union(extra), read_table(spark, SF_SMALL, "documents").select("doc_id", "text")):
        rows = quality_rules.judge(d).collect()
        want = collections.Counter((r.doc_id, *brute_quality(r.text)) for r in d.collect())
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
        assert all(not r.kept for r in rows if r.base_failed)
    assert quality_rules.judge(odd_docs).count() == odd_docs.count()
    assert quality_rules.judge(no_docs).count() == 0


def test_posterior_keeps_good_and_drops_junk(spark):
    labels = {r.doc_id: r.quality for r in read_table(spark, SF_MID, "labels").collect()}
    rows = [r for r in quality_rules.op9_quality_rules(spark, SF_MID).collect() if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    junk = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.05 * len(junk)


def test_em_recovers_planted_rates():
    rng = np.random.default_rng(4)
    bad = rng.random(20_000) < 0.2
    rates = [(0.9, 0.02), (0.6, 0.1), (0.7, 0.05), (0.5, 0.01)]
    votes = np.stack([np.where(rng.random(len(bad)) < 0.2, quality_rules.NONE,
                               np.where(rng.random(len(bad)) < np.where(bad, b, g), quality_rules.BAD, quality_rules.GOOD)) for b, g in rates], axis=1)
    model = quality_rules.estimate(sorted(collections.Counter(map(tuple, votes.tolist())).items()))
    assert abs(model["prior"] - 0.2) < 0.03
    assert all(abs(x - y) < 0.05 for got, want in zip(model["rates"], rates) for x, y in zip(got, want))
    assert quality_rules.log_odds_bad((1, 1, 1, 1), **model) < 0
    assert quality_rules.estimate([])["rates"] == []


# --- toxicity ------------------------------------------------------------------------------------

def test_noisy_or():
    assert toxicity.noisy_or([]) == 0
    assert toxicity.noisy_or([0.5, 0.5]) == pytest.approx(0.75)
    assert toxicity.noisy_or([1.0, 0.1]) <= 1


def test_sentences_are_located_from_document_labels(spark):
    rng = random.Random(7)
    plain = [f"word{i}a".replace("0", "o") for i in range(80)]
    plain = ["".join(chr(97 + (7 * i + j * 5) % 26) for j in range(5)) for i in range(80)]
    sentence = lambda bad: " ".join(rng.choice(plain) for _ in range(6)) + (" vilethug" if bad else "")
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        at = rng.randrange(5)
        rows.append((i, ". ".join(sentence(bad and k == at) for k in range(5)) + "."))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.learned(spark, docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    texts = dict(rows)
    for r in toxicity.score(docs, model).collect():
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
        found = [texts[r.doc_id][s.start:s.end] for s in r.offending]
        assert len(found) == (r.doc_id % 4 == 0) and all("vilethug" in f for f in found)
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i in texts if i % 4}


def test_toxicity_on_held_out_rows_and_odd_rows(spark, odd_docs, no_docs):
    labels = read_table(spark, SF_MID, "labels")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.op1_toxicity(spark, SF_MID).collect() if not r.held_out and r.doc_id in toxic]
    assert sum(r.predicted != toxic[r.doc_id] for r in rows) <= 0.02 * len(rows)
    model = toxicity.learned(spark, read_table(spark, SF_MID, "documents"), labels)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score == 0 for r in odd if r.doc_id in (3, 4, 5, 12))
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.learned(spark, odd_docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.0}


def test_toxicity_recall_on_held_out_labels(spark):
    toxic = {r.doc_id: r.toxic for r in read_table(spark, SF_LARGE, "labels").collect()}
    rows = [r for r in toxicity.op1_toxicity(spark, SF_LARGE).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    found = collections.Counter((toxic[r.doc_id], int(r.predicted)) for r in rows)
    assert len(rows) > 800
    # measured: 70 of 97 toxic found, 1 of 728 clean refused; the bounds lie just beyond
    assert found[1, 1] >= 0.7 * (found[1, 0] + found[1, 1]) and found[0, 1] <= 0.01 * (found[0, 0] + found[0, 1])


# --- language identification ---------------------------------------------------------------------

def brute_phrases(text, reference):
    """Greedy longest phrases of `text` that occur in `reference`."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in reference:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_phrase_counts_equal_brute_force():
    rng = random.Random(1)
    learned = {"aa": ["".join(rng.choice("abc ") for _ in range(300))], "bb": ["".join(rng.choice("abcd ") for _ in range(200)) for _ in range(2)]}
    parser = language_id.Parser(learned)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    codes = [parser.letters.of(t)[0] for t in texts]
    got = parser.phrases(codes, block=4096)
    squeeze = lambda t: re.sub(r"[^a-d?]+", " ", t.replace("e", "?"))
    for t, row in zip(texts, got):
        for k, lang in enumerate(parser.langs):
            reference = "\n".join(squeeze(x) for x in learned[lang])
            assert row[k] == brute_phrases(re.sub(" +", " ", squeeze(t)), reference)
    blocks = parser.phrases(codes, block=16)  # a phrase ends with its block
    assert (blocks >= got).all() and (blocks - got <= np.array([[len(c) // 16 + 1] for c in codes])).all()


def test_alphabet_of_thousands():
    rng = random.Random(2)
    signs = [chr(0x4E00 + i) for i in range(5000)]
    ideographs = ["".join(rng.choice(signs) for _ in range(700)) for _ in range(64)]
    greek = ["".join(rng.choice("αβγδεζηθ ") for _ in range(700)) for _ in range(64)]
    tracemalloc.start()
    parser = language_id.Parser({"el": greek, "zh": ideographs})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parser.letters.size > 4990 and peak < 300e6 and parser.owner.nbytes + parser.to.nbytes < 40e6
    texts = [ideographs[3][100:180] + "".join(rng.choice(signs) for _ in range(20)), greek[5][7:90], "a" + ideographs[0][:5] + "β", ideographs[1][-9:] + ideographs[2][:9]]
    got = parser.phrases([parser.letters.of(t)[0] for t in texts])
    for t, row in zip(texts, got):
        text = re.sub(r"[^\w]+", " ", t)
        assert list(row) == [brute_phrases(text, "\n".join(re.sub(" +", " ", x) for x in learned)) for learned in (greek, ideographs)]
    assert parser.predict([*texts[:2], ideographs[9] * 30, ""])[0] == ["zh", "el", "zh", "und"]


def test_letters_that_were_not_learned_never_match():
    parser = language_id.Parser({"tr": ["aİb aİc"]})  # lower case of this letter is two code points, so it has no code
    assert parser.phrases([parser.letters.of("aqb")[0]]).tolist() == [[3]]
    assert language_id.Parser({}).predict(["abc"]) == (["und"], [0.0])


def test_languages_of_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in read_table(spark, SF_MID, "documents").collect()}
    rows = language_id.op4_language_id(spark, SF_MID).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    texts = language_id.sample(read_table(spark, SF_SMALL, "documents"))
    assert sum(len(t) for x in texts.values() for t in x) <= 160_000 + 64 * len(texts)
    rows = language_id.identify(odd_docs, texts).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (3, 4, 5, 12))
    assert all(r.lang_pred in texts for r in rows if r.doc_id in (1, 6, 8, 11))
    assert {r.lang_pred for r in language_id.identify(odd_docs, {}).collect()} == {"und"}
    assert language_id.sample(no_docs) == {} and language_id.identify(no_docs, texts).count() == 0
