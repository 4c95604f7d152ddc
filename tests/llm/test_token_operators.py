import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shroud.llm import packing, sentencepiece_codec
from shroud.sources.tables import read_table
from tests.conftest import SF_SMALL

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def check_packing(rows, docs, max_tokens=2048):
    """docs: (id, text) rows. Every id in one piece, sequences gapless and within the limit."""
    library = Tokenizer.from_file(BYTE_BPE)
    want = collections.Counter()
    for i, t in docs:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    encoded = {(i, t): library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    if len({i for i, _ in docs}) == len(docs):  # ids name texts
        for i, t in docs:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                ids = np.array(encoded[i, t][r.start:r.start + r.length], dtype="<u4")
                assert r.start == at and r.length > 0 and r.doc_tokens == len(encoded[i, t])
                assert r.ids_crc32 == zlib.crc32(ids.tobytes())
                at += r.length
            assert at == len(encoded[i, t])
    assert sum(r.length for r in rows) == sum(len(encoded[d]) for d in docs)
    padding = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding / max(1, sum(r.length for r in rows)), by_sequence


def test_packing_of_documents(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    waste, _ = check_packing(packing.op5_packing(spark, SF_SMALL).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert waste < 0.01


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, BYTE_BPE).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_packing_special_strings_go_to_the_library(spark):
    docs = [(1, "before <|endoftext|> after"), (2, "plain")]
    check_packing(packing.pack(spark.createDataFrame(docs, "doc_id int, text string"), BYTE_BPE).collect(), docs)


@pytest.mark.parametrize("limits", [(256, 4, 256), (256, 64, 100), (64, 3, 20), (16, 1, 1)])
def test_packing_keeps_three_limits_at_once(spark, limits):
    tokens, segments, loss = limits
    rng = np.random.default_rng(1)
    docs = [(i, "the of and to " * int(rng.integers(0, 40)), "ask me " * int(rng.integers(0, 30))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id int, text string, prompt string")
    rows = packing.pack(frame, BYTE_BPE, prompt_col="prompt", max_tokens=tokens, max_segments=segments, max_loss=loss, min_cut=4).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    total = {i: (size(p) + size(t) + 1, max(1, size(p))) for i, t, p in docs}
    per_doc, per_sequence = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        n, unlearned = total[r.doc_id]
        assert r.doc_tokens == n
        assert r.loss_tokens == sum(1 for k in range(r.start, r.start + r.length) if k >= unlearned)
        per_doc[r.doc_id] += r.length
        for k, x in enumerate((r.length, 1, r.loss_tokens)):
            per_sequence[r.sequence_id][k] += x
    assert per_doc == {i: n for i, (n, _) in total.items()}
    assert all(t <= tokens and s <= segments and x <= loss for t, s, x in per_sequence.values())


def test_many_equal_sizes_leave_little_padding(spark):
    docs = [(i, "thing " * 1100) for i in range(600)]
    waste, _ = check_packing(packing.pack(spark.createDataFrame(docs, "doc_id int, text string"), BYTE_BPE).collect(), docs)
    assert waste < 0.02


def expected_pieces(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = model.encode(text or "", add_eos=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))


def test_sentencepiece_equals_the_library(spark, odd_docs, no_docs):
    for docs in (read_table(spark, SF_SMALL, "documents"), odd_docs):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        rows = sentencepiece_codec.encode_documents(docs, PIECES, with_output=False).collect()
        want = collections.Counter((i, *expected_pieces(t)) for i, t in texts)
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert sentencepiece_codec.encode_documents(no_docs, PIECES).count() == 0


def test_sentencepiece_ids_and_round_trip(odd_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in sentencepiece_codec.encode_documents(odd_docs.where("text is not null"), PIECES).join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id != 8:  # a repeated id joins both rows
            assert r.ids == model.encode(r.text, add_eos=True) and r.decoded == r.text == model.decode(r.ids)


def test_codec_on_random_letters_and_single_pieces():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(PIECES), remember=50)  # tables are cleared often
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(2)
    letters = list("ab cde▁éß日本\n\t🙂thein gÀ①². \u3000")
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(3000)] + ["a" * 3000, " " * 99, "the" * 800, "\u0000", "<s></s>"]
    texts += [model.id_to_piece(int(i)).replace("▁", " ") for i in rng.integers(259, 32000, 1500)]
    for t in texts:
        ids = model.encode(t, add_eos=True)
        assert codec.encode(t) == ids and codec.decode(ids) == model.decode(ids)


@pytest.mark.parametrize("blank", [" ", "\n", "\t \n", "\xa0"])
def test_packing_of_long_blank_runs(spark, blank):
    """Runs of white space by the million, alone and inside a text, and runs about the length that changes the encoder."""
    run = blank * (1_200_000 // len(blank))
    edge = blank * (packing.LONG_BLANK // len(blank) + 2)
    docs = [(1, run), (2, f"x {run} y"), (3, run + "end"), (4, "a" + edge[:packing.LONG_BLANK - 1] + "b"), (5, "a" + edge[:packing.LONG_BLANK] + "b")]
    check_packing(packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), BYTE_BPE).collect(), docs)
