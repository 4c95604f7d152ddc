"""Vector bin packing of token sequences for training.

Each sequence (bin) has three limits at once: tokens, segments (pieces) and loss-bearing tokens.
Examples are tokenised in tasks; what is longer than a sequence is cut into full sequences, and the
rest of each example waits in a window of bounded size. A bin is filled by the dot-product
heuristic: of the waiting items that fit all three remaining capacities, the one whose size vector
has the largest dot product with the remaining capacities goes in. When nothing fits and the gap is
`min_cut` tokens or more, an item is cut to fill it and its rest waits on. The last, partly filled
bin of a task is cut into sequences whose lengths are powers of two, which need no padding.

No shuffle: every task packs the rows of its own partition and numbers sequences by
(partition << 32) + n, so a lost task is redone alone with the same result. Memory: the window
(at most `window` items shorter than a sequence) and one example.

The loss-bearing tokens of an example are all but its prompt's, or all but its first token (nothing
predicts it) without a prompt. Defined cases: null text or prompt = empty (the end id alone);
repeated rows and null ids are packed like any row; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from .common import tidy

LONG_BLANK = 10_000
PIECE_SCHEMA = ("{id} {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                "sequence_id bigint, offset bigint, loss_tokens bigint")


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library.

    tiktoken's encoder runs the same merges several times faster. Two kinds of text go to the library
    itself: those that hold the string of a special token, which it treats apart, and those with a
    white-space run of `LONG_BLANK` characters, on which tiktoken's pattern matcher runs out of stack
    (measured at about a million)."""

    def __init__(self, spec: str, pattern: str):
        import tiktoken

        model = json.loads(spec)
        self.spec, self.library = spec, None
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        as_byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.encoder = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or len(text) >= LONG_BLANK and re.search(rf"\s{{{LONG_BLANK}}}", text):
            if self.library is None:
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_str(self.spec)
            return self.library.encode(text, add_special_tokens=False).ids
        return self.encoder.encode_ordinary(text)


def _byte_letters() -> list[str]:
    """The letter by which byte-level BPE files write each byte: itself where printable in Latin-1,
    else the next letter from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Packer:
    """Places examples, given one by one, and collects the rows of finished sequences."""

    def __init__(self, tokens: int, segments: int, loss: int, window: int, min_cut: int, first_sequence: int):
        self.caps = np.array([tokens, segments, loss], dtype=np.int64)
        self.window, self.min_cut, self.sequence = window, min_cut, first_sequence
        self.rows: list[tuple] = []
        self.items: list[tuple | None] = [None] * window  # (id, ids, start, loss-free tokens)
        self.sizes = np.zeros((window, 3), dtype=np.int64)  # of the waiting items; 0 tokens: a free place
        self.free = list(range(window))

    def _loss(self, start: int, length: int, unlearned: int) -> int:
        return max(0, start + length - max(start, unlearned))

    def _most(self, start: int, unlearned: int, room) -> int:
        """The longest piece from start on that the room's tokens and loss-bearing tokens allow."""
        return int(min(room[0], max(unlearned - start, 0) + room[2]))

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, ids, start, length, unlearned in pieces:
            crc = zlib.crc32(ids[start:start + length].tobytes())
            self.rows.append((key, start, length, crc, len(ids), self.sequence, offset, self._loss(start, length, unlearned)))
            offset += length
        self.sequence += 1

    def add(self, key, ids: np.ndarray, unlearned: int) -> None:
        start = 0
        while len(ids) - start > (m := self._most(start, unlearned, self.caps)) or len(ids) - start == self.caps[0] == m:
            self._emit([(key, ids, start, m, unlearned)])
            start += m
        if start < len(ids):
            self._wait(key, ids, start, unlearned)
            if not self.free:
                self._emit(self._fill())

    def _wait(self, key, ids, start, unlearned) -> None:
        at = self.free.pop()
        self.items[at] = (key, ids, start, unlearned)
        self.sizes[at] = (len(ids) - start, 1, self._loss(start, len(ids) - start, unlearned))

    def _take(self, at: int) -> tuple:
        item, self.items[at], self.sizes[at] = self.items[at], None, 0
        self.free.append(at)
        return item

    def _fill(self) -> list[tuple]:
        """The pieces of one bin."""
        room, pieces = self.caps.copy(), []
        while True:
            fits = (self.sizes <= room).all(axis=1) & (self.sizes[:, 0] > 0)
            if not fits.any():
                break
            weight = room / self.caps.astype(float) ** 2
            at = int(np.argmax(np.where(fits, self.sizes @ weight, -1.0)))
            room -= self.sizes[at]
            key, ids, start, unlearned = self._take(at)
            pieces.append((key, ids, start, len(ids) - start, unlearned))
        if room[0] >= self.min_cut and room[1] > 0 and self.sizes[:, 0].any():
            at = int(np.argmax(self.sizes[:, 0]))
            _, ids, start, unlearned = self.items[at]
            if (m := self._most(start, unlearned, room)) >= self.min_cut:
                key, *_ = self._take(at)
                pieces.append((key, ids, start, m, unlearned))
                self._wait(key, ids, start + m, unlearned)
        return pieces

    def finish(self) -> None:
        while self.sizes[:, 0].any():
            pieces = self._fill()
            if self.sizes[:, 0].any():
                self._emit(pieces)
                continue
            left = sum(p[3] for p in pieces)  # the last bin
            while left:
                want, part = 1 << (left.bit_length() - 1), []
                left -= want
                while want:
                    key, ids, start, length, unlearned = pieces.pop(0)
                    m = min(length, want)
                    part.append((key, ids, start, m, unlearned))
                    if m < length:
                        pieces.insert(0, (key, ids, start + m, length - m, unlearned))
                    want -= m
                self._emit(part)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
         max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048, end_id: int = 1,
         window: int = 1024, min_cut: int = 16, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.
    An example's ids: prompt, text, end id."""
    for cap in (max_tokens, max_segments, max_loss):
        if cap < 1:
            raise ValueError("limits are 1 or more")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the size of a vocabulary file
    kept = docs.select(id_col, text_col, *([prompt_col] if prompt_col else []))
    schema = PIECE_SCHEMA.format(id=f"`{id_col}`", id_type=kept.schema[0].dataType.simpleString())

    def run(batches):
        bpe = ByteBpe(spec.value, pattern)
        packer = Packer(max_tokens, max_segments, max_loss, window, min_cut, TaskContext.get().partitionId() << 32)

        def out(arrow_id):
            columns = list(zip(*packer.rows)) or [()] * 8
            packer.rows = []
            types = [arrow_id, *[pa.int64()] * 7]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

        arrow_id = None
        for batch in batches:
            arrow_id = batch.column(0).type
            for row in range(batch.num_rows):
                key, text, *prompt = (batch.column(i)[row].as_py() for i in range(batch.num_columns))
                head = bpe.encode(prompt[0]) if prompt and prompt[0] else []
                ids = np.array([*head, *bpe.encode(text or ""), end_id], dtype="<u4")
                packer.add(key, ids, max(1, len(head)))
                if len(packer.rows) >= 8192:
                    yield out(arrow_id)
        packer.finish()
        if packer.rows:
            yield out(arrow_id)

    return kept.mapInArrow(tidy(run), schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
