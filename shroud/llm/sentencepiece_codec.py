"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

An encoding without its last token is the encoding of the text before that token, so every prefix
of a text has one last token. Left to right, the automaton of all pieces names the pieces that end
at a position; the one that is compatible with the last token of the prefix before it is the last
token of this prefix. Compatible means: merging the two pieces' joint text by score gives just
these two pieces (each pair is tested once and remembered). The ids are then read backwards.

Texts are cut into atoms where no merge can cross: before a space mark (no piece holds one after
another letter), between a letter and what is none, and around line ends, each as far as no piece
of the model stands against it (checked when the model is read). Results of short atoms are
remembered in a table of bounded size. Letters without a piece become the bytes of their UTF-8 form.

Defined cases: null text = empty (the end id alone); texts without spaces are one unit and take
linear time; an empty table gives an empty result; repeated rows and null ids pass; other columns
are left out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

MARK = "▁"
NORMAL, BYTE = 1, 6
def read_model(path: str) -> dict:
    """Pieces, scores and byte ids of a BPE model file; refuses what the encoder doesn't do."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
    unknown = [i for i, p in enumerate(model.pieces) if p.type not in (NORMAL, 2, 3, BYTE)]
    if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
            or not norm.add_dummy_prefix or not norm.escape_whitespaces or unknown or any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("only BPE models with byte fallback, without text normalisation and special pieces")
    return {"pieces": pieces, "bytes": [i for i, p in enumerate(model.pieces) if p.type == BYTE], "end": train.eos_id}


class Codec:
    def __init__(self, model: dict, remember: int = 600_000, longest_remembered: int = 40):
        import ahocorasick

        self.pieces, self.byte_ids, self.end = model["pieces"], model["bytes"], model["end"]
        self.remember, self.longest = remember, longest_remembered
        self.texts = {i: p for p, (i, _) in self.pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.decimal = {p: str(i) for p, (i, _) in self.pieces.items()}
        self.atoms: dict[str, tuple[int, str, str]] = {}
        self.cut = self._cutter()

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text, by the definition: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.pieces[j][1], -i) for i in range(len(parts) - 1) if (j := parts[i] + parts[i + 1]) in self.pieces), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _pair(self, left: str, right: str) -> bool:
        ok = self.compatible.get((left, right))
        if ok is None:
            if len(self.compatible) >= 4 * self.remember:
                self.compatible.clear()
            # two pieces whose joint text is a piece would merge in the end
            ok = self.compatible[left, right] = (not left or left + right not in self.pieces) and self.merge(left + right) == ([left, right] if left else [right])
        return ok

    def atom_pieces(self, atom: str) -> list[str]:
        """The pieces of an atom: fills the table of last tokens, then walks it backwards."""
        last, done, known = ["", *atom], -1, self.compatible  # last[i]: the last token of atom[:i]
        for end, (size, piece) in self.automaton.iter(atom):  # by end, the longest first
            if end != done:
                before = last[end + 1 - size]
                ok = known.get((before, piece))
                if ok or ok is None and self._pair(before, piece):
                    last[end + 1] = piece
                    done = end
        out, i = [], len(atom)  # where no piece ends the letter itself stands, for the byte fallback
        while i:
            out.append(last[i])
            i -= len(last[i])
        out.reverse()
        return out

    def _cutter(self) -> re.Pattern:
        """Finds atoms. Letters that some piece holds before a non-letter don't count as letters."""
        is_letter = re.compile(r"[^\W\d_]").match
        odd = "".join(sorted({a for p in self.pieces for a, b in zip(p, p[1:]) if is_letter(a) and not is_letter(b)}))
        line = "" if any("\n" in p for p in self.pieces) else "\n"
        other = f"[\\W\\d_{re.escape(odd)}](?<![{MARK}{line}])"
        atom = f"{MARK}+(?:{other})*[^\\W\\d_{re.escape(odd)}]*|(?:{other})+[^\\W\\d_{re.escape(odd)}]*|[^\\W\\d_{re.escape(odd)}]+"
        return re.compile(f"{atom}|{line}+" if line else atom)

    def _atom(self, atom: str) -> tuple[int, str, str]:
        """Count, ids in decimal and spelling of an atom."""
        pieces = self.atom_pieces(atom)
        try:
            known = len(pieces), " ".join([self.decimal[p] for p in pieces]), "".join(pieces)
        except KeyError:  # letters without a piece
            ids: list[int] = []
            for p in pieces:
                ids += [self.pieces[p][0]] if p in self.pieces else [self.byte_ids[b] for b in p.encode()]
            known = len(ids), " ".join(map(str, ids)), self._spell(ids)
        if len(atom) <= self.longest:
            if len(self.atoms) >= self.remember:
                self.atoms.clear()
            self.atoms[atom] = known
        return known

    def decode(self, ids) -> str:
        """The text of ids; control ids say nothing; the leading space mark is dropped."""
        text = self._spell(ids).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def _spell(self, ids) -> str:
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i in self.texts:
                out += self.texts[i].encode()
        return out.decode("utf-8", "replace")

    def split(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        """All ids with the end id."""
        return [int(i) for i in self.digest(text)[1].split()]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal joined by spaces, decoded text."""
        known = self.atoms
        found = [known.get(a) or self._atom(a) for a in self.split(text)]
        decoded = "".join([f[2] for f in found]).replace(MARK, " ")
        return (sum([f[0] for f in found]) + 1, " ".join([*[f[1] for f in found], str(self.end)]),
                decoded[1:] if decoded.startswith(" ") else decoded)


_CODECS: dict[str, Codec] = {}


def _codec(key: str, model: dict) -> Codec:
    """One codec a Python worker, kept between its tasks."""
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids and decoded text."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # the size of a vocabulary file
    kept = docs.select(id_col, text_col)
    schema = f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>, decoded string" if with_output else "")

    def run(batches):
        codec = _codec(model_path, model.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = [codec.digest(t or "") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()),
                       pa.array([sha(r[2]) for r in rows], pa.string())]
            if with_output:
                columns += [pa.array([[int(i) for i in r[1].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:len(columns)])

    return kept.mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_output=False)
