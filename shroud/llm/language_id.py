"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of its labelled text. A text is cut greedily into the longest
phrases that occur in the language's text; with c phrases in m characters, against n characters of
the language, c log2(n) / m estimates the cross entropy, and the language that needs the fewest
bits (the fewest normalised phrases) wins.

The automaton's rows (states) of edges (letters) are overlaid in one array where each slot names its
owner, so many texts are parsed in step with array operations, and memory follows the sample, not the
alphabet. Letters are lower-cased, everything else counts as one space. Texts are parsed whole, in
blocks of `block` characters (a phrase ends with its block), so a long text is many short lanes: in
each language at most one phrase more per `block` characters, alike for all languages.

Learning is on a bounded sample: `sample_docs` documents a language (the one with the least hash of
its id in each of as many hash ranges), `sample_chars` characters in all, shared by the languages; a
document gives a stretch that begins at a place named by its hash.
The sample is all that reaches the driver; each Python worker builds the automata once.

Defined cases: null text or no letter: `und`, score 0; no learned language: `und`; ties go to the
first language by name; letters unknown to all languages are phrases of their own; repeated rows and
null ids pass like any row; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import id_hash_mod

UNKNOWN, SPACE, BREAK = 0, 1, 2  # letter codes; from 3 on the alphabet


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 64,
           sample_chars: int = 160_000) -> dict[str, list[str]]:
    """Texts by language: of one document of each of `sample_docs` hash ranges, a stretch that begins at
    a place named by the document's hash, so that no part of a document weighs more than another."""
    order = F.xxhash64(F.col(id_col))
    share = 4 * sample_chars // sample_docs
    start = F.pmod(F.xxhash64(F.lit(1), F.col(text_col)), F.greatest(F.length(text_col) - share + 1, F.lit(1))).cast("int") + 1
    picked = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
              .groupBy(F.col(lang_col).alias("lang"), F.pmod(order, F.lit(sample_docs)).alias("range"))
              .agg(F.min_by(F.substring(text_col, start, F.lit(share)), F.struct(order, F.col(id_col), F.xxhash64(text_col))).alias("text")))
    out: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "range").collect():  # at most sample_docs rows a language
        out.setdefault(r["lang"], []).append(r["text"])
    each = sample_chars // max(1, len(out))
    return {lang: _share(texts, each) for lang, texts in out.items()}


def _share(texts: list[str], chars: int) -> list[str]:
    """The texts cut to one length, around their middles, so that they hold `chars` characters
    together, if they can."""
    low, high = 0, max(map(len, texts))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(len(t), mid) for t in texts) <= chars else (low, mid - 1)
    low = max(low, 1)
    return [t[max(0, len(t) - low) // 2:][:low] for t in texts]


class Letters:
    """Code points to letter codes."""

    def __init__(self, texts: list[str]):
        alphabet = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.code = np.where(alpha, UNKNOWN, SPACE).astype(np.int32)
        for k, c in enumerate(alphabet, BREAK + 1):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.code[ord(form)] = k
        self.alpha, self.size = alpha, BREAK + 1 + len(alphabet)

    def of(self, text: str) -> tuple[np.ndarray, bool]:
        """Codes with every run of non-letters as one space; whether there is a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.code[points]
        blank = codes == SPACE
        return codes[~(blank & np.append(False, blank[:-1]))], bool(self.alpha[points].any())


def suffix_automaton(codes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return step


def comb(n_states: int, state: np.ndarray, letter: np.ndarray, target: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (state, letter, target; by state) as overlaid rows: every state gets a place `at` of its own such
    that its edges lie in free slots `at + letter`. Returns `at`, and of each slot the place that owns it
    (-1: none) and the target's place. A quarter of the slots or less is taken, whatever the alphabet."""
    size = 1 << max(8, int(4 * len(state) + n_states).bit_length())
    owner, to = np.full(size + width, -1, np.int32), np.zeros(size + width, np.int32)
    at, taken = np.zeros(n_states, np.int32), np.zeros(size, bool)
    claim = np.zeros(size + width, np.int64)
    degree = np.bincount(state, minlength=n_states)
    start = np.cumsum(degree) - degree
    level = np.frexp(degree)[1]
    rng = np.random.default_rng(0)
    for k in range(int(level.max()), -1, -1):  # states with many edges first, while there is much room
        todo = np.nonzero(level == k)[0]
        while len(todo):  # every state draws a place; who meets a taken one or another's draws again
            mine, place = np.arange(len(todo)), rng.integers(0, size, len(todo))
            claim[place] = mine
            fits = ~taken[place] & (claim[place] == mine)
            many = degree[todo]
            who = np.repeat(mine, many)
            edge = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + start[todo][who]
            slot = place[who] + letter[edge]
            claim[slot] = np.arange(len(slot))
            free = (owner[slot] < 0) & (claim[slot] == np.arange(len(slot)))
            fits &= np.bincount(who[~free], minlength=len(todo)) == 0
            at[todo[fits]], taken[place[fits]] = place[fits], True
            owner[slot[fits[who]]] = place[who[fits[who]]]
            todo = todo[~fits]
    to[at[state] + letter] = at[target]
    return at, owner, to


class Parser:
    """All languages' automata as one comb. A language's state `root` has read nothing; in `fresh`, which
    has no edges, whatever comes begins a phrase."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        self.letters = Letters([t for x in texts.values() for t in x])
        edges, self.bits, roots, fresh, base = [np.zeros((3, 0), np.int64)], [], [], [], 0
        for lang in self.langs:
            codes = np.concatenate([np.append(self.letters.of(t)[0], BREAK) for t in texts[lang]])
            step = suffix_automaton(codes.tolist())
            found = np.array([(s, c, t) for s, out in enumerate(step) for c, t in out.items() if c not in (BREAK, UNKNOWN)], np.int64)
            edges.append(found.reshape(-1, 3).T + np.array([[base], [0], [base]]))
            roots.append(base)
            fresh.append(base + len(step))
            self.bits.append(np.log2(len(codes) + 1))
            base += len(step) + 1
        at, self.owner, self.to = comb(base, *np.concatenate(edges, axis=1), self.letters.size) if base else (np.zeros(0, np.int32),) * 3
        self.roots, self.fresh = at[np.array(roots, np.int64)], at[np.array(fresh, np.int64)]

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states (lanes, languages) after one letter a lane, and where it begins a phrase."""
        slot = state + codes[:, None]
        begins = self.owner.take(slot) != state
        to = self.to.take(slot)
        lane, lang = np.nonzero(begins)
        root = self.roots[lang]
        slot = root + codes[lane]
        to[lane, lang] = np.where(self.owner.take(slot) == root, self.to.take(slot), self.fresh[lang])
        return to, begins

    def phrases(self, texts: list[np.ndarray], block: int = 512) -> np.ndarray:
        """Number of phrases of each text (codes) in each language, (texts, languages)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        n_blocks = -(-sizes // block)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        length = np.minimum(sizes[owner] - nth * block, block)
        order = np.argsort(-length, kind="stable")
        flat = np.append(np.concatenate(texts) if texts else np.zeros(0, np.int32), np.zeros(block, np.int32))
        first = ((np.cumsum(sizes) - sizes)[owner] + nth * block)[order]
        alive = np.searchsorted(-length[order], -np.arange(block), side="left")  # lanes longer than j
        state = np.tile(self.fresh, (len(owner), 1))
        count = np.zeros((len(owner), len(self.langs)), dtype=np.int32)
        for j in range(block):
            if not (n := int(alive[j])):
                break
            state[:n], begins = self.step(state[:n], flat[first[:n] + j])
            count[:n] += begins
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        np.add.at(out, owner[order], count)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parsed = [self.letters.of(t) if t else (np.zeros(0, np.int32), False) for t in texts]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, (_, letter) in enumerate(parsed) if letter]
        if not some or not self.langs:
            return langs, scores
        size = np.array([len(parsed[i][0]) for i in some])
        entropy = self.phrases([parsed[i][0] for i in some]) * np.array(self.bits) / size[:, None]
        best = entropy.argmin(axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(size, 100)[:, None]
        sure = 1 / np.exp2(-np.minimum(gap, 60)).sum(axis=1)
        for k, i in enumerate(some):
            langs[i], scores[i] = self.langs[best[k]], float(sure[k])
        return langs, scores


_PARSERS: dict[int, Parser] = {}


def identify(docs: DataFrame, texts: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 2_000_000) -> DataFrame:
    """One row per input row: id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    kept = docs.select(id_col, text_col)

    def run(batches):
        key = hash(str(sorted(shared.value.items())))
        if key not in _PARSERS:  # one parser a Python worker, kept between its tasks
            _PARSERS.clear()
            _PARSERS[key] = Parser(shared.value)
        parser = _PARSERS[key]
        for batch in batches:
            langs, scores, held, chars = [], [], [], 0
            for text in batch.column(1).to_pylist():
                held.append(text)
                chars += len(text or "")
                if chars >= chunk_chars:
                    more = parser.predict(held)
                    langs, scores, held, chars = langs + more[0], scores + more[1], [], 0
            more = parser.predict(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs + more[0], pa.string()), pa.array(scores + more[1], pa.float64())],
                                             names=[id_col, "lang_pred", "score"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    texts = sample(docs.where(id_hash_mod("doc_id", 3) != 1))
    return identify(docs, texts).select("doc_id", (id_hash_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
