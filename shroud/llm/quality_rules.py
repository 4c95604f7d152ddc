"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the table of vote
patterns estimates, without labels, each rule's rate of bad votes among good and among bad
documents and the share of bad documents (a two-class model with rules independent given the
class). A document's verdict is its posterior probability of being good, in place of a chain of
all-must-pass filters. One native projection over the whole texts makes the features; they are
written once to the shared checkpoint folder; the corpus enters the model only as the counts of
vote patterns (at most 3 to the number of rules), summed over all documents. The posterior is an
arithmetic column over the votes.

A rule may not err on average: its rate of bad votes among bad documents is kept at or above that
among good ones, so a document without a bad vote never falls below the prior.

Defined cases: null or empty text has no words, every rule abstains and `base_failed` holds; texts
of any length are read whole; repeated rows count each; an empty table gives an empty result; other
columns of the input are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table
from .common import WS_CHARS, WS_RUN, let, text_or_empty

SYMBOLS = "#*$%&|<>"
BARE = rf"(?<![^\x20\x09-\x0D])[{SYMBOLS}]++(?![^\x20\x09-\x0D])"  # a word of symbols only
GOOD, BAD, NONE = 1, 0, -1


def _length(c: Column) -> Column:
    return F.length(c).cast("bigint")


def repeated_words(words: Column, n: int = 3) -> Column:
    """How many of the words lie in an n-word window that occurs twice or more in the array."""
    window = lambda w, i: [F.get(w, i + k) for k in range(n)]

    def covered(w: Column) -> Column:  # only for texts with a repeat: sort the windows, look at neighbours
        grams = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - n),
                                         lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("g"), i.alias("i"))))
        def twice(s):
            same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
            return F.filter(s, lambda x, j: same(x, j + 1) | F.when(j > 0, same(x, j - 1)).otherwise(False))
        starts = let(grams, twice)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(*[x["i"] + k for k in range(n)])))))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*window(w, i)))
        some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))  # no two equal hashes: no repeat
        return F.when((F.size(w) > n) & F.when(F.size(w) > n, some), covered(w)).otherwise(0)

    return count(words)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: id and what the rules look at."""
    t = F.col("_t")
    words = F.array_remove(F.split(t, WS_RUN, -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, WS_CHARS, "") != "")
    letters = F.regexp_replace(t, r"\P{L}+", "")
    n_symbols = _length(t) - _length(F.translate(t, SYMBOLS, ""))
    by_word = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"),
                                            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
                                            repeated_words(w).cast("bigint").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"),
                                            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    by_letter = let(letters, lambda x: F.struct(_length(x).alias("n_letters"),
                                                _length(F.regexp_replace(x, r"\P{Lu}+", "")).alias("n_upper")))
    return (docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_t"))
            .select(id_col, by_word.alias("_w"), by_line.alias("_l"), by_letter.alias("_a"),
                    _length(F.translate(t, WS_CHARS, "")).alias("word_chars"),
                    n_symbols.alias("n_symbols"),
                    F.when(n_symbols > 0, F.regexp_count(t, F.lit(BARE))).otherwise(0).cast("bigint").alias("n_bare"))
            .select(id_col, "_w.*", "_l.*", "_a.*", "word_chars", "n_symbols", "n_bare"))


def rules() -> dict[str, tuple[Column, Column]]:
    """name -> (votes bad, votes good); neither: the rule abstains."""
    c = F.col
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    many = c("n_words") >= 50
    symbols, letters, upper = per("n_symbols", "n_words"), per("n_letters", "word_chars"), per("n_upper", "n_letters")
    size, repeat, distinct = per("word_chars", "n_words"), per("n_repeat_words", "n_words"), per("n_distinct", "n_words")
    dup, bare = per("n_dup_lines", "n_lines"), per("n_bare", "n_words")
    some = c("n_words") > 0
    return {
        "symbols": (some & (symbols > 0.3), some & (symbols < 0.05)),
        "letters": (some & (letters < 0.65), some & (letters > 0.85)),
        "capitals": (some & (upper > 0.5), some & (upper < 0.15)),
        "word_length": (some & ((size < 2.5) | (size > 14)), some & (size > 3.5) & (size < 10)),
        "repeats": (some & (repeat > 0.3), many & (repeat < 0.15)),
        "distinct": (many & (distinct < 0.12), many & (distinct > 0.3)),
        "bare": (some & (bare > 0.15), some & (bare < 0.02)),
        "lines": ((c("n_lines") >= 5) & (dup > 0.4), (c("n_lines") >= 5) & (dup < 0.15)),
    }


def votes(frame: DataFrame) -> DataFrame:
    return frame.withColumns({f"vote_{k}": F.when(bad, BAD).when(good, GOOD).otherwise(NONE) for k, (bad, good) in rules().items()})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict:
    """EM over (votes, count). Returns the share of bad documents and each rule's rates of bad
    votes among bad and good ones. Start: a document with a bad vote is probably bad."""
    n_rules = len(patterns[0][0]) if patterns else 0
    posterior = [0.8 if BAD in v else 0.05 for v, _ in patterns]
    prior, rates = 0.1, [(0.5, 0.05)] * n_rules
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = min(0.95, max(0.01, (1 + sum(p * n for p, (_, n) in zip(posterior, patterns))) / (10 + total)))
        rates = []
        for j in range(n_rules):
            cast = [(p, n, v[j] == BAD) for p, (v, n) in zip(posterior, patterns) if v[j] != NONE]
            among_bad = (1 + sum(p * n for p, n, b in cast if b)) / (2 + sum(p * n for p, n, _ in cast))
            among_good = (0.05 + sum((1 - p) * n for p, n, b in cast if b)) / (1 + sum((1 - p) * n for p, n, _ in cast))
            rates.append((max(among_bad, among_good), among_good))
        posterior = [1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds_bad(v, prior, rates))))) for v, _ in patterns]
    return {"prior": prior, "rates": rates}


def log_odds_bad(vote: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    out = math.log(prior / (1 - prior))
    for v, (b, g) in zip(vote, rates):
        if v != NONE:
            out += math.log(b / g) if v == BAD else math.log((1 - b) / (1 - g))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """One row per input row: id, features, base_failed, votes, quality (posterior), kept."""
    names = [f"vote_{k}" for k in rules()]
    voted = cut_lineage(votes(features(docs, id_col, text_col)))  # narrow; read twice below
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]  # at most 3 ** rules rows
    model = estimate(sorted(patterns))
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, (b, g) in zip(names, model["rates"]):
        odds = odds + F.when(F.col(name) == BAD, math.log(b / g)).when(F.col(name) == GOOD, math.log((1 - b) / (1 - g))).otherwise(0.0)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(odds)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
