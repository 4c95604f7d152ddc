"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Base spans are matches of four patterns (email, ip, card, phone) with their checks. Around each base
span, terms that give its value (the protected entity) away are found from the corpus: with n(e)
documents that hold the entity, n(t) that hold the term, n(t,e) that hold both, wherever they stand,
and N in all, the disclosure of e by t is its pointwise mutual information as a share of the
entity's information content,

    log(N n(t,e) / (n(t) n(e))) / log(N / n(e)),

1 if the term occurs in no document without the entity. Terms from `generalise_at` on are replaced by
a general word, from `remove_at` on removed.

Most entities stand in one text, which alone can't tell a telling word from any other. So every span
protects three entities: its value, the group its value belongs to (address domain, network, issuer,
area code), and its kind; counts are pooled over a group's and a kind's members. A pair must be met
nearby in two different texts (copies of one text prove nothing) and carry evidence: with p = n(e) / N
and r = n(t,e) / n(t), the chance that an unrelated term has that share of its documents with the entity
is at most exp(-texts * KL(r, p) / r), and this times the number of pairs tried must be under 1.
So there is no fixed count: two texts are enough for a rare entity, more are asked for a common one.
All counts cover all documents. Near means: a whole word of `min_letters` letters or more inside
`reach` characters of the span. Nearness only proposes pairs, so the pairs of a document grow with its
spans, never with their square; counts are of whole documents, and a term that gives an entity away is
replaced everywhere in the documents that hold the entity.

Native throughout. Positions come from a pattern's matches and the pieces between them (one scan
finds matches, a second runs only where there are some). Patterns are written so that a run of
letters or digits is tried once from its start: linear on texts without spaces. What lies around and
between spans is cut from pieces of a text, so the work on a text grows with its length and its spans,
not with their product. Rows are scanned
once into narrow spans and contexts at the shared checkpoint folder; copies are folded before every
shuffle.

Defined cases: null text = empty, no spans; repeated rows and ids are judged row by row (spans
follow from id and text); two kinds may overlap, `sanitise` replaces their union by the first's
word; an empty table gives an empty result; extra columns pass through `sanitise` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table
from .common import let, text_or_empty

#: The contract's patterns, possessive and anchored to the start of a run; same matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9][0-9])(?=(?:[\x20-]?[0-9]){11})(?:[\x20-]?[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<=[\s\"'(])\p{{L}}{{{n},}}+(?=[.,;:!?\"')]*+\s)"
LETTERS = r"\p{{L}}{{{n},}}+"
KINDS = ["email", "ip", "card", "phone", "term"]
WORD_FOR = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string,value:string>"
BLOCK = 256
#: Characters of a text that are cut out together, so that a place in a long text is found without walking it.
CUT = 1024
#: Parts into which the rows of one entity are dealt in a join.
SALTS = 16


def _running(values: Column, plus=lambda a, b: a + b) -> Column:
    """Inclusive running sums (from 0) of an array, in blocks, so that long arrays take no quadratic time."""
    empty = F.array().cast("array<bigint>")
    step = lambda a, x: F.struct(plus(a["sum"], x).alias("sum"), F.concat(a["all"], F.array(plus(a["sum"], x))).alias("all"))
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), empty.alias("all"))
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")),
                                   lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, BLOCK), zero, step))
    # sums of all blocks before each
    before = lambda bs: F.aggregate(bs, zero, lambda a, b: F.struct(
        plus(a["sum"], b["sum"]).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")))["all"]
    joined = lambda bs: let(before(bs), lambda at: F.flatten(F.transform(
        bs, lambda b, i: F.transform(b["all"], lambda x: plus(x, F.get(at, i))))))
    return F.when(F.size(values) == 0, empty).otherwise(let(values, lambda x: let(blocks(x), joined)))


def _pieces(text: Column) -> Column:
    """The text in pieces of CUT code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}+"), F.lit(0))


def _cut(pieces: Column, frm: Column, to: Column) -> Column:
    """The code points from `frm` up to `to` of the text that the pieces make up."""
    first, last = F.floor(frm / CUT).cast("int"), F.floor((to - 1) / CUT).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(part, (frm - first * CUT + 1).cast("int"), F.greatest(to - frm, F.lit(0)).cast("int"))


def located(text: Column, pattern: str, guard: str | None = None) -> Column:
    """array<struct<start,end,value>> of a pattern's matches, in code points, end exclusive."""
    size = lambda x: F.length(x).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if guard:
        found = F.when(text.contains(guard), found).otherwise(F.array().cast("array<string>"))

    def place(m):
        lengths = let(F.split(text, pattern, -1), lambda gaps: F.transform(m, lambda x, i: size(F.get(gaps, i)) + size(x)))
        return let(_running(lengths), lambda ends: F.transform(m, lambda x, i: F.struct(
            (F.get(ends, i) - size(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("value"))))

    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(place(m)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def _ip_ok(v: Column) -> Column:
    part = lambda p: F.coalesce(F.when(F.length(p) <= 3, p.try_cast("int")).otherwise(256), F.lit(0))
    return F.forall(F.split(v, r"\.", -1), lambda p: part(F.regexp_replace(p, "^0+", "")) <= 255)


def _card_ok(v: Column) -> Column:
    def luhn(d):
        return F.aggregate(F.split(F.reverse(d), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), lambda a, c: F.struct(
            (a["sum"] + F.when(a["i"] % 2 == 1, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("int")).alias("sum"),
            (a["i"] + 1).alias("i")))["sum"] % 10 == 0
    return let(_digits(v), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


def _phone_ok(v: Column) -> Column:
    return F.length(_digits(v)).between(9, 15)


def base_spans(text: Column) -> Column:
    """array<SPAN> of the four base kinds by start, then kind as listed."""
    def kind(name, found, ok=None, key=lambda v: v):
        kept = F.filter(found, lambda s: ok(s["value"])) if ok else found
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("ord"), s["end"].alias("end"),
                                                    F.lit(name).alias("kind"), key(s["value"]).alias("value")).cast(SPAN))
    return F.array_sort(F.concat(kind("email", located(text, EMAIL, "@"), key=F.lower), kind("ip", located(text, IP), _ip_ok),
                                 kind("card", located(text, CARD), _card_ok, _digits), kind("phone", located(text, PHONE, "+"), _phone_ok, _digits)))


def _names(kind: Column, value: Column) -> Column:
    """The entities a span protects: its value, the group of values it belongs to, its kind."""
    group = (F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
             .when(kind == "ip", F.substring_index(value, ".", 3))
             .when(kind == "card", F.substring(value, 1, 6)).otherwise(F.substring(value, F.lit(1), F.length(value) - 7)))
    return F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit("-group:"), group), F.concat(F.lit("kind:"), kind))


def _contexts(text: Column, spans: Column, reach: int, min_letters: int) -> Column:
    """array<struct<entity,term>>: the whole words near each span, for each of its entities."""
    pattern = TERM.format(n=min_letters)
    padded = F.when(F.size(spans) > 0, F.concat(F.lit(" "), text, F.lit(" "))).otherwise("")

    def near(pieces):
        def window(frm, to):  # of the text between two spaces; frm and to in its code points
            return F.transform(F.regexp_extract_all(_cut(pieces, frm, to), F.lit(pattern), F.lit(0)), F.lower)

        def around(s):
            left = F.greatest(s["start"] - reach, F.lit(0).cast("bigint"))
            words = F.array_distinct(F.concat(window(left, s["start"] + 1), window(s["end"] + 1, s["end"] + 1 + reach)))
            return let(words, lambda ws: F.flatten(F.transform(_names(s["kind"], s["value"]), lambda e: F.transform(
                ws, lambda w: F.concat(e, F.lit("\n"), w)))))

        # strings are told apart by hash, structs pair by pair; neither entities nor terms hold a line feed
        return F.transform(F.array_distinct(F.flatten(F.transform(spans, around))), lambda x: F.struct(
            F.substring_index(x, "\n", 1).alias("entity"), F.substring_index(x, "\n", -1).alias("term")))

    return let(_pieces(padded), near)


def _text_hash(text: Column) -> Column:
    """128 bits, so that no two different texts of a corpus share one."""
    return F.unhex(F.md5(text))


def _dealt(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """The join on `key`, the rows of one key dealt over SALTS tasks by `by`: a kind, or the domain of
    a third of all addresses, is in as many texts as there are."""
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 100, min_letters: int = 4) -> DataFrame:
    """One narrow row per input row: _id, _text_hash, base (array<SPAN>), near (contexts), held (the
    text if it has spans, else null)."""
    text = text_or_empty(text_col)
    both = let(base_spans(text), lambda b: F.struct(b.alias("base"), _contexts(text, b, reach, min_letters).alias("near"),
                                                    F.when(F.size(b) > 0, text).alias("held")))
    return docs.select(F.col(id_col).alias("_id"), _text_hash(text).alias("_text_hash"), both.alias("_s")).select("_id", "_text_hash", "_s.*")


def _words(text: Column, min_letters: int) -> Column:
    """array<string>: the distinct letter runs of a text that can be terms, wherever they stand."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LETTERS.format(n=min_letters)), F.lit(0)), F.lower))


def folded(scanned: DataFrame, min_letters: int = 4) -> DataFrame:
    """One row per different text that has spans: _text_hash, held, copies, entities, near, words."""
    named = F.array_distinct(F.flatten(F.transform("base", lambda s: _names(s["kind"], s["value"]))))
    return cut_lineage(scanned.where("held is not null").groupBy("_text_hash").agg(
        F.first("held").alias("held"), F.count(F.lit(1)).alias("copies"), F.first("base").alias("base"), F.first("near").alias("near"))
        .select("_text_hash", "held", "copies", named.alias("entities"), "near", _words(F.col("held"), min_letters).alias("words")))


def _together(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_text_hash, copies, entity, term): the pairs that each text holds, however far apart. Of an
    entity's terms and a text's words the fewer are dealt out, so a text with many entities or an
    entity with many terms doesn't multiply."""
    known = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n_terms"))
    asked = _dealt(texts.select("_text_hash", "copies", F.size("words").alias("n_words"), F.explode("entities").alias("entity")),
                   known, "entity", "_text_hash")
    words = texts.select("_text_hash", F.explode("words").alias("term"))
    by_term = _dealt(asked.where("n_terms <= n_words"), pairs, "entity", "_text_hash").join(words, ["_text_hash", "term"], "left_semi")
    by_word = asked.where("n_terms > n_words").join(words, "_text_hash").join(pairs, ["entity", "term"], "left_semi")
    columns = ["_text_hash", "copies", "entity", "term"]
    return cut_lineage(by_term.select(*columns).unionByName(by_word.select(*columns)))


def _weighed(docs: DataFrame, scanned: DataFrame, texts: DataFrame, text_col: str, min_letters: int, min_texts: int,
             generalise_at: float) -> tuple[DataFrame, DataFrame]:
    """The pairs at or above the threshold, as `disclosing` returns them, and the pairs of each text."""
    n_docs = scanned.agg(F.count(F.lit(1)).alias("n_docs"))
    tried = cut_lineage(texts.select(F.inline("near")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("near_texts")))
    n_tried = tried.agg(F.count(F.lit(1)).alias("n_tried"))
    together = _together(texts, tried.where(F.col("near_texts") >= min_texts).select("entity", "term"))
    pairs = together.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    entities = texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_e"))
    terms = (docs.select(F.explode(_words(text_or_empty(text_col), min_letters)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    share = 1 - F.log(F.greatest(F.col("n_t") / F.col("n_te"), F.lit(1.0))) / F.log(F.col("n_docs") / F.col("n_e"))
    p, r = F.col("n_e") / F.col("n_docs"), F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))
    beside = F.when(r < 1, (1 - r) / r * F.log((1 - r) / (1 - p))).otherwise(0.0)
    proven = (r > p) & (F.col("texts") * (F.log(r / p) + beside) > F.log("n_tried"))
    found = (_dealt(pairs.join(terms, "term"), entities, "entity", "term").join(F.broadcast(n_docs)).join(F.broadcast(n_tried))  # one row each
             .where(F.col("n_e") < F.col("n_docs")).withColumn("disclosure", share)
             .where(F.col("disclosure") >= generalise_at).select("entity", "term", "disclosure", proven.alias("proven")))
    return found, together


def disclosing(docs: DataFrame, scanned: DataFrame, text_col: str = "text", min_letters: int = 4, min_texts: int = 2,
               generalise_at: float = 0.8) -> DataFrame:
    """(entity, term, disclosure, proven) of the pairs at or above the threshold; proven: the evidence
    is more than chance gives among all pairs tried."""
    return _weighed(docs, scanned, folded(scanned, min_letters), text_col, min_letters, min_texts, generalise_at)[0]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.95, **options) -> DataFrame:
    """One row per input row: _id, _text_hash, base, terms (array<struct<start,end,remove>> by start)."""
    options = {"min_letters": 4, "min_texts": 2, "generalise_at": 0.8, "reach": 100} | options
    letters = options["min_letters"]
    scanned = cut_lineage(scan(docs, id_col, text_col, options["reach"], letters))
    texts = folded(scanned, letters)
    known, together = _weighed(docs, scanned, texts, text_col, letters, options["min_texts"], options["generalise_at"])
    told = cut_lineage(together.join(known.where("proven"), ["entity", "term"]).groupBy("_text_hash", "term")
                       .agg((F.max("disclosure") >= remove_at).alias("remove")))
    places = (texts.join(told.select("_text_hash"), "_text_hash", "left_semi")
              .select("_text_hash", F.inline(located(F.col("held"), LETTERS.format(n=letters))))
              .select("_text_hash", "start", "end", F.lower("value").alias("term")).join(told, ["_text_hash", "term"])
              .groupBy("_text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "remove"))).alias("terms")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,remove:boolean>>")
    columns = ["_id", "_text_hash", "base"]
    return (scanned.where("held is not null").join(places, "_text_hash", "left").select(*columns, F.coalesce("terms", none).alias("terms"))
            .unionByName(scanned.where("held is null").select(*columns, none.alias("terms"))))


def _all_spans() -> Column:
    added = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("ord"), t["end"].alias("end"),
                                                    F.lit("term").alias("kind"), F.when(t["remove"], "").otherwise(WORD_FOR["term"]).alias("value")).cast(SPAN))
    return F.array_sort(F.concat("base", added))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return find(docs, id_col, text_col, **options).select(
        F.col("_id").alias(id_col), *[count(k) for k in KINDS[:4]], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(_all_spans()).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span's value put in its place; of overlapping spans the first's, once."""
    def pieced(pieces, covered):
        before = lambda i: F.coalesce(F.get(covered, i - 1), F.lit(0).cast("bigint"))
        parts = F.transform(spans, lambda s, i: let(before(i), lambda at: F.when(s["start"] < at, "").otherwise(
            F.concat(_cut(pieces, at, s["start"]), s["value"]))))
        return F.array_join(F.concat(parts, F.array(_cut(pieces, before(F.size(spans)), F.length(text).cast("bigint")))), "")

    ends = F.transform(spans, lambda s: s["end"])
    return let(_pieces(text), lambda p: let(_running(ends, F.greatest), lambda c: pieced(p, c)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The input rows, all of their columns; spans replaced in the text, its length column renewed."""
    found = find(docs, id_col, text_col, **options)
    words = F.create_map(*[F.lit(x) for k in KINDS[:4] for x in (k, WORD_FOR[k])])
    spans = F.transform(_all_spans(), lambda s: s.withField("value", F.when(s["kind"] == "term", s["value"]).otherwise(words[s["kind"]])))
    plan = (found.where((F.size("base") > 0) | (F.size("terms") > 0)).select("_id", "_text_hash", spans.alias("_spans"))
            .groupBy("_id", "_text_hash").agg(F.first("_spans").alias("_spans")))  # rows that repeat
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_row_id"),
                       _text_hash(text_or_empty(text_col)).alias("_here"))
    joined = rows.join(plan, rows["_row_id"].eqNullSafe(plan["_id"]) & (rows["_here"] == plan["_text_hash"]), "left")
    hit, old = F.col("_spans").isNotNull(), F.col("_row")[text_col]
    new = joined.select("_row", F.when(hit, replaced(old, F.col("_spans"))).otherwise(old).alias("_new"), hit.alias("_hit"))
    size = F.when(F.col("_hit"), F.length("_new")).otherwise(F.col("_row")[length_col]) if length_col in docs.columns else None
    values = {text_col: F.col("_new")} | ({length_col: size.cast(docs.schema[length_col].dataType)} if size is not None else {})
    return new.select(*[values.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op7_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(read_table(spark, sf_dir, "documents"))
