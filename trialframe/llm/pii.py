"""Personal data: patterns, and terms that disclose what the patterns found.

The patterns are ``email``, ``ip``, ``card`` and ``phone``. Protected entities are the values
found and, since most occur once, the broader things that they tell of: an address's domain,
an IP's network of 16 bits, a card's issuer (six digits), a number's country and area (four).

A term is a word of two characters or more that no pattern's match touches. Its disclosure of an entity is their
pointwise mutual information over documents, log2(N * n(e,t) / (n(e) * n(t))), as a share of
the entity's own information, log2(N / n(e)): 1 means that the term occurs nowhere without it.
n(e,t) counts the documents that have both, anywhere. A term discloses from a share of
``DISCLOSE`` on, if its co-occurrences aren't chance: n(e,t) * log2(N / n(e)) must reach
log2 of the number of terms that occur in two documents or more, and ``SURE`` bits, so that one entity in
2^SURE is expected to have one such term by chance. So the support that is asked for follows
from the counts, and is two where entities are rare.

Each term has a class, its first ``STEM`` characters, whose disclosure is estimated from the same
counts. A disclosing term is generalised to its class (``zebrafish`` to ``zeb*``) where the
class stays below the threshold for every entity, and removed where it does not. Both happen wherever the
term occurs, in documents without the entity too.

All counts cover all documents (rows); n(t) is pre-aggregated before the shuffle. Entities that occur in the
same documents are one entity in the counts, and a term that occurs in too many documents
to reach the threshold with an entity isn't paired with it, so a document with very many
values pairs its terms with few entities. Entities, terms and pairs are joined by shuffles
that can be split, never collected.

DataFrame expressions only. Defined cases: null text counts as "", which has no spans; a
text of any length is scanned whole, in time in proportion; repeated rows are documents of
their own in the counts and return a row each, with a null doc_id too; spans that start together are ordered by kind; an
empty table gives an empty result; other columns are not read. Words with U+FFFF are no terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_rows, written
from .spans import by_kind, let, masked, number_of, placed, replaced, starts, written_as

KINDS = ("email", "ip", "card", "phone", "removed", "general")
DISCLOSE, SURE, STEM = 0.9, 3, 3
#: Stands for the characters of a pattern's match while terms are looked for.
MARK = "\uffff"
#: Up to so many disclosing terms are sent to all tasks; beyond, words are joined to them by a shuffle.
BROADCAST_TERMS = 1_000_000
SEPARATOR = r"[\x20\x09-\x0D]"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _byte_parts(m: Column) -> Column:
    short = F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3)
    return F.when(short, F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")).cast("int"), F.lit(0)) <= 255)).otherwise(False)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(m)
    n = F.length(d)

    def value(i: Column) -> Column:  # i counts from the last digit
        x = d.substr(n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).when(x < 5, x * 2).otherwise(x * 2 - 9)

    return F.when((n >= 16) & (n <= 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    return F.concat(
        placed(text, EMAIL, 0, lambda m: F.lit(True), text.contains("@")),
        placed(text, IP, 1, _byte_parts, text.contains(".")),
        placed(text, CARD, 2, _luhn, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
        placed(text, PHONE, 3, lambda m: F.length(_digits(m)).between(8, 15), text.contains("+")),
    )


def entities(spans: Column) -> Column:
    """Of each base span its value and its class, as text with the kind and the level in front; each once."""
    value = lambda s: F.lower(s["value"])
    digits = lambda s, n: F.left(_digits(s["value"]), F.lit(n))
    broader = lambda s: F.when(s["kind"] == 0, F.substring_index(value(s), "@", -1)).when(s["kind"] == 1, F.substring_index(value(s), ".", 2)).when(s["kind"] == 2, digits(s, 6)).otherwise(digits(s, 4))
    named = lambda s, level, v: F.concat_ws(":", s["kind"].cast("string"), F.lit(level), v)
    return F.array_distinct(F.concat(F.transform(spans, lambda s: named(s, "value", value(s))), F.transform(spans, lambda s: named(s, "class", broader(s)))))


def _token(word: Column, is_term) -> Column:
    """63 bits of the hash of a term or of a class; the last bit tells which it is."""
    return F.xxhash64(word).bitwiseAND(F.lit(-2)).bitwiseOR(is_term.cast("bigint") if isinstance(is_term, Column) else F.lit(int(is_term)))


def _class(word: Column) -> Column:
    return F.left(word, F.lit(STEM))


def _tokens(text: Column) -> Column:
    """Two structs: the distinct words (is_term), and the distinct classes of those with two characters or more."""
    classes = F.regexp_extract_all(text, F.lit(rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{2,{STEM}}}+"), F.lit(0))
    return F.explode(F.array(*(F.struct(F.lit(k).alias("is_term"), F.array_distinct(a).alias("values")) for k, a in ((True, F.split(text, SEPARATOR)), (False, classes)))))


def disclosing(docs: DataFrame, found: DataFrame, disclose: float = DISCLOSE, sure: float = SURE) -> DataFrame:
    """term (a hash) and ``removed`` of the terms that disclose an entity; ``found``: the rows with base spans, and their text with these masked."""
    key = F.xxhash64("doc_id", "hash")
    tokens = docs.select(_tokens(F.col("text")).alias("x")).select("x.is_term", F.explode("x.values").alias("v")).filter(F.length("v") > 1).select(_token(F.col("v"), F.col("is_term")).alias("t"))
    total = docs.count()
    own = written(found.select(key.alias("d"), F.xxhash64("hash", "doc_id").alias("d2"), F.explode(entities(F.col("base"))).alias("e")).select("d", "d2", F.xxhash64("e").alias("e")).groupBy("d", "d2", "e").agg(F.count("*").alias("w")), "entities")
    same = own.groupBy("e").agg(F.sum("w").alias("n_e"), F.bit_xor("d").alias("x"), F.bit_xor("d2").alias("y")).filter(F.col("n_e").between(2, total - 1))
    kept = written(same.groupBy("n_e", "x", "y").agg(F.min("e").alias("r")).select("n_e", "r"), "kept")
    largest = kept.agg(F.max("n_e")).first()[0] or 0
    most = lambda n: F.pow(F.lit(float(max(total, 1))), F.lit(1 - disclose)) * F.pow(n.cast("double"), F.lit(disclose)) + 1e-6
    counted = written(tokens.groupBy("t").agg(F.count("*").alias("n_t")).filter("n_t > 1"), "counted")
    words = found.select(key.alias("d"), F.explode(F.array_distinct(F.split("masked", SEPARATOR))).alias("v")).filter((F.length("v") > 1) & ~F.contains("v", F.lit(MARK)))
    in_docs = words.select("d", _token(F.col("v"), True).alias("t"), _token(_class(F.col("v")), False).alias("c"))
    rare = counted.filter(F.col("n_t") <= most(F.lit(largest)))
    in_docs = in_docs.select("d", F.explode(F.array(F.struct("t", F.col("c").alias("of")), F.struct(F.col("c").alias("t"), F.lit(None).cast("long").alias("of")))).alias("x")).select("d", "x.*").distinct()
    near = in_docs.join(rare, "t")
    pairs = near.join(own.join(kept, F.col("e") == F.col("r")).select("d", "r", "w", "n_e"), "d").filter(F.col("n_t") <= most(F.col("n_e")))
    joint = pairs.groupBy("r", "t", "of", "n_e", "n_t").agg(F.sum("w").alias("n_et"))
    bits = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    share = F.log2(F.lit(float(max(total, 1))) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t"))) / bits
    terms = counted.filter(F.col("t").bitwiseAND(F.lit(1)) == 1).count()
    chance = F.log2(F.lit(float(max(terms, 1)))) + sure
    strong = written(joint.filter((share >= disclose) & (F.col("n_et") * bits >= chance)).select("t", "of").distinct(), "strong")
    classes = strong.filter("of is null").select(F.col("t").alias("c"), F.lit(True).alias("removed"))
    return strong.filter("of is not null").join(classes, F.col("of") == F.col("c"), "left").select(F.col("t").alias("term"), F.coalesce("removed", F.lit(False)).alias("removed"))


def _marks(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Of each row with disclosing terms: d, h and places, the numbers of its words that are such terms and what becomes of them."""
    terms = written(terms, "terms")
    n = terms.count()
    words = rows.select("doc_id", "hash", F.posexplode(F.split("text", SEPARATOR, -1)).alias("i", "w")).filter(F.length("w") > 1)
    hits = words.join(F.broadcast(terms) if n <= BROADCAST_TERMS else terms, _token(F.col("w"), True) == F.col("term"))
    return hits.groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(F.collect_set(F.struct("i", "removed")).alias("places"))


def _method(text: Column, places: Column, base: Column) -> Column:
    """Spans of the words at ``places``, if no base span touches them."""
    span = lambda p, words, at: F.struct(F.when(p["removed"], 4).otherwise(5).alias("kind"), F.get(at, p["i"]).alias("start"), (F.get(at, p["i"]) + F.length(F.get(words, p["i"]))).alias("end"))
    free = lambda words: F.filter(places, lambda p: ~F.contains(F.get(words, p["i"]), F.lit(MARK)))
    return let(F.split(masked(text, base, MARK), SEPARATOR, -1), lambda words: let(starts(words), lambda at: F.transform(free(words), lambda p: span(p, words, at))))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def personal_data(docs: DataFrame) -> DataFrame:
    """Each row of ``docs``: doc_id, text, base (array of spans), spans (base and method's, by kind then start)."""
    rows = text_rows(docs).withColumn("hash", F.xxhash64("text"))
    marked = rows.withColumn("base", base_spans(F.col("text")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    # rows that have spans are written once
    found = written(marked.filter(F.size("base") > 0).select("doc_id", "hash", "base", masked(F.col("text"), _plain(F.col("base")), MARK).alias("masked")), "found")
    marks = _marks(rows, disclosing(rows, found))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    once = found.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "base").dropDuplicates(["d", "h"])
    out = rows.join(once, same, "left").drop("d", "h").join(marks, same, "left")
    base = F.coalesce("base", none)
    method = F.when(F.col("places").isNull(), F.array().cast("array<struct<kind:int,start:int,end:int>>")).otherwise(_method(F.col("text"), F.col("places"), _plain(base)))
    return out.select("doc_id", "text", base.alias("base"), by_kind(F.concat(_plain(base), method)).alias("spans"))


def _label(span: Column, value: Column) -> Column:
    fixed = F.array(*(F.lit(n) for n in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[REMOVED]")))
    return F.when(span["kind"] == 5, F.concat(_class(value), F.lit("*"))).otherwise(F.get(fixed, span["kind"]))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text with personal data labelled and terms removed or generalised, counts, the digest of the base spans and all spans."""
    found = personal_data(docs)
    return found.select(
        "doc_id",
        replaced(F.col("text"), F.col("spans"), _label).alias("clean_text"),
        *(number_of(F.col("spans"), k).alias(f"n_{n}") for k, n in enumerate(KINDS)),
        F.sha2(written_as(by_kind(F.col("base")), KINDS), 256).alias("base_sha256"),
        written_as(F.col("spans"), KINDS).alias("spans"),
    )
