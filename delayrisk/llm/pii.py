"""Personal data: pattern spans, and terms whose co-occurrence gives an entity away.

Base spans are the leftmost non-overlapping matches of four patterns (email,
ip, card, phone), each checked as a whole.  A protected entity is the value of
such a span.  Over the distinct texts of the corpus (copies tell nothing new) a
term t discloses the share of the entity's information

    PMI(t; e) / IC(e) = log(p(t, e) / (p(t) p(e))) / -log p(e)

with p the share of texts that hold the term, the entity, or both, anywhere.
Terms that share at least ``min_together`` texts with the entity and disclose
``threshold`` of it or more are spans too (kind ``term``) at every place in the
texts that hold the entity.  A term is a run of two or more letters and digits
with a letter in it.  ``sanitise`` generalises base spans to their kind and
removes disclosing terms.

Everything here is DataFrame work.  What a term says of an entity depends only
on the two sets of texts that hold them, so entities with the same texts are
one class, as are terms, and only classes are paired: a list of addresses that
stands in two texts is one class, not a pair for each address and word.  A term
in more than D^(1-threshold) * n^threshold of D texts can't disclose an entity
of n texts, so frequent words never meet an entity; this drops no answer.
Sets are told apart by their size and 128 bits, texts by 128 bits.

Defined cases: a null or empty text has no spans; a match that fails its check
is dropped without a second try; spans of different kinds may overlap;
repeated rows get the spans of their text each; a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage, text_or_empty

# The patterns of the four kinds, in the order of their listing.
# Possessive repeats keep Java's matcher iterative on very long runs, and the
# guard in front (a run's first character, or where the last match ended)
# keeps it from trying every character of a run; neither changes a match.
_NAME = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
SPAN = "struct<start:int,end:int,kind:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check (zeros in front change nothing)."""
    d = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for k in range(20):
        x = F.substring(d, k + 1, 1).cast("int")
        # From the right the second, fourth ... digit doubles: positions 0, 2 ... of 20.
        total = total + (F.when(x > 4, 2 * x - 9).otherwise(2 * x) if k % 2 == 0 else x)
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^[0-9]{0,3}$")
                        & (F.substring(F.concat(F.lit("0"), p), -4, 4).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


#: Items by which an array grows: item by item, it would be copied for each.
GROW = 1024
#: Code points of the pieces that a long text is cut into before parts of it are taken.
CUT = 4096


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _scan(items: Column, advance, emit, kind: str) -> Column:
    """(at, out): ``items`` walked from place 0; ``out`` is the array of ``emit(at, item)``."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def blocks(x):
        last = F.ceil(F.size(x) / GROW).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(x, k * GROW + 1, GROW))

    def walk(acc, block):
        return F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), lambda a, x: F.struct(
            advance(a["at"], x).alias("at"), F.concat(a["out"], F.array(emit(a["at"], x))).alias("out")))
    return F.aggregate(
        _let(items, blocks), F.struct(F.lit(0).alias("at"), nones.alias("out")),
        lambda acc, block: _let(walk(acc, block), lambda w: F.struct(
            w["at"].alias("at"), F.concat(acc["out"], F.array(w["out"])).alias("out"))),
        lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def _places(text: Column, pattern: str, kind: int) -> Column:
    """Matches with their places, which come from the lengths of matches and of what is between."""
    pieces = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.arrays_zip(
        found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("b")))
    after = lambda at, p: at + F.length(p["b"]) + F.length(p["m"])
    return _scan(pieces, after, lambda at, p: F.struct(
        (at + F.length(p["b"])).alias("start"), after(at, p).alias("end"),
        F.lit(kind).alias("kind"), p["m"].alias("value")), SPAN)["out"]


def _spans_of(kind: str, text: Column) -> Column:
    """Array of spans of one kind."""
    return F.filter(_places(text, PATTERNS[kind], KINDS.index(kind)), lambda s: _holds(kind, s["value"]))


#: Letters and digits that stand alone: not a part of an address or a longer token.
TERM = (r"(?<![\p{L}\p{M}\p{N}._%+@-])(?=\p{N}*+\p{L})[\p{L}\p{M}\p{N}]{2,}+"
        r"(?![_%+@-]|\.[\p{L}\p{N}])")
_GATES = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
          "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    empty = F.array().cast(f"array<{SPAN}>")
    each = [F.when(_GATES[k](text), _spans_of(k, text)).otherwise(empty) for k in PATTERNS]
    order = F.transform(F.concat(*each), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
    return F.array_sort(order)


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda m: F.lower(m)))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g")]


TEXT = ["h", "g"]         # a text
SET = ["n", "x", "y"]     # a set of texts: its size and 128 bits


def _set_of() -> list[Column]:
    """Bits that tell sets of distinct texts apart."""
    return [F.bit_xor(F.xxhash64(*TEXT, F.lit(k))).alias(c) for k, c in ((2, "x"), (3, "y"))]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stage (h, g, t, base) per distinct text."""
    t = text_or_empty(text)
    rows = docs.select(*_text_key(t), t.alias("t")).groupBy(*TEXT).agg(F.first("t").alias("t"))
    return stage(rows.withColumn("base", base_spans(F.col("t"))), "spans")


def disclosing(found: DataFrame, threshold: float = 0.9, min_together: int = 2) -> DataFrame:
    """(h, g, term): the terms of each text that give an entity of it away."""
    total = float(found.count())
    held = found.filter(F.size("base") > 0)
    entities = (held.select(*TEXT, F.explode("base").alias("s")).select(*TEXT, "s.kind", "s.value").distinct())
    sets = (entities.groupBy("kind", "value").agg(F.count("*").alias("n"), *_set_of())
            .filter(F.col("n") >= min_together))
    # Classes of entities with the same texts: one row per class and text.
    entity_sets = stage(entities.join(sets, ["kind", "value"]).select(*TEXT, *SET).distinct(), "entities")
    most = entity_sets.agg(F.max("n")).first()[0] or 0
    limit = lambda n: F.pow(F.lit(total), F.lit(1 - threshold)) * F.pow(n, F.lit(threshold)) * (1 + 1e-9)
    counts = (found.select(F.explode(_terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
              .filter((F.col("n") >= min_together) & (F.col("n") <= limit(F.lit(most)))))
    terms = stage(held.join(entity_sets.select(*TEXT).distinct(), TEXT, "left_semi")
                  .select(*TEXT, F.explode(_terms(F.col("t"))).alias("term")).join(counts, "term"), "terms")
    term_sets = terms.join(terms.groupBy("term").agg(*_set_of()), "term").select(*TEXT, "term", *SET)
    as_ = lambda p: [F.col(c).alias(p + c) for c in SET]
    e, t = [f"e{c}" for c in SET], [f"t{c}" for c in SET]
    held_by = entity_sets.select(*TEXT, *as_("e"))
    together = (term_sets.select(*TEXT, *as_("t")).distinct()
                .join(held_by, TEXT).filter(F.col("tn") <= limit(F.col("en"))))
    share = (F.log(F.col("both") * F.lit(total) / (F.col("tn") * F.col("en").cast("double")))
             / F.log(F.lit(total) / F.col("en")))
    reveal = (together.groupBy(*e, *t).agg(F.count("*").alias("both")).filter(F.col("both") >= min_together)
              .withColumn("disclosed", F.when(F.col("en") < total, share).otherwise(F.lit(0.0)))
              .filter(F.col("disclosed") >= threshold).select(*e, *t))
    marked = together.join(reveal, [*e, *t], "left_semi").select(*TEXT, *t).distinct()
    return term_sets.select(*TEXT, "term", *as_("t")).join(marked, [*TEXT, *t]).select(*TEXT, "term")


def term_spans(found: DataFrame, reveal: DataFrame) -> DataFrame:
    """(h, g, terms): the spans of disclosing terms per text."""
    reveal = stage(reveal, "disclosing")
    places = _places(F.col("t"), TERM, KINDS.index("term"))
    at = (found.filter(F.size("base") > 0).join(reveal.select(*TEXT).distinct(), TEXT, "left_semi")
          .select(*TEXT, F.explode(places).alias("s")).select(*TEXT, F.lower("s.value").alias("term"), "s"))
    return (at.join(reveal, [*TEXT, "term"]).groupBy(*TEXT).agg(F.collect_list(
        F.struct("s.start", "s.kind", "s.end", F.col("term").alias("value"))).alias("terms")))


def text_spans(docs: DataFrame, text: str = "text", threshold: float = 0.9, min_together: int = 2) -> DataFrame:
    """(h, g, base, terms) per distinct text that has spans: sorted arrays of (start, kind, end, value)."""
    found = find(docs, text)
    extra = term_spans(found, disclosing(found, threshold, min_together))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return (found.filter(F.size("base") > 0).select(*TEXT, "base").join(extra, TEXT, "left")
            .select(*TEXT, "base", F.array_sort(F.coalesce("terms", none)).alias("terms")))


def spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(i, base, terms) per row of ``docs``: sorted arrays of (start, kind, end, value)."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return (docs.select(F.col(id_col).alias("i"), *_text_key(text_or_empty(text)))
            .join(text_spans(docs, text, **options), TEXT, "left")
            .select("i", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms")))


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def _part(cuts: Column, first: Column, end: Column) -> Column:
    """Code points ``first`` to ``end`` (exclusive) of a text cut into pieces of ``CUT``."""
    def taken(k):
        skip = F.greatest(first - k * CUT, F.lit(0))
        return F.substring(cuts[k], skip + 1, F.least(end - k * CUT, F.lit(CUT)) - skip)
    piece = lambda at: F.floor(at / CUT).cast("int")
    return F.when(end > first, F.array_join(F.transform(F.sequence(piece(first), piece(end - 1)), taken), "")).otherwise("")


def _generalised(text: Column, marks: Column) -> Column:
    """The text with each mark (by start; what an earlier one covers is passed) in place of what it covers."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS], F.lit(""))

    def of(cuts):
        walked = _scan(marks, lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(
            s["start"] >= at, F.concat(_part(cuts, at, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(""), "string")
        return _let(walked, lambda w: F.concat(F.array_join(w["out"], ""), _part(cuts, w["at"], F.length(text))))
    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), of)


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with base spans generalised to their kind ("[EMAIL]") and disclosing terms removed."""
    keys, marks = [fresh(docs, f"_key{k}") for k in range(2)], fresh(docs, "_marks")
    place = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    found = text_spans(docs, text, **options).select(
        F.col("h").alias(keys[0]), F.col("g").alias(keys[1]), F.array_sort(F.concat(place("base"), place("terms"))).alias(marks))
    rows = docs.select("*", *[c.alias(k) for c, k in zip(_text_key(text_or_empty(text)), keys)])
    return (rows.join(found, keys, "left")
            .withColumn(text, F.when(F.col(marks).isNull(), F.col(text)).otherwise(_generalised(F.col(text), F.col(marks))))
            .select(*docs.columns))
