"""Personal data: patterned identifiers, and terms that give them away, by information-theoretic sanitisation.

Everything is DataFrame expressions. Emails, addresses, card and phone numbers are found by pattern, with offsets, in
each row. Then the corpus is asked which terms reveal such a value. For a value e and a term t,

    P(e) = documents with e / documents,   P(e | t) = documents with t within NEAR characters of e / documents with t,

and t discloses log2 P(e | t) / P(e) of the -log2 P(e) bits that e amounts to. A term that discloses at least the share
ALPHA of them, that is if P(e | t) >= P(e) ^ (1 - ALPHA), and stands near e in MIN_TEXTS different texts or more, is a span
of kind ``term`` wherever it stands. Sanitising generalises each span to the name of its kind.

Terms are runs of at least TERM_LETTERS letters, in lower case. Only terms that stand near one value in MIN_TEXTS texts,
and are not already too frequent in the documents with values, are counted in the rest of the corpus; that is a join by
term, of which Spark broadcasts the candidates or not by the size of their written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablediff.llm.common import once, shared_dir, spans_of, text_key, whole_text, written

# The kinds in order, and their patterns. Each is its plain form made safe for long runs: it can't
# start inside a run in which it would have started earlier, and gives nothing back where that can't help.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
ORDER = (*KINDS, TERM)
TERM_LETTERS = 4
NEAR = 96
ALPHA = 0.9
MIN_TEXTS = 3

# Words of the filter that keeps texts without a disclosing term from being moved: 1 MB.
FILTER_WORDS = 1 << 17

COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
FOUND = "array<struct<start:int,kind:int,end:int>>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # Leading zeros don't count; more than three digits are over 255 anyway.
        part = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":

        def luhn(reverse: Column) -> Column:
            digit = lambda i: F.substring(reverse, i, F.lit(1)).cast("int")
            double = lambda i: 2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)
            add = lambda a, i: a + F.when(i % 2 == 0, double(i)).otherwise(digit(i))
            return F.aggregate(F.sequence(F.lit(1), F.length(reverse)), F.lit(0), add) % 10 == 0

        return F.when(F.length(digits).between(12, 19), once(F.reverse(digits), luhn)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    """(start, kind, end) of the valid matches of one kind."""

    def checked(spans: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        named = lambda s, m: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), _valid(kind, m).alias("ok"))
        good = F.filter(F.zip_with(spans, matches, named), lambda x: x["ok"])
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return once(spans_of(text, PATTERNS[kind]), checked)


def base_spans(text: Column) -> Column:
    """All patterned spans (start, kind, end), by start, then kind."""
    none = F.array().cast(FOUND)
    email = F.when(F.contains(text, F.lit("@")), _of_kind(text, "email")).otherwise(none)
    numbers = F.concat(*[_of_kind(text, k) for k in KINDS[1:]])
    return F.sort_array(F.concat(email, F.when(text.rlike("[0-9]"), numbers).otherwise(none)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{TERM_LETTERS},}}"), F.lit(0)))


def _around(text: Column, span: Column) -> Column:
    """The terms within NEAR characters on either side of a span; a word cut by that limit is left out."""
    first = F.greatest(span["start"] - NEAR, F.lit(0))
    left = F.substring(text, first + 1, span["start"] - first)
    left = F.when(first > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.regexp_replace(F.substring(text, span["end"] + 1, F.lit(NEAR)), r"\p{L}+$", "")
    return _words(F.concat(left, F.lit(" "), right))


def _pairs(text: Column) -> Column:
    """The distinct (value, term) of a text: each value with the terms near it. A value is kept as its hash."""

    def of(span: Column) -> Column:
        own = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        plain = F.when(span["kind"] >= 2, F.regexp_replace(own, "[^0-9]", "")).otherwise(F.lower(own))
        value = F.xxhash64(F.concat_ws(":", span["kind"], plain))
        named = lambda v: F.transform(_around(text, span), lambda t: F.struct(v.alias("value"), t.alias("term")))
        return once(value, named)

    return F.array_distinct(F.flatten(F.transform(base_spans(text), of)))


def disclosing_terms(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Rows (term, k1, k2): the terms that disclose a value found in ``docs``, with the key of each text that holds them."""
    at = shared_dir(docs.sparkSession)
    text = whole_text(text_col)
    keyed = docs.select(*text_key(text), text.alias("text"))
    with_values = keyed.where(F.contains(text, F.lit("@")) | text.rlike("[0-9]"))
    near = with_values.select("k1", "k2", F.explode(_pairs(F.col("text"))).alias("p")).groupBy("k1", "k2", "p.value", "p.term")
    near = written(near.agg(F.count(F.lit(1)).alias("rows")), at + "/near")

    total = docs.count()
    per_value = near.groupBy("value", "k1", "k2").agg(F.max("rows").alias("rows"))
    per_value = per_value.groupBy("value").agg((F.sum("rows") / F.lit(float(max(total, 1)))).alias("prior"))
    both = near.groupBy("value", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("both"))
    both = both.where(F.col("texts") >= min_texts).join(per_value, "value").where(F.col("prior") < 1)
    # The most documents that a term may stand in and still disclose the share alpha of some value.
    most = F.col("both") / F.pow(F.col("prior"), F.lit(1 - alpha))
    both = both.groupBy("term").agg(F.max(most).alias("most"))
    candidates = written(both, at + "/candidates")

    # Documents with values alone give a lower bound of a term's frequency, which common words exceed; what is left is
    # looked for everywhere.
    there = with_values.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").count()
    rare = there.join(candidates, "term").where(F.col("count") <= F.col("most"))
    rare = written(rare.select("term", "most"), at + "/rare")
    holders = keyed.select("k1", "k2", F.explode(_words(F.col("text"))).alias("term")).join(rare, "term")
    holders = holders.groupBy("k1", "k2", "term").agg(F.count(F.lit(1)).alias("n"), F.first("most").alias("most"))
    holders = written(holders, at + "/holders")
    chosen = holders.groupBy("term").agg(F.sum("n").alias("n"), F.first("most").alias("most")).where("n <= most")
    return holders.select("k1", "k2", "term").join(chosen.select("term"), "term")


def _bitmap(keys: DataFrame) -> Column:
    """One bit for each value of k1 modulo 64 * FILTER_WORDS, as a scalar subquery: FILTER_WORDS longs, however many keys."""
    place = F.pmod("k1", F.lit(64 * FILTER_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = keys.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = keys.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "word").join(words, "word", "left")
    dense = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
    return dense.select(F.transform("w", lambda x: x["bits"])).scalar()


def _bit(words: Column, key: Column) -> Column:
    place = F.pmod(key, F.lit(64 * FILTER_WORDS))
    word = F.get(words, F.floor(place / 64).cast("int"))
    return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def find_pii(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, min_texts: int = MIN_TEXTS) -> DataFrame:
    """All rows and columns of ``docs`` with found, array of (start, kind, end) by start, then kind (replaced if there).

    kind is the place in ORDER. A term inside or across another span is not listed. Null and empty texts have no spans;
    repeated rows get the same spans; an empty table gives an empty table.
    """
    docs = docs.select([c for c in docs.columns if c != "found"])
    text = whole_text(text_col)
    terms = disclosing_terms(docs, text_col, alpha, min_texts)
    per_text = terms.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("term")).alias("__terms"))
    per_text = written(per_text, shared_dir(docs.sparkSession) + "/terms")
    k1, k2 = text_key(text)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    # Only texts whose bit is set meet the terms; the others keep the spans that they have by themselves.
    told = _bit(_bitmap(per_text), F.col("__k1"))
    plain = keyed.where(~told).withColumn("found", base_spans(text))
    joined = keyed.where(told).join(per_text.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")

    def with_terms(base: Column) -> Column:
        # Longest first does not matter: a term is a whole run of letters.
        any_of = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("__terms", "|"), F.lit(r")(?!\p{L})"))
        apart = lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        own = F.filter(spans_of(text, any_of), apart)
        named = F.transform(own, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
        return F.when(F.col("__terms").isNull(), base).otherwise(F.sort_array(F.concat(base, named)))

    found = joined.withColumn("found", once(base_spans(text), with_terms))
    return plain.select(*docs.columns, "found").unionByName(found.select(*docs.columns, "found"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == KINDS.index(kind)


def with_digest(found: DataFrame) -> DataFrame:
    """``found`` with COLUMNS: counts of the patterned kinds, their digest, and all spans as kind:start:end."""
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    counts = {f"n_{k}": F.size(F.filter("found", _is(k))).cast("long") for k in KINDS}
    return found.withColumns(
        counts | {"base_sha256": F.sha2(_joined(base), 256), "spans": _joined(F.col("found"))}
    )


def sanitise(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with each stretch of spans in the text replaced by the kind of its first span, in brackets."""
    text = whole_text(text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ORDER])
    start = F.array().cast(FOUND)

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        merged = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        overlap = (F.size(done) > 0) & F.coalesce(s["start"] < last["end"], F.lit(False))
        return F.when(overlap, merged).otherwise(F.concat(done, F.array(s)))

    def rebuilt(merged: Column) -> Column:
        after = lambda i: F.coalesce(F.get(merged, i - 1)["end"], F.lit(0))
        piece = lambda s, i: F.concat(F.substring(text, after(i) + 1, s["start"] - after(i)), F.get(names, s["kind"]))
        rest = F.substring(text, F.get(merged, F.size(merged) - 1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(merged, piece), ""), rest)

    clean = once(F.aggregate("found", start, step), rebuilt)
    return found.withColumn(text_col, F.when(F.size("found") > 0, clean).otherwise(F.col(text_col)))
