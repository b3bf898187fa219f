"""License scans: phrases at word positions, and ordered signature rules with suppression.

Everything is DataFrame expressions within a row. A text is reduced to its words; texts without any keyword go no
further. Of the rest, the rules whose keyword the text holds are tried. A detection inside another one's interval is
suppressed if the other has a smaller priority number, or the same and comes first (longest first at one place).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablediff.llm.common import once, spans_of, whole_text
from tablediff.llm.license_rules import FORMS, IDENTIFIERS, rules

# The phrases that are always looked for, and their labels.
PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
PHRASE_SCORE = 0.6

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A text without any of these holds no match of a rule. Each is within one word: a match's words may stand on several
# lines, or have any signs between them.
HINTS = ("licen", "spdx", "gpl", "cc", "commons", "domain", "reserved", "bsd", "mpl", "apache", "proprietary", "wtfpl", "attribution")
# Identifiers after "under", and a word of each of the licences' own sentences.
UNDER = rf"under{SEPARATORS}(?:(?:the|a|terms|of){SEPARATORS})*(?:{'|'.join(sorted({word for _, word, _ in IDENTIFIERS}))})"
OWN_WORDS = ("hereby", "redistribution", "liable", "warrant", "endorse", "advertising", "permission", "unencumbered", "fuck")

COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Where the phrase's words stand one after the other, counted from 0."""
    starts = F.sequence(F.lit(0), F.size(words) - 1)
    here = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(phrase)))
    found = F.filter(starts, lambda i: F.coalesce(here(i), F.lit(False)))
    return F.when(F.size(words) >= len(phrase), found).otherwise(F.array().cast("array<int>"))


def _detections(words: Column, rule: Column) -> Column:
    """(start, -end, priority, label, score) of each match of a rule, offsets in the text of words."""
    return F.transform(
        spans_of(words, rule["pattern"]),
        lambda s: F.struct(
            s["start"].alias("start"),
            (-s["end"]).alias("minus_end"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["confidence"].alias("score"),
        ),
    )


def _unsuppressed(found: Column) -> Column:
    """Labels and best score of the detections that stand after suppression; one pass over them in order of place."""
    levels = len(FORMS)
    start = F.struct(
        F.array_repeat(F.lit(-1), levels).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")
    )

    def step(state: Column, d: Column) -> Column:
        end = -d["minus_end"]
        inside = F.exists(F.slice(state["reach"], 1, d["priority"]), lambda r: r >= end)
        reach = F.transform(
            state["reach"], lambda r, i: F.when(i == d["priority"] - 1, F.greatest(r, end)).otherwise(r)
        )
        return F.struct(
            F.when(inside, state["reach"]).otherwise(reach).alias("reach"),
            F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, state["score"]).otherwise(F.greatest(state["score"], d["score"])).alias("score"),
        )

    return F.aggregate(F.sort_array(found), start, step)


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with COLUMNS (columns of these names are replaced).

    n_words; n_base, first_word, last_word: places of PHRASES, their smallest and largest start (null without one);
    base_labels: labels of the phrases found; labels: those and the rules' labels, both distinct, sorted, comma-joined;
    score: the best detection's confidence, 0 without a label. Null and empty texts have no words and empty labels.
    Repeated rows stay repeated rows.
    """
    kept = docs.select([c for c in docs.columns if c not in COLUMNS])
    text = whole_text(text_col)
    table = F.array(
        *[
            F.struct(
                F.lit(keyword).alias("keyword"),
                F.lit(label).alias("label"),
                F.lit(priority).alias("priority"),
                F.lit(confidence).alias("confidence"),
                F.lit(pattern).alias("pattern"),
            )
            for keyword, label, priority, confidence, pattern in rules()
        ]
    )
    nothing = F.struct(
        F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"),
        F.array().cast("array<string>").alias("base"),
        F.array().cast("array<string>").alias("rules"),
        F.lit(0.0).alias("score"),
    )

    def look(words: Column) -> Column:
        places = F.array(*[F.struct(_places(words, p).alias("at"), F.lit(label).alias("label")) for p, label in PHRASES])

        def detect(joined: Column, base: Column) -> Column:
            tried = F.filter(table, lambda r: F.contains(joined, r["keyword"]))
            found = F.flatten(F.transform(tried, lambda r: _detections(joined, r)))
            starts = F.flatten(F.transform(base, lambda b: b["at"]))
            return once(
                _unsuppressed(found),
                lambda s: F.struct(
                    F.size(starts).cast("long").alias("n_base"),
                    F.array_min(starts).cast("long").alias("first_word"),
                    F.array_max(starts).cast("long").alias("last_word"),
                    F.transform(F.filter(base, lambda b: F.size(b["at"]) > 0), lambda b: b["label"]).alias("base"),
                    s["labels"].alias("rules"),
                    s["score"].alias("score"),
                ),
            )

        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return once(places, lambda base: once(joined, lambda j: detect(j, base)))

    low = F.lower(text)
    hinted = reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in (*HINTS, *OWN_WORDS))) | low.rlike(UNDER)
    # Lower-casing A-Z only; other letters keep their case and their length.
    lowered = F.translate(text, UPPER, LOWER)
    words = F.array_remove(F.split(lowered, SEPARATORS), "")
    scanned = kept.withColumn("__hinted", hinted).withColumn(
        "__found", F.when(F.col("__hinted"), once(words, look)).otherwise(nothing)
    )
    s = F.col("__found")
    labels = F.array_sort(F.array_union(s["base"], s["rules"]))
    score = F.greatest(s["score"], F.when(F.size(s["base"]) > 0, F.lit(PHRASE_SCORE)).otherwise(0.0))
    n_words = F.size(F.array_remove(F.split(text, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), "")).cast("long")
    return scanned.select(
        *kept.columns,
        n_words.alias("n_words"),
        s["n_base"].alias("n_base"),
        s["first_word"].alias("first_word"),
        s["last_word"].alias("last_word"),
        F.array_join(F.array_sort(s["base"]), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
