"""Spelling variants of a vocabulary: words one edit apart, found by pivotal bigrams.

* Bigrams are ordered by how many places of the vocabulary hold them, the rarest first. A word's prefix are its three
  first bigrams in that order, with all others that are equal to the third. Its pivots are two bigrams of the three
  rarest that share no character; of the possible pairs a dynamic program over the places takes the rarest.
* One edit can't touch both pivots of a word. Of two words that are one edit apart, take the one whose prefix ends
  first. Either its left pivot and all before it are as they were, and the edit is further right; or its right pivot
  and all after it are. An untouched pivot is in the other word's prefix. So the place of a pivot is limited to the same
  distance from the start, or from the end, and what lies between must be equal. Of the rest of the word, which has the
  edit, one half is untouched too. Each pivot therefore asks twice: with the beginning of the word up to it (or the end
  from it on) and the nearer half of the rest, and with the same and the farther half. A prefix bigram answers for the
  lengths that the asking word may have. That is an equal-key join; pairs are verified inside it.

Nothing is taken for near without the exact distance, and nothing near is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablediff.llm.common import once, shared_dir, written

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LETTERS = 7
MIN_COUNT = 2
DROP = 31
FACTOR = 10
PREFIX = 3
# Counts of so many different bigrams at most are broadcast (2 MB); more are joined.
SMALL_GRAMS = 1 << 16


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop: int = DROP
) -> DataFrame:
    """Rows (word, n): the runs of letters of all whole texts, A-Z lower-cased, a fixed share with one letter left out.

    h is the crc32 of ``<id>:<run>`` (a null id: empty); where ``drop`` divides it, the letter at h modulo the length goes.
    Of the results those of at least ``min_letters`` code points that occur at least ``min_count`` times. Null texts have no runs.
    """
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"{RUN}{{{min_letters},}}"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"))
    each = docs.select(named.alias("doc"), F.explode(runs).alias("run")).select("doc", lower.alias("run"))
    each = each.select("run", F.crc32(F.concat("doc", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = each.select(F.when(F.col("h") % drop == 0, shorter).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _bigrams(word: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(word) - 1)
    return F.transform(places, lambda i: F.struct(F.substring(word, i, F.lit(2)).alias("gram"), i.alias("at")))


def _pivots(rare: Column) -> Column:
    """Two bigrams of ``rare`` (f, gram, at) that share no character, with the least sum of f.

    The program goes over the places from left to right and keeps the bigram before, the least one of those before it
    (all of them lie apart from what follows), and the least pair so far; of equal sums the leftmost.
    """
    one = "struct<f:bigint,gram:string,at:int>"
    none = F.lit(None).cast(one)
    start = F.struct(none.alias("last"), none.alias("least"), F.lit(None).cast(f"struct<f:bigint,p:{one},q:{one}>").alias("pair"))

    def less(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["f"] < a["f"]), b).otherwise(a)

    def step(s: Column, g: Column) -> Column:
        before = less(s["least"], s["last"])
        apart = F.when(s["last"]["at"] + 2 <= g["at"], before).otherwise(s["least"])
        made = F.when(apart.isNotNull(), F.struct((apart["f"] + g["f"]).alias("f"), apart.alias("p"), g.alias("q")))
        return F.struct(g.alias("last"), before.alias("least"), less(s["pair"], made).alias("pair"))

    in_place = F.array_sort(rare, lambda a, b: a["at"] - b["at"])
    return F.aggregate(in_place, start, step, lambda s: F.array(s["pair"]["p"], s["pair"]["q"]))


def _of_left(word: Column, size: Column, at: Column, rest: Column) -> list[Column]:
    """The keys of a bigram whose word has its edit further right, in a rest of ``rest`` characters; null where the word
    is too short for it."""
    head, half = at + 1, F.floor(rest / 2).cast("int")
    far = rest - half
    near_key = F.xxhash64(F.lit(0), at, F.substring(word, F.lit(1), head + half))
    far_key = F.xxhash64(F.lit(1), at, F.substring(word, F.lit(1), head), F.substring(word, size - far + 1, far))
    return [F.when((rest >= 0) & (head + half <= size), near_key), F.when((rest >= 0) & (head + far <= size), far_key)]


def _of_right(word: Column, size: Column, at: Column, rest: Column) -> list[Column]:
    """The same for an edit further left: the end of the word from the bigram on takes the place of its beginning."""
    tail, half = size - at + 1, F.floor(rest / 2).cast("int")
    far = rest - half
    near_key = F.xxhash64(F.lit(2), tail, F.substring(word, size - tail - half + 1, tail + half))
    far_key = F.xxhash64(F.lit(3), tail, F.substring(word, at, tail), F.substring(word, F.lit(1), far))
    return [F.when((rest >= 0) & (tail + half <= size), near_key), F.when((rest >= 0) & (tail + far <= size), far_key)]


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, other), both ways, of the different words of ``words`` (column word) that are one edit apart.

    Words need four code points or more. ``words`` is read more than once and should be a written table.
    """
    spark = words.sparkSession
    at = shared_dir(spark)
    grams = words.select("word", F.explode(_bigrams(F.col("word"))).alias("g")).select("word", "g.gram", "g.at")
    counts = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f")), at + "/grams")
    few = counts.limit(SMALL_GRAMS + 1).count() <= SMALL_GRAMS
    weighed = grams.join(F.broadcast(counts) if few else counts, "gram")
    ordered = weighed.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "at"))).alias("grams"))

    def prefix(g: Column) -> Column:
        last = F.get(g, F.lit(PREFIX - 1))
        return F.filter(g, lambda x: (x["f"] < last["f"]) | ((x["f"] == last["f"]) & (x["gram"] <= last["gram"])))

    indexed = written(
        ordered.select(
            "word",
            F.length("word").alias("size"),
            once(F.col("grams"), prefix).alias("prefix"),
            _pivots(F.slice("grams", 1, PREFIX)).alias("pivots"),
        ),
        at + "/indexed",
    )
    word, size, g = F.col("word"), F.col("size"), F.col("g.at")
    right, left = size - g - 1, g - 1  # what lies on either side of a bigram
    answers = [k for d in (-1, 0, 1) for k in (*_of_left(word, size, g, right + d), *_of_right(word, size, g, left + d))]
    held = indexed.select("word", "size", F.explode("prefix").alias("g"))
    held = held.select(F.col("word").alias("other"), F.explode(F.array_distinct(F.array_compact(F.array(*answers)))).alias("key"))
    p, q = F.col("pivots")[0]["at"], F.col("pivots")[1]["at"]
    asks = F.array(*_of_left(word, size, p, size - p - 1), *_of_right(word, size, q, q - 1))
    asked = indexed.select("word", F.explode(asks).alias("asked"))
    near = (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)
    met = asked.join(held, (F.col("asked") == F.col("key")) & near).select("word", "other")
    ways = F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))
    return met.select(F.inline(ways)).distinct()


def _roots(forms: DataFrame, at: str) -> DataFrame:
    """Rows (word, root) for ``forms`` (word, form): links are doubled until none goes on.

    Each link leads to a word that is more frequent by a factor, so there are no circles.
    """
    links = written(forms.select("word", F.col("form").alias("root")), at + "/links0")
    step = 0
    while True:
        step += 1
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = written(links.join(on, "root", "left"), f"{at}/links{step}")
        if not both.where("next IS NOT NULL").head(1):
            return links
        links = both.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for ``words`` (word, n, each word once).

    A word's form is its near word of the largest n (of equal ones the first in code-point order) if that n is at least
    ``factor`` times (more than once) the word's own, else null. root follows the forms to the last. An empty table
    gives an empty table.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2: forms must not lead back")
    at = shared_dir(words.sparkSession)
    words = written(words.select("word", "n"), at + "/words")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("b")
    )
    frequent = -F.col("b.m") >= factor * F.col("n")
    out = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("b.form")).alias("form"),
        F.when(frequent, -F.col("b.m")).alias("form_n"),
    )
    out = written(out, at + "/forms")
    roots = _roots(out.where("form IS NOT NULL"), at)
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
