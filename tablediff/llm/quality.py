"""Quality rules: text statistics, two plain rules, and robust multivariate outliers per language and source.

Everything is DataFrame expressions. ``measure`` works the statistics out within each row. ``judge`` turns them into a
vector on a fixed integer grid and rejects vectors whose Mahalanobis distance from their group's minimum covariance
determinant estimate is too large:

* rows with the same group and vector are one cell with a count, so later steps work on cells, and a group that holds a
  third of all rows is no larger than its number of different vectors;
* each group has several starts: the coordinatewise median and quartiles with the median absolute deviation, and the
  median on the plain scale. Each concentration step takes the half (``CORE`` of the rows) nearest to the current
  estimate and works its mean and covariance out, until the determinant falls no more; the start that ends with the
  smallest one counts. Sums are of whole numbers, so results don't depend on the order of rows;
* a fixed share of the grid is added to each variance, since most texts have none of some signs;
* groups of fewer than ``MIN_ROWS`` rows use their language's estimate, then that of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablediff.llm.common import once, shared_dir, whole_text, written

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# The statistic vector: 64 steps of the grid for each unit of the natural logarithm.
GRID = 64
DIMS = ("word_length", "symbols", "repeated_lines", "repeated_words")
# The least standard deviation of each, in units of the logarithm. Alone, a coordinate rejects from 4.3 of them on: words
# 1.9 times as long as usual, 12 symbols in 100 characters, 8 repeated lines or 12 repeated words in 100 words.
FLOOR = (0.15, 0.6, 0.5, 0.6)
CORE = 0.5
# Where the starts have their centres.
CENTRES = (0.5, 0.25, 0.75)
MIN_ROWS = 200
# Under a normal distribution in four dimensions: REWEIGHT and LIMIT are the 0.975 and 0.999 quantiles of the squared
# distance; the covariances of the nearest half, and of all rows within REWEIGHT, are too small by these factors.
REWEIGHT, LIMIT = 11.143, 18.467
CORE_FACTOR, REWEIGHT_FACTOR = 2.109, 1.0645

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeat_words(words: Column) -> Column:
    """How many words stand in windows of WINDOW words that the text holds twice or more."""

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def repeated(sorted_: Column) -> Column:
        same = lambda x, j: F.get(sorted_, j)["h"] == x["h"]
        twice = lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))
        places = F.transform(F.filter(sorted_, twice), lambda x: x["i"])
        return once(F.sort_array(places), covered)

    def of(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        differ = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(differ, F.lit(0)).otherwise(once(F.sort_array(pairs), repeated))

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1))
        return once(F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, WINDOW))), of)

    short = F.size(words) < WINDOW
    return F.when(short, F.lit(0)).otherwise(once(F.transform(words, lambda w: F.xxhash64(w)), windows))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with MEASURES (columns of these names are replaced); a null text has no words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier one),
    n_repeat_words, base_failed (too few words, or too many of them in repeated windows).
    """
    docs = docs.select([c for c in docs.columns if c not in MEASURES])
    text = whole_text(text_col)
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn(
        "__m",
        F.struct(
            once(
                words,
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    _repeat_words(w).cast("long").alias("n_repeat_words"),
                ),
            ).alias("w"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    m = F.col("__m")
    n, repeat = m["w"]["n_words"], m["w"]["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    return counted.select(
        *docs.columns,
        n.alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
    )


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    parts = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p(100 * F.col("n_dup_lines") / words),
        F.log1p(100 * F.col("n_repeat_words") / words),
    ]
    return [F.round(GRID * p).cast("long").alias(d) for p, d in zip(parts, DIMS, strict=True)]


def _group(level: int, lang_col: str, source_col: str) -> Column:
    """A group's name: all rows, a language, a language and source; nulls are a language or source of their own."""
    given = [F.col(c).cast("string") for c in (lang_col, source_col)[:level]]
    return F.to_json(F.array(F.lit(str(level)), *given))


def _distance(mean: list[Column], weight: dict[tuple[int, int], Column]) -> Column:
    """The squared length of W (x - mean), W being lower triangular."""
    total = F.lit(0.0)
    for i in range(len(DIMS)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + weight[i, j] * (F.col(DIMS[j]) - mean[j])
        total = total + y * y
    return total


def _estimate_columns() -> list[str]:
    k = len(DIMS)
    return [f"m{i}" for i in range(k)] + [f"w{i}{j}" for i in range(k) for j in range(i + 1)]


_ESTIMATE = "struct<" + ",".join(f"{c}:double" for c in [*_estimate_columns(), "det"]) + ">"


def _with_distance(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    k = len(DIMS)
    mean = [F.col(f"m{i}") for i in range(k)]
    weight = {(i, j): F.col(f"w{i}{j}") for i in range(k) for j in range(i + 1)}
    joined = cells.join(estimates, "grp")
    return joined.withColumn("d2", _distance(mean, weight)).drop(*_estimate_columns())


def _starts(cells: DataFrame) -> DataFrame:
    """Quantiles and median absolute deviation of each coordinate, per group; the last start has the floor for its spread."""
    at = lambda c, q: F.expr(f"percentile({c}, {q}, n)")  # noqa: E731  the grid bounds the number of different values
    k = len(DIMS)
    centres = [at(d, q).alias(f"c{s}{i}") for s, q in enumerate(CENTRES) for i, d in enumerate(DIMS)]
    centre = cells.groupBy("grp").agg(*centres)
    off = cells.join(centre, "grp").select(
        "grp", "n", *[F.abs(F.col(d) - F.col(f"c0{i}")).alias(f"a{i}") for i, d in enumerate(DIMS)]
    )
    spread = off.groupBy("grp").agg(*[at(f"a{i}", 0.5).alias(f"s{i}") for i in range(k)])

    def start(number: int) -> Column:
        plain = number == len(CENTRES)
        fields = [F.lit(number).alias("start"), *[F.col(f"c{0 if plain else number}{i}").alias(f"m{i}") for i in range(k)]]
        for i in range(k):
            own = F.lit(0.0) if plain else 1.4826 * F.col(f"s{i}")
            sd = F.sqrt(F.pow(own, 2) + (FLOOR[i] * GRID) ** 2)
            fields += [(1 / sd if i == j else F.lit(0.0)).alias(f"w{i}{j}") for j in range(i + 1)]
        return F.struct(*fields)

    every = F.explode(F.array(*[start(number) for number in range(len(CENTRES) + 1)])).alias("e")
    return centre.join(spread, "grp").select("grp", every).select("grp", "e.*")


def _concentrate(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of each start's nearest rows, as mean and weights.

    Distances are compared on a scale of sixteen steps for each doubling, so that the core's limit, the median step, is
    exact and needs a bounded number of values per start: the cells of a step are summed up first, and the core is the
    sums of the steps up to the median.
    """
    ranked = _with_distance(cells, estimates).withColumn("step", F.floor(16 * F.log2(1 + F.col("d2"))))
    by = ["grp", "start"]
    rings = ranked.groupBy(*by, "step").agg(*_sums())
    inner = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before, rows = F.coalesce(F.sum("n").over(inner), F.lit(0)), F.sum("n").over(Window.partitionBy(*by))
    core = rings.withColumns({"before": before, "rows": rows}).where(F.col("before") <= F.floor(CORE * (F.col("rows") - 1)))
    return _estimates(core.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _sum_columns()]), by, CORE_FACTOR)


def _sum_columns() -> list[str]:
    k = len(DIMS)
    return ["n"] + [f"s{i}" for i in range(k)] + [f"s{i}{j}" for i in range(k) for j in range(i + 1)]


def _sums() -> list[Column]:
    """The number of rows of some cells, and their sums and sums of products, all whole numbers."""
    n, x = F.col("n"), [F.col(d) for d in DIMS]
    k = len(DIMS)
    products = [n] + [n * x[i] for i in range(k)] + [n * x[i] * x[j] for i in range(k) for j in range(i + 1)]
    return [F.sum(p).alias(c) for p, c in zip(products, _sum_columns(), strict=True)]


def _estimates(sums: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Mean and weights (the inverse of the covariance's Cholesky factor) of each row's ``_sums``."""
    k = len(DIMS)
    out = sums.select(*by, *[F.col(c).cast("double").alias(c) for c in _sum_columns()])
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(k)})
    # Covariance, its Cholesky factor L, and W = L^-1, entry by entry.
    for i in range(k):
        for j in range(i + 1):
            c = factor * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            c = c + (FLOOR[i] * GRID) ** 2 if i == j else c
            for r in range(j):
                c = c - F.col(f"l{i}{r}") * F.col(f"l{j}{r}")
            least = (FLOOR[i] * GRID) ** 2 / 4  # rounding can't make a variance vanish
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(least))) if i == j else c / F.col(f"l{j}{j}"))
    for i in range(k):
        for j in range(i + 1):
            if i == j:
                w = 1 / F.col(f"l{i}{i}")
            else:
                w = -sum((F.col(f"l{i}{r}") * F.col(f"w{r}{j}") for r in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
            out = out.withColumn(f"w{i}{j}", w)
    return out.select(*by, *_estimate_columns())


def _log_det() -> Column:
    """The logarithm of the covariance's determinant."""
    return sum((-2 * F.log(F.col(f"w{i}{i}")) for i in range(len(DIMS))), F.lit(0.0))


def _converged(cells: DataFrame, at: str) -> DataFrame:
    """Per group the estimate with the smallest determinant that any start comes to.

    A start goes on as long as a step makes its determinant smaller; as its cores differ then, that ends.
    """
    going = written(_starts(cells).withColumn("det", F.lit(None).cast("double")), at + "/estimates0")
    settled, step = [], 0
    while going.head(1):
        step += 1
        # Both estimates of a start meet by grouping: each join here would be one more broadcast for the driver.
        estimate = F.struct(*_estimate_columns(), "det")
        after = _concentrate(cells, going.drop("det")).withColumn("det", _log_det())
        after = after.select("grp", "start", estimate.alias("new"), F.lit(None).cast(_ESTIMATE).alias("old"))
        before = going.select("grp", "start", F.lit(None).cast(_ESTIMATE).alias("new"), estimate.alias("old"))
        pairs = after.unionByName(before).groupBy("grp", "start").agg(F.max("new").alias("new"), F.max("old").alias("old"))
        both = written(pairs.select("grp", "start", "new.*", "old"), f"{at}/estimates{step}")
        smaller = F.col("old.det").isNull() | (F.col("det") < F.col("old.det") - 1e-9)
        settled.append(both.where(~smaller).select("grp", "start", "old.*"))
        going = both.where(smaller).drop("old")
    ends = settled[0] if settled else going
    for more in settled[1:]:
        ends = ends.unionByName(more)
    best = F.min(F.struct("det", "start", *_estimate_columns())).alias("best")
    return ends.groupBy("grp").agg(best).select("grp", *[F.col(f"best.{c}").alias(c) for c in _estimate_columns()])


def judge(
    measured: DataFrame, lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS, limit: float = LIMIT
) -> DataFrame:
    """All rows and columns of ``measured`` with kept and distance (columns of these names are replaced).

    ``measured`` is read more than once and should be a written table. kept is false where base_failed is true, else
    whether the squared distance from the group's estimate is at most ``limit``; distance is null where base_failed is
    true. Estimates are made of the rows that did not fail, repeated rows counting each. Null languages and sources are
    groups like others. An empty table, or one where all rows failed, needs no estimate.
    """
    spark = measured.sparkSession
    at = shared_dir(spark)
    rows = measured.select([c for c in measured.columns if c not in ("kept", "distance")])
    passed = rows.where(~F.col("base_failed")).select(F.col(lang_col), F.col(source_col), *_vector())
    levels = [_group(level, lang_col, source_col).alias(f"g{level}") for level in range(3)]
    own = passed.groupBy(*levels, *DIMS).agg(F.count(F.lit(1)).alias("n"))
    own = written(own, at + "/own")
    named = own.select(F.explode(F.array("g0", "g1", "g2")).alias("grp"), *DIMS, "n")
    cells = written(named.groupBy("grp", *DIMS).agg(F.sum("n").alias("n")), at + "/cells")
    nearest = written(_converged(cells, at), at + "/nearest")
    usual = _with_distance(cells, nearest).where(F.col("d2") <= REWEIGHT)
    estimates = _estimates(usual.groupBy("grp").agg(*_sums()), ["grp"], REWEIGHT_FACTOR)
    sizes = cells.groupBy("grp").agg(F.sum("n").alias("rows"))
    known = estimates.join(sizes, "grp").select("grp", "rows", F.struct(*_estimate_columns()).alias("e"))
    # Of the three groups of a row the last one that is large enough; all rows together always are.
    groups = own.select("g0", "g1", "g2").distinct()
    levels = F.posexplode(F.array("g0", "g1", "g2")).alias("level", "grp")
    enough = (F.col("rows") >= min_rows) | (F.col("level") == 0)
    last = F.max(F.when(enough, F.struct("level", "e")))["e"]
    found = groups.select(F.col("g2").alias("__grp"), levels).join(known, "grp", "left")
    chosen = written(found.groupBy("__grp").agg(last.alias("__e")), at + "/chosen")
    k = len(DIMS)
    e = F.col("__e")
    mean = [e[f"m{i}"] for i in range(k)]
    weight = {(i, j): e[f"w{i}{j}"] for i in range(k) for j in range(i + 1)}
    placed = rows.withColumn("__grp", _group(2, lang_col, source_col)).withColumn("__v", F.struct(*_vector()))
    vector = {d: F.col("__v")[d] for d in DIMS}
    total = F.lit(0.0)
    for i in range(k):
        y = sum((weight[i, j] * (vector[DIMS[j]] - mean[j]) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    distance = F.when(~F.col("base_failed"), F.round(total, 6))
    judged = placed.join(chosen, "__grp", "left").withColumn("distance", distance)
    return judged.select(
        *rows.columns, "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))).alias("kept")
    )


def quality_rules(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``measure`` and ``judge``: all rows and columns of ``docs`` with the measures, distance and kept.

    Null texts have no words and fail the base rule. Repeated rows stay; an empty table gives an empty table; very long
    texts are rows like others.
    """
    measured = written(measure(docs, text_col), shared_dir(docs.sparkSession) + "/measured")
    return judge(measured, lang_col, source_col)
