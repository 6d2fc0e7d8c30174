"""Quality rules by robust multivariate outliers, with Spark expressions only.

Four statistics of each text are transformed to roughly symmetric scales.  For
every language and source a minimum-covariance-determinant estimate of centre
and scatter is found by concentration steps: from a robust start, take the half
of the rows with the smallest Mahalanobis distances, estimate again, and so on.
There are three starts, all around the medians: with uncorrelated scales, with
the correlations of squashed values, and with those of directions.  After two
steps the start with the smallest determinant goes on until its determinant
stays.  No start and no step is moved far by less than half of the rows.

Only sums per group and distance bin are aggregated: one pass gives the counts,
sums and products per bin, and the bins up to the wanted number, the last one in
part, make the next estimate.  A group is never gathered, however many rows it has.

A row is judged by the mixture of its group's estimate and that of all rows,
weighted by the group's number of rows against ``PRIOR``, at every size alike.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window, functions as F

from planlens.llm import text_stats as stats
from planlens.llm.common import rows_where, store, whole_text

FEATURES = ("x0", "x1", "x2", "x3")
#: Scale that a transformed statistic has at least: mean word length (log), symbols, repeated lines, repeated words (roots of shares).
#: The root of a share counted over n items varies by 1 / (2 sqrt(n)) at most: 0.02 over 625 characters, 0.1 over 25 lines or 25 windows of three words.
FLOORS = (0.05, 0.02, 0.1, 0.1)
#: Steps of all starts, and the most that the best one takes after them while its log determinant changes by more than SETTLED.
STEPS, MORE, SETTLED = 2, 6, 0.001
#: Share of normal rows that lie within the distance at which rows are rejected.
WITHIN = 0.9999
#: Number of rows at which a group's own estimate weighs as much as that of all rows.
PRIOR = 60
MIN_WORDS = 50
#: Bins per unit of log distance, and per unit of a statistic.
BINS, GRID = 32, 200


def chi_square(share: float) -> float:
    """The squared distance within which ``share`` of the rows of four normal statistics lie."""
    low, high = 0.0, 100.0
    for _ in range(80):
        q = (low + high) / 2
        low, high = (q, high) if 1 - exp(-q / 2) * (1 + q / 2) < share else (low, q)
    return q


#: Squared distance within which half of the rows lie, and beyond which a row is rejected: 3.36 and 23.5.
HALF, CUT = chi_square(0.5), chi_square(WITHIN)


def consistency(share: Column) -> Column:
    """Factor that makes the scatter of the inner ``share`` (half or more) of four normal statistics unbiased.

    The quantile by Newton's steps from that of one half, below which the
    distribution is concave, so that the steps approach from one side.
    """

    def nearer(q: Column, _: Column) -> Column:
        return q - (1 - F.exp(-q / 2) * (1 + q / 2) - share) / (q * F.exp(-q / 2) / 4)

    def factor(q: Column) -> Column:
        return share / (1 - F.exp(-q / 2) * (1 + q / 2 + q * q / 8))

    return F.when(share >= 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(HALF), nearer, factor))


def core(n: Column) -> Column:
    """Of ``n`` rows those that make an estimate: the fewest that two estimates without a common row can't have, four statistics given."""
    return F.least(n, F.floor((n + len(FEATURES) + 1) / 2))


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, lang, source, the counts of words, their characters, symbols, repeated lines and words, base_failed and x0 to x3.

    A missing text has no words.  base_failed: fewer than 50 words, or more
    than half of them in repeated three-word windows.  A text is one array of
    words in its task, which a text of some million words still is.
    """
    rows = docs.select(*keep, *[c for c in ("lang", "source") if c not in keep], whole_text(F.col("text")).alias("_text"))
    rows = rows.withColumns({"_words": stats.words(F.col("_text")), "_lines": stats.lines_with_a_word(F.col("_text"))})
    counted = rows.select(
        *[c for c in rows.columns if c not in ("_text", "_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        stats.word_chars(F.col("_words")).alias("word_chars"),
        stats.n_symbols(F.col("_text")).alias("n_symbols"),
        stats.n_dup_lines(F.col("_lines")).alias("n_dup_lines"),
        stats.n_repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"),
    )
    w = F.greatest("n_words", F.lit(1))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "x0": F.log((F.col("word_chars") + 1) / (w + 1)),
            "x1": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
            "x2": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "x3": F.sqrt(F.col("n_repeat_words") / w),
        }
    ).drop("n_lines")


def _group(df: DataFrame) -> DataFrame:
    """Each row once in its own group and once in the group of all rows."""
    own = F.struct(F.lit(False).alias("pooled"), F.col("lang"), F.col("source"))
    pooled = F.struct(
        F.lit(True).alias("pooled"),
        F.lit(None).cast(df.schema["lang"].dataType).alias("lang"),
        F.lit(None).cast(df.schema["source"].dataType).alias("source"),
    )
    return df.withColumn("_g", F.explode(F.array(own, pooled)))


def _starting(grouped: DataFrame) -> DataFrame:
    """_g, n, medians m and scales s per group, from counts per bin of each statistic."""
    long = grouped.select("_g", F.posexplode(F.array(*FEATURES)).alias("f", "x"))
    bins = long.groupBy("_g", "f", F.floor(F.col("x") * GRID).alias("b")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("_g", "f")
    upto = lambda c: F.sum("n").over(whole.orderBy(c))
    bins = bins.withColumns({"x": (F.col("b") + 0.5) / GRID, "c": upto("b"), "all": F.sum("n").over(whole)})
    bins = bins.withColumn("m", F.min(F.when(2 * F.col("c") >= F.col("all"), F.col("x"))).over(whole))
    off = bins.withColumn("away", F.abs(F.col("x") - F.col("m"))).withColumn("c", upto("away"))
    each = off.groupBy("_g", "f").agg(
        F.max("m").alias("m"),
        (1.4826 * F.min(F.when(2 * F.col("c") >= F.col("all"), F.col("away")))).alias("s"),
        F.max("all").alias("n"),
    )
    pick = lambda c, f: F.max(F.when(F.col("f") == f, F.col(c)))
    p = range(len(FEATURES))
    return each.groupBy("_g").agg(
        F.max("n").alias("n"), *[pick("m", f).alias(f"m{f}") for f in p], *[pick("s", f).alias(f"s{f}") for f in p]
    )


def _starts(grouped: DataFrame) -> DataFrame:
    """_g, start, n, centre m and scatter c: the medians with three scatters of the same scales.

    Correlations: none; those of tanh of the scaled distances from the median;
    those of the directions from the medians.
    """
    p = range(len(FEATURES))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    scaled = store(_starting(grouped), "scales")
    rows = grouped.join(scaled, "_g").select(
        "_g", *[((F.col(FEATURES[i]) - F.col(f"m{i}")) / F.sqrt(F.col(f"s{i}") * F.col(f"s{i}") + FLOORS[i] ** 2)).alias(f"z{i}") for i in p]
    )
    rows = rows.withColumn("far", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in p), F.lit(0.0))))
    rows = rows.select(
        "_g",
        *[F.tanh(f"z{i}").alias(f"u{i}") for i in p],
        *[F.when(F.col("far") > 0, F.col(f"z{i}") / F.col("far")).otherwise(0.0).alias(f"v{i}") for i in p],
    )
    sums = rows.groupBy("_g").agg(*[F.sum(F.col(f"{a}{i}") * F.col(f"{a}{j}")).alias(f"{a}{i}{j}") for a in "uv" for i, j in pairs])

    def scatter(start: int, letter: str) -> Column:
        def cell(i: int, j: int) -> Column:
            scales = F.col(f"s{i}") * F.col(f"s{j}")
            if i == j:
                return scales
            both = F.sqrt(F.col(f"{letter}{i}{i}") * F.col(f"{letter}{j}{j}")) if letter else F.lit(0.0)
            return F.when(both > 0, scales * F.col(f"{letter}{i}{j}") / both).otherwise(0.0) if letter else F.lit(0.0)

        return F.struct(F.lit(start).alias("start"), *[cell(i, j).alias(f"c{i}{j}") for i, j in pairs])

    each = F.inline(F.array(*[scatter(k, letter) for k, letter in enumerate(("", "u", "v"))]))
    return scaled.join(sums, "_g").select("_g", "n", *[f"m{i}" for i in p], each)


def _factored(params: DataFrame) -> DataFrame:
    """Adds the lower triangle l of the Cholesky factor of the scatter c with the floors, and drops c."""
    p = range(len(FEATURES))
    out = params.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + FLOORS[i] ** 2 for i in p})
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.drop(*[f"c{i}{j}" for i in p for j in range(i + 1)])


def _with_determinant(params: DataFrame) -> DataFrame:
    """Adds ld, the log determinant of the scatter with the floors."""
    p = range(len(FEATURES))
    kept = F.struct(*[f"c{i}{j}" for i in p for j in range(i + 1)]).alias("_c")
    done = _factored(params.select("*", kept)).withColumn("ld", 2 * sum((F.log(f"l{i}{i}") for i in p), F.lit(0.0)))
    return done.select(*[c for c in params.columns if not c.startswith("c")], "_c.*", "ld")


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(len(FEATURES)):
        rest = F.col(FEATURES[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(FEATURES))), F.col("y0") * F.col("y0")))


def _concentrate(grouped: DataFrame, params: DataFrame) -> DataFrame:
    """The estimates from the half of each group's rows that lie nearest under each of its ``params``.

    Of the bin that crosses the half all rows count, with the weight that makes up the number.
    """
    p = range(len(FEATURES))
    far = _distance(grouped.join(_factored(params.drop("n", "ld")), "_g"))
    sums = {f"t{i}": F.sum(FEATURES[i]) for i in p}
    sums |= {f"q{i}{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in p for j in range(i + 1)}
    bins = far.groupBy("_g", "start", F.floor(F.log1p("d2") * BINS).alias("b")).agg(
        F.count("*").alias("k"), *[v.alias(c) for c, v in sums.items()]
    )
    own = Window.partitionBy("_g", "start")
    below = own.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inner = bins.withColumns(
        {"c": F.coalesce(F.sum("k").over(below), F.lit(0)), "n": F.sum("k").over(own)}
    ).withColumn("w", F.least(F.lit(1.0), (core(F.col("n")) - F.col("c")) / F.col("k"))).where("w > 0")
    total = inner.groupBy("_g", "start").agg(
        F.max("n").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("k", *sums)]
    )
    total = total.withColumn("factor", consistency(core(F.col("n")) / F.col("n")))
    factor = F.col("factor")
    return total.select(
        "_g",
        "start",
        "n",
        *[(F.col(f"t{i}") / F.col("k")).alias(f"m{i}") for i in p],
        *[
            (factor * (F.col(f"q{i}{j}") / F.col("k") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("k") / F.col("k"))).alias(f"c{i}{j}")
            for i in p
            for j in range(i + 1)
        ],
    )


def estimates(rows: DataFrame, steps: int = STEPS, more: int = MORE) -> DataFrame:
    """One row a group (_g: pooled, lang, source) with n, centre m and scatter c, from rows that passed the base rules.

    A few hundred numbers a group; stored after each step, which keeps the plan
    of a step short and its size known to the join that follows.
    """
    grouped = _group(rows.where("not base_failed").select("lang", "source", *FEATURES))
    params = store(_starts(grouped), "starts")
    for _ in range(steps):
        params = store(_with_determinant(_concentrate(grouped, params)), "scatter")
    names = [c for c in params.columns if c != "_g"]
    best = F.min_by(F.struct(*names), F.struct("ld", "start")).alias("best")
    params = store(params.groupBy("_g").agg(best).select("_g", "best.*"), "best")
    for _ in range(more):
        before, params = params, store(_with_determinant(_concentrate(grouped, params)), "scatter")
        moved = params.join(before.select("_g", F.col("ld").alias("was")), "_g").agg(F.max(F.abs(F.col("ld") - F.col("was")))).first()[0]
        if moved is None or moved <= SETTLED:
            break
    return params.drop("start", "ld")


def blended(params: DataFrame, prior: int = PRIOR) -> DataFrame:
    """_lang, _source, m and c: the mixture of each group's estimate, n / (n + prior) of it, and the one of all rows."""
    p = range(len(FEATURES))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    numbers = [f"m{i}" for i in p] + [f"c{i}{j}" for i, j in pairs]
    own = params.where("not _g.pooled")
    pooled = params.where("_g.pooled").select(*[F.col(c).alias(f"all_{c}") for c in numbers])
    both = own.join(F.broadcast(pooled), F.lit(True))  # one row
    w = F.col("n") / (F.col("n") + prior)
    mix = lambda c: w * F.col(c) + (1 - w) * F.col(f"all_{c}")
    off = lambda i: F.col(f"m{i}") - F.col(f"all_m{i}")
    return both.select(
        F.col("_g.lang").alias("_lang"),
        F.col("_g.source").alias("_source"),
        *[mix(f"m{i}").alias(f"m{i}") for i in p],
        *[(mix(f"c{i}{j}") + w * (1 - w) * off(i) * off(j)).alias(f"c{i}{j}") for i, j in pairs],
    )


def judged(rows: DataFrame, params: DataFrame, cut: float = CUT, prior: int = PRIOR) -> DataFrame:
    """Adds d2 and kept to ``rows``: false if base_failed or d2 is above ``cut``.

    A missing language or source is a value of its own.  Rows of a group without
    an estimate are judged by that of all rows; without any estimate a row that
    passed the base rules is kept.
    """
    p = range(len(FEATURES))
    names = [f"m{i}" for i in p] + [f"l{i}{j}" for i in p for j in range(i + 1)]
    own = _factored(blended(params, prior)).select("_lang", "_source", F.struct(*names).alias("_own"))
    pooled = _factored(params.where("_g.pooled")).select(F.struct(*names).alias("_all"))
    found = rows.join(own, rows.lang.eqNullSafe(own._lang) & rows.source.eqNullSafe(own._source), "left")
    found = found.join(F.broadcast(pooled), F.lit(True), "left")  # one row at most
    used = found.withColumn("_p", F.coalesce("_own", "_all"))
    wide = _distance(used.select(*rows.columns, *[F.col(f"_p.{c}").alias(c) for c in names]))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True))
    return wide.select(*rows.columns, "d2", kept.alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept for every row.

    Columns other than doc_id, text, lang and source are ignored; repeated rows
    are judged alike; an empty table gives an empty one.
    """
    rows = store(base_statistics(docs, "doc_id"), "statistics")
    return judged(rows, estimates(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept.

    The statistics are computed twice, for the estimates and for the rows, so
    that no text is stored or moved.
    """
    names = docs.columns
    packed = docs.select(F.struct("*").alias("_row"), "lang", "source", "text")
    narrow = ("lang", "source", "base_failed", *FEATURES)
    params = estimates(store(base_statistics(docs.select("lang", "source", "text")).select(*narrow), "statistics"))
    return rows_where(judged(base_statistics(packed, "_row"), params), F.col("kept"), names)
