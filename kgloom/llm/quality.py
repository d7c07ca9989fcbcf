"""Quality rules with risk-controlled thresholds.

Fixed base rules come first.  On top of them, every soft rule (a share such as symbols by characters) gets, for each
stratum, the strictest cutoff of a fixed grid for which labelled documents prove that it rejects few good ones:
the exact one-sided binomial test of "the false rejection rate is at least ``risk``" must reject that hypothesis.
The level of each test is divided by the number of rules and strata (Bonferroni); within a rule the cutoffs are
tested from the mildest on and testing stops at the first failure (fixed-sequence testing), so the family-wise
error stays below ``error``.  Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, fields, let, materialise, words_of, wrapped

#: Soft rules and their cutoffs, mildest first: a document is rejected if its share is above the cutoff.
SOFT_RULES = {
    "symbol_share": [0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05],
    "dup_line_share": [0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20],
    "repeat_share": [0.19, 0.17, 0.15, 0.13, 0.11, 0.10, 0.08, 0.06, 0.05],
}
#: Per stratum at most this share of good documents may be rejected by all soft rules together ...
RISK = 0.01
#: ... except with this probability, over all strata and rules together.
ERROR = 0.05
#: Tables with one row for each stratum are broadcast up to this many rows.
BROADCAST_STRATA = 20_000
WINDOW = 5
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeated(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more among ``words``.

    A pass over 64-bit hashes tells whether there is such a window at all; only then the windows themselves are
    sorted and compared.
    """
    last = F.size(words) - WINDOW
    at = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*at(i)))
    none = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("w"), i.alias("i"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
    starts = let(windows, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["i"])))
    zero = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"))
    return F.when(last < 1, 0).when(none, 0).otherwise(F.aggregate(starts, zero, step, lambda a: a["n"])).cast("long")


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` and ``base_failed``.

    Lines count if they hold a word.  Null and empty texts have zero of everything and fail for their few words; texts
    of any length are measured as a whole.  Each row is measured by itself, so repeated rows have equal metrics and an
    empty table none; nothing is shuffled.  Columns of these names in ``docs`` are replaced, others kept whatever
    their names.
    """
    own = METRICS
    whole = F.coalesce(F.col("text"), F.lit(""))
    words, lines = F.col("words"), F.col("lines")
    out = wrapped(docs, without=tuple(c for c in own if c != text)).select("row", F.col("row").getField(text).alias("text"))
    out = out.withColumns({"words": words_of(whole), "lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": let(words, _repeated),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).select(*fields(out), *own)


def soft_shares() -> dict[str, Column]:
    over = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
    }


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, to about 1e-12: Stirling's series at x + 8."""
    y = x + 8
    down = F.ln(x)
    for k in range(1, 8):
        down = down + F.ln(x + k)
    inverse = 1 / (y * y)
    series = (1 / (12 * y)) * (1 - inverse * (F.lit(1 / 30) - inverse * (F.lit(1 / 105) - inverse * F.lit(1 / 140))))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the exact sum, from its largest term down when k is below n p."""
    kd, nd = k.cast("double"), n.cast("double")
    log_top = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    step = lambda acc, j: F.struct((acc["t"] * (kd - j + 1) * (1 - p) / ((nd - kd + j) * p)).alias("t"), (acc["s"] + acc["t"] * (kd - j + 1) * (1 - p) / ((nd - kd + j) * p)).alias("s"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"])
    return F.least(F.lit(1.0), F.exp(log_top) * total)


def select_cutoffs(labelled: DataFrame, stratum: str, good: Column, rules: dict[str, list[float]] | None = None, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The proven cutoffs of ``labelled`` (one row for each labelled document, with a column for each rule).

    Returns (stratum, rule, cutoff, n_good, n_rejected): a row for each stratum and rule whose mildest cutoff could
    be proven; the others have none and never reject.  Each rule may use ``risk / len(rules)``.  Documents that are
    not ``good`` don't count; strata without a good document get no row, an empty table none.  A null stratum is a
    stratum.  Rows are taken as independent: copies of a text should come as one (``learn`` sees to that).
    """
    rules = rules or SOFT_RULES
    counts = [F.count_if(F.col(r) > c).cast("long").alias(f"{r}:{i}") for r, cuts in rules.items() for i, c in enumerate(cuts)]
    by = labelled.where(good).groupBy(column(stratum).alias("stratum")).agg(F.count("*").cast("long").alias("n_good"), *counts)
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"`{r}:{i}`").alias("n_rejected")) for r, cuts in rules.items() for i, c in enumerate(cuts)])
    tests = by.select("stratum", "n_good", F.explode(grid).alias("g")).select("stratum", "n_good", "g.*")
    strata = by.agg(F.count("*").alias("strata"))
    each = risk / len(rules)
    # Only counts below the mean that the hypothesis implies can be proven; the sum is then the short one.
    tests = tests.crossJoin(F.broadcast(strata)).withColumn("proven", F.when(F.col("n_rejected") >= F.col("n_good") * each, F.lit(False)).otherwise(binomial_tail(F.col("n_rejected"), F.col("n_good"), each) <= F.lit(error) / (F.col("strata") * len(rules))))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    upto = tests.withColumn("all", F.min(F.col("proven")).over(order)).where("all")
    best = F.max(F.struct("step", "cutoff", "n_good", "n_rejected")).alias("b")
    return upto.groupBy("stratum", "rule").agg(best).select("stratum", "rule", "b.cutoff", "b.n_good", "b.n_rejected")


def judge(metrics: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``metrics`` with ``kept``: not ``base_failed``, and no soft share above its stratum's cutoff.

    A null stratum is a stratum; those without cutoffs, all of them if there are no labels, reject nothing by soft
    shares.  Rows are judged one by one; a column ``kept`` is replaced, others are kept whatever their names.
    """
    names = list(SOFT_RULES)
    wide = cutoffs.groupBy(F.col("stratum").alias("stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in names])
    wide = materialise(wide, "cutoffs")
    if wide.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    shares = soft_shares()
    own = [c for c in METRICS if c != "base_failed"]
    rows = wrapped(metrics, *own, "base_failed", without=("kept",)).withColumn("own_stratum", F.col("row").getField(stratum))
    joined = rows.join(wide, F.col("own_stratum").eqNullSafe(F.col("stratum")), "left")
    rejected = F.lit(False)
    for r in names:
        rejected = rejected | F.coalesce(shares[r] > F.col(f"cutoff_{r}"), F.lit(False))
    return joined.select(*fields(joined), (~F.col("base_failed") & ~rejected).alias("kept"))


def learn(metrics: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", text_key: str | None = None) -> DataFrame:
    """``select_cutoffs`` on the rows of ``metrics`` that ``labels`` (key, quality) cover and that pass the base rules.

    A document with several labels is good only if all of them say 1; null labels say nothing.  With ``text_key``, a
    column that equal texts share, each labelled text counts once, as the bound takes labelled documents as
    independent; a text is good only if all its labels say so.  No labels give no cutoffs.  Repeated rows of ``metrics``
    count each without ``text_key``, as one with it; texts aren't read here, so their length doesn't matter.
    """
    good = labels.where("quality is not null").groupBy(column(key).alias("key")).agg(F.min("quality").alias("quality"))
    shares = soft_shares()
    rows = wrapped(metrics, *[c for c in METRICS if c != "base_failed"], "base_failed").where(~F.col("base_failed"))
    told = [F.col("row").getField(key).alias("key"), F.col("row").getField(stratum).alias("of"), (F.col("row").getField(text_key) if text_key else F.lit(None)).alias("text_key")]
    labelled = rows.select(*told, *[v.alias(k) for k, v in shares.items()]).join(good, "key")
    if text_key:
        labelled = labelled.groupBy("of", "text_key", *shares).agg(F.min("quality").alias("quality"))
    return select_cutoffs(labelled, "of", F.col("quality") == 1)
