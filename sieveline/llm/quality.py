"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

Each rule rejects a text whose measure lies above a cutoff. Cutoffs are chosen per stratum (the
language) on labelled holdouts: a cutoff is admissible if the exact binomial test rejects, at its
level, that the rule turns away more than its share of good texts. Within a rule the cutoffs are
tested in a fixed order from lenient to strict and the testing stops at the first that fails, which
needs no correction; across rules and strata the level is divided (Bonferroni). The shares of the
rules add up to `max_false_rejection`, so the verdict of all rules together keeps that limit in
every stratum, with probability 1 - `level`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import BLANKS, Scratch, let
from sieveline.session import local_frame

WINDOW_WORDS = 5
MARKS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Cutoffs of each rule from lenient to strict; a text above the cutoff is rejected.
CUTOFFS = {
    "symbol_share": (1.0, 0.5, 0.3, 0.2, 0.1, 0.05),
    "repeat_share": (0.2, 0.15, 0.1, 0.05),
    "dup_line_share": (0.8, 0.6, 0.5, 0.4, 0.35),
    "echo_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
}


@dataclass(frozen=True)
class RiskControl:
    """max_false_rejection: share of good texts of a stratum that all rules may reject together.
    level: probability that this fails in any stratum. good_cost: bad texts a cutoff must catch
    for each good one it rejects, when several admissible cutoffs are compared."""

    max_false_rejection: float = 0.05
    level: float = 0.05
    good_cost: float = 5.0


def _repeated_words(words: Column) -> Column:
    """Words of the array that lie in a window of five found twice or more."""
    n = WINDOW_WORDS

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - n),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]),
        )

    def covered(at: Column) -> Column:
        """at: sorted starts of repeated windows; each adds the words up to the next start."""
        reach = F.transform(at, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - p, F.lit(n))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(sort: Column) -> Column:
        """sort: (hash, start) in order; equal hashes are neighbours."""
        h = lambda i: F.get(sort, i)["h"]
        same = lambda x, i: ((i > 0) & (h(i - 1) == x["h"])) | F.coalesce(h(i + 1) == x["h"], F.lit(False))
        return let(F.array_sort(F.transform(F.filter(sort, same), lambda x: x["p"])), covered)

    def count(win: Column) -> Column:
        pairs = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), count)))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns with the counts and shares the rules use; a null text has no words.

    Words are runs without ASCII white space. Base counts: n_words, word_chars (code points in
    words), n_symbols, n_dup_lines (lines with a word that equal an earlier one), n_repeat_words
    (words in windows of five found twice or more). Shares of a text without words are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = " \t\n\x0b\f\r"
    without = lambda chars: F.length(F.translate("_t", chars, ""))
    rows = docs.select(*keep, text.alias("_t"))
    rows = rows.select(
        *keep,
        F.filter(F.split("_t", BLANKS + "+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, blanks, "")) > 0).alias("_l"),
        without(blanks).cast("long").alias("word_chars"),
        (F.length("_t") - without(MARKS)).cast("long").alias("n_symbols"),
        (F.length("_t") - without(CAPITALS)).alias("_capitals"),
        (F.length("_t") - without(CAPITALS + CAPITALS.lower())).alias("_letters"),
    )
    echoes = let(F.col("_w"), lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))))
    rows = rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        let(F.col("_w"), _repeated_words).alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        echoes.alias("_echoes"),
        "_capitals",
        "_letters",
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return rows.withColumns(
        {
            "symbol_share": share("n_symbols", "n_words"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "_lines"),
            "echo_share": share("_echoes", "n_words"),
            "capital_share": share("_capitals", "_letters"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    ).drop("_lines", "_echoes", "_capitals", "_letters")


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1: Stirling's series at x + 7, stepped back."""
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = sum((F.ln(x + k) for k in range(1, 7)), F.ln(x))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p); 1 where k lies above the mean, where no test can reject.

    The terms are summed downwards from k, relative to the k-th, so that nothing underflows.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_term = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    odds = (1 - p) / p

    def step(acc: Column, j: Column) -> Column:
        i = kd - j
        term = acc["term"] * (i + 1) / (nd - i) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    lower = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(lower, start, step, lambda acc: acc["total"])
    return F.when(kd > nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_term) * total))


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit("?"))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_lost, n_bad, n_caught, p_value) of the cutoffs in force.

    `measured` needs doc_id, stratum and `measures`; `labels` doc_id and quality (0 or 1; null or
    other values and null ids are ignored, a document with several labels counts as good only if
    all are 1). Texts that fail the base rules take no part. A rule without an admissible cutoff
    that catches anything is not in the result and rejects nothing in that stratum.
    """
    spark = measured.sparkSession
    truth = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where("not base_failed").join(truth, "doc_id")
    grid = [(rule, i, float(c)) for rule, cuts in CUTOFFS.items() for i, c in enumerate(cuts)]
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = held.groupBy("stratum").agg(
        F.count_if(good).alias("n_good"),
        F.count_if(bad).alias("n_bad"),
        *[F.count_if(good & (F.col(r) > c)).alias(f"lost_{r}_{i}") for r, i, c in grid],
        *[F.count_if(bad & (F.col(r) > c)).alias(f"caught_{r}_{i}") for r, i, c in grid],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
                F.col(f"lost_{r}_{i}").alias("n_lost"), F.col(f"caught_{r}_{i}").alias("n_caught"),
            )
            for r, i, c in grid
        ]
    )
    limit = control.max_false_rejection / len(CUTOFFS)
    strata = Window.partitionBy(F.lit(0))
    tested = (
        counts.withColumn("tests", F.count(F.lit(1)).over(strata) * len(CUTOFFS))
        .select("stratum", "n_good", "n_bad", "tests", F.explode(cells).alias("c"))
        .select("stratum", "n_good", "n_bad", "tests", "c.*")
        .withColumn("p_value", binomial_tail(F.col("n_lost"), F.col("n_good"), limit))
    )
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    admissible = tested.withColumn(
        "open", F.min((F.col("p_value") <= control.level / F.col("tests")).cast("int")).over(order)
    ).where("open = 1")
    gain = F.col("n_caught") - control.good_cost * F.col("n_lost")
    best = admissible.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(
        F.max_by(
            F.struct("cutoff", "n_good", "n_lost", "n_bad", "n_caught", "p_value"),
            F.struct("gain", -F.col("step")),
        ).alias("b")
    )
    rows = best.select("stratum", "rule", "b.*").toArrow()  # rules x strata rows
    columns = rows.to_pydict()
    return local_frame(
        spark, list(zip(*columns.values())),
        "stratum string, rule string, cutoff double, n_good long, n_lost long, n_bad long, n_caught long, p_value double",
    )


def fit(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()) -> tuple[DataFrame, DataFrame]:
    """(measures of all `docs` with doc_id and stratum, cutoffs); the measures are written once."""
    measured = measures(docs.withColumn("stratum", stratum()), "doc_id", "stratum")
    measured, _ = Scratch(docs.sparkSession).write(measured, "measures")
    return measured, choose_cutoffs(measured, labels, control)


def filter_documents(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()) -> DataFrame:
    """The rows of `docs` that are kept, with their columns.

    The second look at a text costs its measures again, but no text is shuffled.
    """
    _, cutoffs = fit(docs, labels, control)
    held = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(held, "text", stratum().alias("stratum"))
    judged = verdicts(measures(rows, "_row", "stratum"), cutoffs)
    return judged.where("kept").select("_row.*")


def verdicts(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`measured` with kept: false if a base rule or a rule with a cutoff in the stratum rejects.

    `cutoffs` has a row only for strata with hundreds of labelled texts, so it is broadcast.
    """
    wide = cutoffs.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.max("cutoff"))
    limits = [F.col(r).alias(f"_max_{r}") for r in CUTOFFS]
    joined = measured.join(F.broadcast(wide.select("stratum", *limits)), "stratum", "left")
    above = [F.coalesce(F.col(r) > F.col(f"_max_{r}"), F.lit(False)) for r in CUTOFFS]
    rejected = above[0]
    for a in above[1:]:
        rejected = rejected | a
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*[f"_max_{r}" for r in CUTOFFS])
