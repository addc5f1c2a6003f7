"""Survey tabulation (M12, M13, M15, M20, F22; A16-A18).

Answers are unpivoted once to long form (respondent, grouping columns,
question, answer) and grouped once by (question, answer, every grouping
column) -- map-side partial aggregation folds that to a handful of rows per
task before any shuffle.  Each grouping's counts (country, region) are then
sums over that small table, so the raw answers are never duplicated per
grouping.  Shares divide by the per-question respondent count of the area; numeric
means combine mergeable parts (exact sums, counts, squared deviations) the
same way.

The long ``summary_stats`` contract: dependent_var, dependent_var_value,
independent_var, independent_var_value, numbers, se, min, max, repeat_var,
repeat_var_value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import exprs as X

STAT_COLS = ["dependent_var", "dependent_var_value", "independent_var", "independent_var_value",
             "numbers", "se", "min", "max", "repeat_var", "repeat_var_value"]
Z95 = 1.96


def _answers(df: DataFrame, questions: Sequence[str], independent: Sequence[str]) -> DataFrame:
    """(uuid, *independent, dependent_var, answer), NULL answers dropped."""
    ids = ["uuid", *independent]
    long = df.select(*ids, *[F.col(q).cast("string").alias(q) for q in questions]) \
        .unpivot(ids, list(questions), "dependent_var", "answer")
    return long.where(F.col("answer").isNotNull())


def _per_grouping(fine: DataFrame, keys: Sequence[str], independent: Sequence[str],
                  sums: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Counts per (grouping, value): sums over the other grouping columns of a
    table already grouped by all of them -- exact, tiny, and one GROUPING SETS
    pass, so ``fine`` is computed once."""
    ind = list(independent)
    sets = [[*keys, i] for i in ind]
    g = fine.groupingSets(sets, *keys, *ind).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.collect_list(c).alias(c) for c in lists],
        *[F.grouping(i).alias(f"__g_{i}") for i in ind])
    var, val = None, None
    for i in ind:
        hit = F.col(f"__g_{i}") == 0
        var = F.when(hit, F.lit(i)) if var is None else var.when(hit, F.lit(i))
        v = F.col(i).cast("string")
        val = F.when(hit, v) if val is None else val.when(hit, v)
    return g.select(*keys, var.alias("independent_var"), val.alias("independent_var_value"), *sums, *lists)


def _with_base(counts: DataFrame, column: str) -> DataFrame:
    """``base``: the sum of ``column`` over an area's answers to a question, by
    aggregation and join, so a question with many answers stays spread out."""
    keys = ["dependent_var", "independent_var", "independent_var_value"]
    base = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum(column).alias("base"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return counts.join(base, same).drop(*[f"__{k}" for k in keys])


def _merged_squares(parts: Column) -> Column:
    """Squared deviations of a group from its parts (n, m, m2), merged pairwise:
    no difference of large sums, so nearby large values keep their spread."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["m"] - a["m"]
        return F.struct(n.alias("n"), (a["m"] + d * b["n"] / n).alias("m"),
                        (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    return F.aggregate(F.array_sort(parts), zero, merge, lambda a: a["m2"])


def _finish(counts: DataFrame) -> DataFrame:
    """counts(dependent_var, independent_var, independent_var_value,
    dependent_var_value, n, base) -> summary stats with a binomial interval."""
    p = F.col("n") / F.col("base")
    se = F.sqrt(p * (1 - p) / F.col("base"))
    return counts.select(
        "dependent_var", "dependent_var_value", "independent_var", "independent_var_value",
        p.alias("numbers"), se.alias("se"), (p - Z95 * se).alias("min"),
        (p + Z95 * se).alias("max"),
        F.lit(None).cast("string").alias("repeat_var"),
        F.lit(None).cast("string").alias("repeat_var_value"))


def select_one_shares(df: DataFrame, questions: Sequence[str],
                      independent: Sequence[str] = ("country", "regions")) -> DataFrame:
    """Share of each answer among the area's respondents to the question.

    The answers are counted once per (question, answer, every grouping
    column); each grouping's counts are sums over that small table, so the
    raw answers are never multiplied by the number of groupings.
    """
    ind = list(independent)
    fine = _answers(df, questions, ind) \
        .groupBy("dependent_var", F.col("answer").alias("dependent_var_value"), *ind) \
        .agg(F.count(F.lit(1)).alias("n"))
    counts = _per_grouping(fine, ["dependent_var", "dependent_var_value"], ind, ["n"])
    return _finish(_with_base(counts, "n"))


def select_multiple_shares(df: DataFrame, questions: Sequence[str],
                           independent: Sequence[str] = ("country", "regions"),
                           sep: str = " ") -> DataFrame:
    """Share of the area's respondents who name each option.

    Options of one answer are de-duplicated first, so a plain count equals a
    distinct-respondent count and stays map-side reducible.  Each respondent's
    first option also carries the respondent itself (``pos = 0``), so option
    counts and the respondent base come out of the same single pass.
    """
    ind = list(independent)
    ans = _answers(df, questions, ind)
    opts = ans.select("dependent_var", *ind,
                      F.posexplode(F.array_distinct(F.split("answer", sep))).alias("pos", "option"))
    fine = opts.groupBy("dependent_var", F.col("option").alias("dependent_var_value"), *ind).agg(
        F.count(F.when(F.col("option") != "", 1)).alias("n"),
        F.count(F.when(F.col("pos") == 0, 1)).alias("b"))
    counts = _per_grouping(fine, ["dependent_var", "dependent_var_value"], ind, ["n", "b"])
    return _finish(_with_base(counts, "b").where(F.col("n") > 0))


def numeric_means(df: DataFrame, questions: Sequence[str],
                  independent: Sequence[str] = ("country", "regions")) -> DataFrame:
    """Mean with standard error and a 95% interval; text answers are
    cast to numbers, failures dropped.

    Answers are aggregated once per (question, every grouping column) into
    mergeable parts -- sums and count for the mean, count / mean / sum of
    squared deviations for the spread -- and each grouping combines its parts
    in one GROUPING SETS pass, so raw answers are never duplicated per
    grouping.  A group's parts are as many as the other grouping columns have
    values.
    """
    ind = list(independent)
    ids = ["uuid", *ind]
    long = df.select(*ids, *[X.to_number(F.col(q).cast("string")).alias(q) for q in questions]) \
        .unpivot(ids, list(questions), "dependent_var", "x") \
        .where(F.col("x").isNotNull())
    fine = long.groupBy("dependent_var", *ind).agg(
        F.sum(X.decimal_part("x")).alias("s"), F.sum(X.double_part("x")).alias("r"), X.finite_count("x").alias("nf"),
        F.count(F.when(X.is_inf("x"), 1)).alias("ninf"), F.count("x").alias("n"),
        F.struct(F.count("x").cast("double").alias("n"), F.avg("x").alias("m"),
                 (F.var_pop("x") * F.count("x")).alias("m2")).alias("part"))
    g = _per_grouping(fine, ["dependent_var"], ind, ["s", "r", "nf", "ninf", "n"], ["part"])
    n = F.col("n")
    se = F.when(n > 1, F.sqrt(_merged_squares(F.col("part")) / (n - 1)) / F.sqrt(n))
    numbers = F.when(F.col("ninf") == 0, X.mean_of(F.col("s"), F.col("r"), F.col("nf")))
    g = g.select("dependent_var", "independent_var", "independent_var_value",
                 numbers.alias("numbers"), se.alias("se"))
    return g.select(
        "dependent_var", F.lit(None).cast("string").alias("dependent_var_value"),
        "independent_var", "independent_var_value", "numbers", "se",
        (F.col("numbers") - Z95 * F.col("se")).alias("min"),
        (F.col("numbers") + Z95 * F.col("se")).alias("max"),
        F.lit(None).cast("string").alias("repeat_var"),
        F.lit(None).cast("string").alias("repeat_var_value"))


def analyse(select_one: tuple[DataFrame, Sequence[str]] | None = None,
            select_multiple: tuple[DataFrame, Sequence[str]] | None = None,
            numeric: tuple[DataFrame, Sequence[str]] | None = None,
            independent: Sequence[str] = ("country", "regions")) -> DataFrame:
    """The analysis plan's three kinds of question, one long table."""
    parts = []
    if select_one:
        parts.append(select_one_shares(select_one[0], select_one[1], independent))
    if select_multiple:
        parts.append(select_multiple_shares(select_multiple[0], select_multiple[1], independent))
    if numeric:
        parts.append(numeric_means(numeric[0], numeric[1], independent))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PLAN_KINDS = ("select_one", "select_multiple", "numeric")


def plan_questions(plan: DataFrame | Sequence[tuple[str, str]],
                   var_col: str = "dependent_variable",
                   kind_col: str = "dependent_variable_type") -> dict[str, list[str]]:
    """The analysis plan as {kind: [question, ...]}.  A plan is a short table
    of questions (metadata, like column names), so it is read on the driver."""
    rows = plan if not isinstance(plan, DataFrame) else \
        [(r[0], r[1]) for r in plan.select(var_col, kind_col).distinct().collect()]
    out: dict[str, list[str]] = {k: [] for k in PLAN_KINDS}
    for var, kind in rows:
        if kind not in out:
            raise ValueError(f"unknown question type {kind!r} for {var!r}")
        if var not in out[kind]:
            out[kind].append(var)
    return out


def analyse_plan(df: DataFrame, plan: DataFrame | Sequence[tuple[str, str]],
                 independent: Sequence[str] = ("country", "regions")) -> DataFrame:
    """M12 driven by an analysis plan: every planned question of ``df``,
    grouped once per kind, one long summary table."""
    qs = plan_questions(plan)
    return analyse(select_one=(df, qs["select_one"]) if qs["select_one"] else None,
                   select_multiple=(df, qs["select_multiple"]) if qs["select_multiple"] else None,
                   numeric=(df, qs["numeric"]) if qs["numeric"] else None,
                   independent=independent)


def first_match_labels(choices: DataFrame, seq: str = "seq",
                       list_name: str | None = None) -> DataFrame:
    """One label per code: the first in list order (J8).  With ``list_name``
    only that choice list is searched (a code shared by two lists then gets
    its own list's label)."""
    if list_name is not None:
        choices = choices.where(F.col("list_name") == list_name)
    return choices.groupBy("name").agg(F.min_by("label", seq).alias("label"))


def label_choices(stats: DataFrame, choices: DataFrame, keep_unmatched: bool = False,
                  list_name: str | None = None) -> DataFrame:
    """Answer codes -> labels by first match; an unknown code becomes NULL
    (or stays, with ``keep_unmatched``).  The label table is one row per code
    of a questionnaire; the planner broadcasts it when its size allows."""
    lab = first_match_labels(choices, list_name=list_name)
    j = stats.join(lab, stats["dependent_var_value"] == lab["name"], "left")
    val = F.coalesce(F.col("label"), F.col("dependent_var_value")) if keep_unmatched \
        else F.col("label")
    return j.select(*[val.alias(c) if c == "dependent_var_value" else F.col(c)
                      for c in stats.columns])


def attach_p_value(stats: DataFrame, tests: DataFrame) -> DataFrame:
    """Add a nullable ``p_value`` from a test table keyed by
    (dependent_var, independent_var); no test -> NULL, of several the smallest."""
    t = tests.groupBy("dependent_var", "independent_var").agg(F.min(F.col("p_value").cast("double")).alias("p_value"))
    return stats.join(t, ["dependent_var", "independent_var"], "left")


def format_stat(numbers: Column, lo: Column, hi: Column, percent: bool) -> Column:
    """a statistic as text, percent or 2 decimals, with ``(min-max)``.

    Percent: ``round(x*100)%``.  Otherwise the number and min at 2 decimals,
    max at 0 decimals; never in E notation.  A missing number is ``NA`` (``NA%``).
    No interval leaves one trailing blank.  ``0 (0-0)``
    and ``0% (0%-0%)`` collapse to ``0`` and ``0%``.
    """
    def num(x: Column, d: int) -> Column:
        r = X.half_even(x, d)
        plain = r.try_cast("decimal(38,2)").cast("string")  # beyond that and for NaN, Inf: the double's own text
        plain = F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1")
        return F.coalesce(F.regexp_replace(plain, r"\.$", ""), F.regexp_replace(r.cast("string"), r"\.0$", ""))

    def percent_text(x: Column) -> Column:
        return F.concat(X.na_text(num(x * 100, 0)), F.lit("%"))

    n2 = X.half_even(numbers, 2)
    if percent:
        main, lo_s, hi_s = percent_text(n2), percent_text(lo), percent_text(hi)
    else:
        main = num(n2, 2)
        lo_s, hi_s = num(lo, 2), num(hi, 0)
    interval = F.when(lo.isNull() & hi.isNull(), F.lit("")) \
        .otherwise(F.concat(F.lit("("), X.na_text(lo_s), F.lit("-"), X.na_text(hi_s), F.lit(")")))
    s = F.concat(X.na_text(main), F.lit(" "), interval)
    return F.when(s == "0 (0-0)", F.lit("0")).when(s == "0% (0%-0%)", F.lit("0%")).otherwise(s)
