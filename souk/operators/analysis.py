"""The analysis plan and the questionnaire as data (M12, S4; M13, J8).

A plan row names a question, the variable that groups its answers and, if any,
the variable for each of whose values the analysis is repeated.  Plan,
questions and choice lists stay tables: the respondents' cells are turned to
long form once, with all cells of a respondent at hand as a map, and joined to
the plan on the question; the plan row then looks its grouping and repeat
values up in the map.  One aggregation serves every row of the plan and every
kind of question, and nothing of the plan is read on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.operators.survey import Z95

SELECT_ONE, SELECT_MULTIPLE, NUMERIC = "select_one", "select_multiple", "numeric"
KINDS = (SELECT_ONE, SELECT_MULTIPLE, NUMERIC)
#: The form's types of a numeric question.
NUMBER_TYPES = ("integer", "decimal", "calculate")
PLAN_COLS = ["question", "kind", "independent", "repeat"]


def question_lists(questions: DataFrame) -> DataFrame:
    """question, kind, list_name from the questionnaire's (name, type), where a type
    is ``select_one <list>``, ``select_multiple <list>`` or the type of a number."""
    parts = F.split(F.trim("type"), r"\s+")
    first = parts[0]
    kind = F.when(first.isin(SELECT_ONE, SELECT_MULTIPLE), first).when(first.isin(*NUMBER_TYPES), F.lit(NUMERIC))
    return questions.select(F.col("name").alias("question"), kind.alias("kind"),
                            F.when(first.isin(SELECT_ONE, SELECT_MULTIPLE), F.get(parts, F.lit(1))).alias("list_name")) \
        .groupBy("question").agg(F.min(F.struct("kind", "list_name")).alias("q")).select("question", "q.kind", "q.list_name")


def plan_rows(plan: DataFrame, questions: DataFrame) -> DataFrame:
    """The distinct rows (question, kind, independent, repeat) of a plan as it is
    filed (dependent_variable, dependent_variable_type, independent_variable,
    repeat_for_variable).  The questionnaire decides the kind; for a question it
    lacks, the plan's own ``numerical`` or ``categorical`` does."""
    own = F.lower("dependent_variable_type")
    filed = plan.select(F.col("dependent_variable").alias("question"),
                        F.when(own.isin(*KINDS), own).when(own == "numerical", F.lit(NUMERIC))
                        .when(own == "categorical", F.lit(SELECT_ONE)).alias("own"),
                        F.col("independent_variable").alias("independent"), F.col("repeat_for_variable").alias("repeat"))
    return filed.join(question_lists(questions).select("question", "kind"), "question", "left") \
        .select("question", F.coalesce("kind", "own").alias("kind"), "independent", "repeat").distinct()


def plan_problems(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plan rows that cannot be analysed on a table with these columns, and why."""
    names = list(columns)

    def unknown(c: str) -> Column:
        return F.coalesce(~F.col(c).isin(names), F.lit(c != "repeat"))

    reason = (F.when(F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)), F.lit("unknown_kind"))
              .when(unknown("question"), F.lit("unknown_question"))
              .when(unknown("independent"), F.lit("unknown_independent"))
              .when(F.col("repeat").isNotNull() & unknown("repeat"), F.lit("unknown_repeat")))
    return plan.select(*PLAN_COLS, reason.alias("reason")).where(F.col("reason").isNotNull())


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(right, same).drop(*[f"__{k}" for k in keys])


def analyse_by_plan(df: DataFrame, plan: DataFrame, id_col: str = "uuid", sep: str = " ") -> DataFrame:
    """Every row of ``plan`` that the columns of ``df`` allow, as summary statistics.

    Shares per answer (select one), shares per named option (select multiple,
    options of one answer counted once) and means, all with a 95 % interval, per
    value of the grouping variable and, where the plan names one, per value of the
    repeat variable.  A NULL grouping value is a group; respondents without a
    repeat value are left out of the repeated rows; answers that are no numbers
    are left out of means.  Rows for other columns: ``plan_problems``.
    """
    names = [c for c in df.columns if c != id_col]
    cells = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"`{c}`").cast("string") for c in names]))
    usable = plan.select(*PLAN_COLS).where(F.col("kind").isin(*KINDS) & F.col("question").isin(names) & F.col("independent").isin(names)
                                           & (F.col("repeat").isNull() | F.col("repeat").isin(names)))
    asked = df.select(cells.alias("__c")).select("__c", F.explode("__c").alias("question", "__answer")).where(F.col("__answer").isNotNull())
    # the plan is the short side; left to the planner, the respondents' cells may be the side it sends to the driver:
    # their size is estimated from the packed file
    rows = asked.join(F.broadcast(usable), "question")
    c, answer = F.col("__c"), F.col("__answer")
    number = F.when(F.col("kind") == NUMERIC, X.to_number(answer))
    options = (F.when(F.col("kind") == SELECT_ONE, F.array(answer)).when(F.col("kind") == SELECT_MULTIPLE, F.array_distinct(F.split(answer, sep)))
               .otherwise(F.array(F.lit(None).cast("string"))))
    rows = rows.select("question", "kind", "independent", c[F.col("independent")].alias("independent_value"), "repeat",
                       F.when(F.col("repeat").isNotNull(), c[F.col("repeat")]).alias("repeat_value"), number.alias("x"),
                       options.alias("options"))
    rows = rows.where((F.col("repeat").isNull() | F.col("repeat_value").isNotNull()) & ((F.col("kind") != NUMERIC) | F.col("x").isNotNull()))

    keys = ["question", "kind", "independent", "independent_value", "repeat", "repeat_value"]
    counts = rows.select(*keys, "x", F.posexplode("options").alias("pos", "option")).groupBy(*keys, "option").agg(
        F.count(F.when(F.col("option") != "", 1)).alias("n"), F.count(F.when(F.col("pos") == 0, 1)).alias("b"),
        X.mean_of(F.sum(X.decimal_part("x")), F.sum(X.double_part("x")), X.finite_count("x")).alias("mean"),
        F.count(F.when(X.is_inf("x"), 1)).alias("ninf"), F.count("x").alias("nx"), F.stddev_samp("x").alias("sd"))
    base = counts.groupBy(*keys).agg(F.sum("b").alias("base"))
    counts = _null_safe_join(counts, base, keys).where((F.col("kind") == NUMERIC) | (F.col("n") > 0))

    share = F.col("n") / F.col("base")
    numbers = F.when(F.col("kind") != NUMERIC, share).when(F.col("ninf") == 0, F.col("mean"))
    se = F.when(F.col("kind") != NUMERIC, F.sqrt(share * (1 - share) / F.col("base"))) \
        .when(F.col("nx") > 1, F.col("sd") / F.sqrt(F.col("nx")))
    out = counts.select(F.col("question").alias("dependent_var"), F.col("option").alias("dependent_var_value"),
                        F.col("independent").alias("independent_var"), F.col("independent_value").alias("independent_var_value"),
                        numbers.alias("numbers"), se.alias("se"), F.col("repeat").alias("repeat_var"),
                        F.col("repeat_value").alias("repeat_var_value"))
    return out.select("dependent_var", "dependent_var_value", "independent_var", "independent_var_value", "numbers", "se",
                      (F.col("numbers") - Z95 * F.col("se")).alias("min"), (F.col("numbers") + Z95 * F.col("se")).alias("max"),
                      "repeat_var", "repeat_var_value")


def list_labels(questions: DataFrame, choices: DataFrame, seq: str = "seq") -> DataFrame:
    """question, code, label: the first label of a code in the question's own choice list."""
    first = choices.groupBy("list_name", F.col("name").alias("code")).agg(F.min_by("label", seq).alias("label"))
    return question_lists(questions).join(first, "list_name").select("question", "code", "label")


def label_by_list(stats: DataFrame, questions: DataFrame, choices: DataFrame, keep_unmatched: bool = False,
                  pairs: Sequence[tuple[str, str]] = (("dependent_var", "dependent_var_value"),)) -> DataFrame:
    """Codes to labels by each question's own list: question -> list -> code.

    ``pairs`` names the (variable, value) columns to label.  A code shared by two
    lists gets the label of the list its question uses; of a code listed twice the
    first label counts.  A code the list lacks becomes NULL, or stays with
    ``keep_unmatched``; so do all values of a question without a list, such as a
    number.
    """
    labels = list_labels(questions, choices)
    columns = stats.columns
    for i, (variable, value) in enumerate(pairs):
        own = labels.select(F.col("question").alias(f"__q{i}"), F.col("code").alias(f"__c{i}"), F.col("label").alias(f"__l{i}"))
        stats = stats.join(own, (F.col(variable) == F.col(f"__q{i}")) & (F.col(value) == F.col(f"__c{i}")), "left")
    out = {value: F.coalesce(f"__l{i}", value) if keep_unmatched else F.col(f"__l{i}") for i, (_, value) in enumerate(pairs)}
    return stats.select(*[out[c].alias(c) if c in out else F.col(c) for c in columns])
