"""The analysis plan as data and labels by the question's own list."""

import math
import statistics

import pytest

from souk.operators import analysis as A
from test_plans import physical

PEOPLE = [
    # uuid, area, sex, water, tools, age
    ("1", "n", "f", "yes", "a b", "10"), ("2", "n", "m", "no", "a a", "20"), ("3", "s", "f", "yes", None, "x"),
    ("4", "s", None, "yes", "", "40"), ("5", None, "m", "no", "b", "50.5"), ("6", "n", "f", None, "c a", None),
]
PLAN = [
    ("water", "categorical", "area", None), ("water", "categorical", "area", "sex"), ("tools", "categorical", "sex", None),
    ("age", "numerical", "area", None), ("age", "numerical", "sex", "water"), ("water", "categorical", "area", None),
    ("nothing", "categorical", "area", None), ("water", "categorical", "nowhere", None), ("water", "categorical", "area", "never"),
    ("water", "odd", "sex", None), (None, "categorical", "area", None),
]
QUESTIONS = [("water", "select_one yes_no"), ("tools", "select_multiple  tools"), ("age", "integer"), ("sex", "select_one sexes"),
             ("note", "text")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "uuid string, area string, sex string, water string, tools string, age string")


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "name string, type string")


@pytest.fixture
def plan(spark, questions):
    filed = spark.createDataFrame(PLAN, "dependent_variable string, dependent_variable_type string, independent_variable string, "
                                        "repeat_for_variable string")
    return A.plan_rows(filed, questions)


def brute():
    cols = ["uuid", "area", "sex", "water", "tools", "age"]
    people = [dict(zip(cols, p)) for p in PEOPLE]
    kinds = {"water": "one", "tools": "many", "age": "number"}
    out = {}
    for question, _, by, repeat in dict.fromkeys(PLAN):
        if question not in kinds or by not in cols or repeat not in (None, *cols):
            continue
        groups = {}
        for p in people:
            if p[question] is not None and (repeat is None or p[repeat] is not None):
                groups.setdefault((p[by], p[repeat] if repeat else None), []).append(p[question])
        for (g, r), answers in groups.items():
            key = (question, by, g, repeat, r)
            if kinds[question] == "number":
                numbers = [float(a) for a in answers if a.replace(".", "").isdigit()]
                if numbers:
                    se = statistics.stdev(numbers) / math.sqrt(len(numbers)) if len(numbers) > 1 else None
                    out[(*key, None)] = (statistics.mean(numbers), se)
                continue
            split = [{a} if kinds[question] == "one" else set(a.split(" ")) for a in answers]
            for option in set().union(*split) - {""}:
                share = sum(option in s for s in split) / len(answers)
                out[(*key, option)] = (share, math.sqrt(share * (1 - share) / len(answers)))
    return out


def test_every_row_of_the_plan(people, plan):
    got = {}
    for r in A.analyse_by_plan(people, plan).collect():
        key = (r.dependent_var, r.independent_var, r.independent_var_value, r.repeat_var, r.repeat_var_value, r.dependent_var_value)
        assert key not in got
        got[key] = (r.numbers, r.se)
        if r.se is not None:
            assert r.min == pytest.approx(r.numbers - 1.96 * r.se) and r.max == pytest.approx(r.numbers + 1.96 * r.se)
    want = brute()
    assert got.keys() == want.keys()
    for key, (numbers, se) in want.items():
        assert got[key][0] == pytest.approx(numbers) and (got[key][1] is None) == (se is None), key
        assert se is None or got[key][1] == pytest.approx(se)


def test_rows_that_cannot_be_analysed(people, plan, spark):
    got = sorted((r.question or "", r.independent, r.repeat or "", r.reason) for r in A.plan_problems(plan, people.columns).collect())
    # the questionnaire knows the kind of "water" whatever the plan says
    assert got == [("", "area", "", "unknown_question"), ("nothing", "area", "", "unknown_question"),
                   ("water", "area", "never", "unknown_repeat"), ("water", "nowhere", "", "unknown_independent")]
    odd = spark.createDataFrame([("water", "odd", "area", None)], "question string, kind string, independent string, repeat string")
    assert [r.reason for r in A.plan_problems(odd, people.columns).collect()] == ["unknown_kind"]
    assert A.analyse_by_plan(people, odd).count() == 0
    assert A.analyse_by_plan(people.limit(0), plan).count() == 0


def test_the_plan_is_joined_not_read(people, plan):
    text = physical(A.analyse_by_plan(people, plan))
    assert "Join" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_the_plan_is_the_side_that_travels(spark, people, plan, tmp_path):
    """A packed file of respondents looks smaller than the plan; its cells must not go to the driver."""
    people.write.parquet(str(tmp_path / "people"))
    text = physical(A.analyse_by_plan(spark.read.parquet(str(tmp_path / "people")), plan))
    joins = [ln for ln in text.splitlines() if "Join [question#" in ln and "Inner" in ln]
    assert joins and all("BroadcastHashJoin" in ln and "BuildRight" in ln for ln in joins)


def test_kinds_and_lists(questions):
    got = {r.question: (r.kind, r.list_name) for r in A.question_lists(questions).collect()}
    assert got == {"water": ("select_one", "yes_no"), "tools": ("select_multiple", "tools"), "age": ("numeric", None),
                   "sex": ("select_one", "sexes"), "note": (None, None)}


def test_a_shared_code_has_the_label_of_its_list(spark, questions):
    choices = spark.createDataFrame([
        (1, "yes_no", "1", "Yes"), (2, "yes_no", "2", "No"), (1, "sexes", "1", "Female"), (2, "sexes", "2", "Male"),
        (9, "sexes", "1", "later label"), (1, "unused", "1", "other")], "seq int, list_name string, name string, label string")
    stats = spark.createDataFrame([("water", "1", "sex", "1"), ("water", "2", "sex", "7"), ("age", None, "sex", "2"), ("age", "1", "area", "1"),
                                   ("tools", "1", "sex", None)],
                                  "dependent_var string, dependent_var_value string, independent_var string, independent_var_value string")
    both = (("dependent_var", "dependent_var_value"), ("independent_var", "independent_var_value"))
    got = sorted(map(tuple, A.label_by_list(stats, questions, choices, True, both).collect()), key=str)
    assert got == sorted([("water", "Yes", "sex", "Female"), ("water", "No", "sex", "7"), ("age", None, "sex", "Male"),
                          ("age", "1", "area", "1"), ("tools", "1", "sex", None)], key=str)
    strict = A.label_by_list(stats, questions, choices).collect()
    assert sorted(str(r.dependent_var_value) for r in strict) == ["No", "None", "None", "None", "Yes"]
