import pytest

from lodestone.plans.analysis import analyse
from lodestone.plans.answering import Step, TableSchema, answer_rows, names_in, plan_filter, rows_of, run_steps

SCHEMA = TableSchema("who", "paid", "year")


@pytest.fixture(scope="module")
def paid(spark):
    return spark.createDataFrame([("new york", 10.0, 1400), ("york", 5.0, 1401), ("paris", 7.0, 1401), (None, 1.0, 1401), ("", 2.0, None)], "who string, paid double, year int")


def test_names_in_a_question(spark, paid):
    assert names_in("total budget of Paris and New-York", paid, "who") == ["paris", "new york"]
    assert names_in("total budget", paid, "who") == [] == names_in("paris", paid.limit(0), "who")


def test_rows_of_questions(spark, paid):
    assert answer_rows("total cost of york in 1401", paid, SCHEMA).first()["total"] == 5.0
    assert answer_rows("total cost in 1399", paid, SCHEMA).first()["total"] == 0
    assert [r["who"] for r in answer_rows("top 2 by cost", paid, SCHEMA).collect()] == ["new york", "paris"]
    assert paid.where(plan_filter(SCHEMA)).count() == 5 and paid.where(plan_filter(SCHEMA, (), (), ("who", "ew-yo"))).count() == 1


@pytest.mark.parametrize("text", ["who are you", "balance of 1401"])
def test_what_no_table_answers(paid, text):
    with pytest.raises(ValueError):
        rows_of(analyse(text), paid, SCHEMA)


def test_steps_run_after_what_they_need(spark):
    tools = {"range": lambda n: spark.range(n), "both": lambda step_1_result, step_2_result: step_1_result.unionAll(step_2_result)}
    out = run_steps([Step(3, "both", needs=[1, 2]), Step(1, "range", {"n": 2}), Step(2, "range", {"n": 3})], tools)
    assert out[3].count() == 5 and run_steps([], tools) == {}


@pytest.mark.parametrize("steps", [[Step(1, "none")], [Step(1, "range", {"n": 1}, [9])], [Step(1, "both", needs=[2]), Step(2, "both", needs=[1])], [Step(1, "range"), Step(1, "range")]])
def test_plans_that_cannot_run(steps):
    with pytest.raises(ValueError):
        run_steps(steps, {"range": None, "both": None})
