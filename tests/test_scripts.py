from lodestone.functions import scripts
from lodestone.operators import structure


def test_forms_and_noise(spark):
    row = spark.createDataFrame([("ﻛﺘﺎﺏ ﻱ", "c b a 12", "a ■ b\n\n\n\nc ### d")], "f string, r string, n string").select(
        scripts.unify_letters("f").alias("f"), scripts.has_presentation_forms("f").alias("p"), scripts.reverse_words("r").alias("r"), scripts.reverse_letters("r").alias("l"), scripts.clean_ocr("n").alias("n"), scripts.keyboard_similarity("r", "r").alias("k")
    ).first()
    assert row["f"] == "کتاب ی" and row["p"] and row["r"] == "12 a b c" and row["l"] == "12 a b c" and "■" not in row["n"] and "###" not in row["n"] and "\n\n\n" not in row["n"] and row["k"] == 1


def test_lines_run_from_the_right(spark):
    boxes = spark.createDataFrame([(1, "left", 0.0, 10.0, 10.0, 20.0), (1, "right", 50.0, 12.0, 60.0, 22.0), (1, "below", 0.0, 60.0, 10.0, 70.0)], "p int, text string, x1 double, y1 double, x2 double, y2 double")
    assert [(r["line"], r["text"]) for r in structure.text_lines(boxes, "p").orderBy("line").collect()] == [(0, "right left"), (1, "below")]
