"""Gates on literal cases: each has accepted and rejected rows."""

import pytest
from pyspark.sql import functions as F

from gatehouse.functions import code as C
from gatehouse.operators import gates as G

def P():
    return F.col("p")


def A():
    return F.col("a")


def reasons(spark, rows, fn):
    data = [(i, *r) for i, r in enumerate(rows)]
    names = ["i", "p", "a", "o"][: len(data[0])]
    df = spark.createDataFrame(data, ", ".join(f"{n} {'INT' if n == 'i' else 'STRING'}" for n in names))
    return [r.r for r in df.select("i", fn().alias("r")).orderBy("i").collect()]


def code(reason):
    return reason and reason.split(":")[0]


CASES = {
    "sentiment": (lambda: G.gate_sentiment(P(), A()), [
        ("Fine shop.", "Positive. The buyer praises the shop.", None),
        ("Fine shop.", "It is Positive, says the buyer of it.", "no_leading_label"),
        ("Fine shop.", "Positive. Yes.", "no_justification"),
        ("Nice but slow.", "Neutral. The pace is disliked by them.", "one_sided_reason"),
        ("Nice but slow.", "Neutral. Nice, yet slow to arrive.", None),
        ("'Slow, but it was excellent.'", "Negative. Slow, although excellent.", "praise_labelled_negative"),
        ("'Slow, but nothing good came.'", "Negative. Slow, although cheap enough.", None),
    ]),
    "summary": (lambda: G.gate_summary(P(), A()), [
        ("In exactly two sentences: 'x'", "One here. Two here.", None),
        ("In exactly two sentences: 'x'", "Only one here.", "unit_count"),
        ("exactly 2 bullet points, each at most four words", "- a b c d\n* e f", None),
        ("exactly 2 bullet points, each at most four words", "- a b c d e\n- f", "unit_over_cap"),
        ("exactly two sentences; it must mention the percentage", "A rise. A fall.", "percentage_missing"),
        ("exactly two sentences: 'one two three four five six seven eight nine'",
         "He said one two three four five six seven eight. Done.", "source_echo"),
        ("Summarise freely: 'one two three four five six seven eight nine'",
         "one two three four five six seven eight nine", None),
    ]),
    "factual": (lambda: G.gate_factual(P(), A()), [
        ("Why?", "A. B. C. D.", None),
        ("Why?", "A. B. C. D. E.", "too_many_sentences"),
        ("Why?", "I don't know that.", "refusal"),
        ("What is the difference between HTTP and TCP in a network?", "HTTP rides on it.", "term_missing"),
        ("What is the difference between HTTP and TCP in a network?", "http rides on tcp.", None),
    ]),
    "entities": (lambda: G.gate_entities(P(), A()), [
        ("In 2021 they met.", "DATE: 2021", None),
        ("In 2021 they met.", "none", "omits_year"),
        ("We saw Ada Lovelace there.", "PERSON: Ada Lovelace", None),
        ("On March we saw it. On March Ada spoke", "March Ada", None),
        ("We saw Ada Lovelace there.", "PERSON: Ada", "omits_name"),
        ("They went to Paris today.", "nothing", "omits_capital"),
        ("the NATO and AI talks", "ORGANIZATION: none", "omits_acronym"),
        ("x", "LOCATION: NASA", "acronym_as_location"),
        ("x", "PERSON: Moon Mission", "programme_mislabelled"),
        ("x", "DATE: Zurich", "not_a_date"),
        ("x", "DATE: May", None),
        ("x", "Outside the inventory: CERN", "organisation_in_note"),
    ]),
    "plausible": (lambda: G.gate_plausible(P(), A()), [
        ("How many remain?", "-5 units", "negative_amount"), ("How many remain?", "5 - 3 units", None),
        ("What is the total cost?", "It is 12.", "cost_missing"), ("What is the total cost?", "$12", None),
        ("One? Two?", "12", "one_number_for_two_questions"), ("One? Two?", "12 and 13", None),
        ("It made £5.", "$5", "foreign_currency"), ("It made 5.", "$5", None),
    ]),
    "ratio": (lambda: G.gate_ratio_shares(P(), A()), [
        ("Split £1,200 in the ratio 1:2:3.", "£200, £400 and £600", None),
        ("Split £1,200 in the ratio 1:2:3.", "£200, £400 and £500", "share_missing"),
        ("Share 100 sweets in the ratio 2:1.", "about 66", None),
    ]),
    "magnitude": (lambda: G.gate_magnitude(P(), A()), [
        ("It made $238,049.", "$2,380", "far_below_prompt_scale"), ("It made $238,049.", "$200,000", None),
        ("Of 3,200 units", "16,224", "far_above_prompt_scale"), ("Of 3,200 units", "1,600", None),
    ]),
    "meeting": (lambda: G.gate_meeting_time(P(), A()), [
        ("A leaves at 9:00 doing 80 km/h, B at 9:30 doing 60 km/h, 250 km apart.", "At 11:00, 160 km from A.", None),
        ("A leaves at 9:00 doing 80 km/h, B at 9:30 doing 60 km/h, 250 km apart.", "At 11:00, 90 km from A.",
         "distance_inconsistent"),
        ("A leaves at 9:00 doing 80 km/h, B at 9:30 doing 60 km/h, 250 km apart.", "At 09:10.", "outside_physical_bounds"),
        ("A leaves at 9:00 doing 80 km/h, B at 9:30 doing 60 km/h, 250 km apart.", "Soon.", "no_clock_time"),
        ("A leaves at 9:00 doing 80 km/h, B at 9:30 doing 60 km/h, 250 km apart.", "At 25:99.", "malformed_clock_time"),
        ("A car does 80 km/h.", "Soon.", None),
    ]),
}


@pytest.mark.parametrize("name", CASES)
def test_gate(spark, name):
    fn, rows = CASES[name]
    assert [code(r) for r in reasons(spark, [r[:2] for r in rows], fn)] == [r[2] for r in rows]


def test_pivot(spark):
    filler = "words keep coming along the river bank " * 3
    prompt = f"exactly two sentences: 'Harvests prospered. {filler} However, {filler} droughts followed.'"
    got = reasons(spark, [(prompt, "Harvests prospered, then droughts."), (prompt, "Harvests prospered only."),
                          (prompt, "Droughts came.")], lambda: G.gate_summary_pivot(P(), A()))
    assert got == [None, "omits_after_pivot", "omits_before_pivot"]


def test_grounded(spark):
    rows = [("", "It is 42.", "42"), ("", "It is 43.", "42"), ("", "About 1.62.", "1.61803"), ("", "About 1.62.", "1.625"),
            ("", "No.", "ready"), ("", "All ready now.", "ready"), ("", "Part 1: nothing.", "77")]
    got = [code(r) for r in reasons(spark, rows, lambda: G.gate_grounded(A(), F.col("o")))]
    assert got == [None, "number_not_derivable", None, "number_not_derivable", "output_not_echoed", None, "output_ignored"]


def test_list_echo(spark):
    rows = [("", "[13,13]", "[13, 13]\nx"), ("", "13", "[13, 13]\nx"), ("", "13", "none")]
    assert reasons(spark, rows, lambda: G.gate_list_echo(A(), F.col("o"))) == [None, "list_not_echoed", None]


def test_code_gates(spark):
    df = spark.createDataFrame([
        (0, "Write a function called add. For example, add(1, 2) should return 3.", "def add(a, b):\n    return a + b"),
        (1, "Write a function called add. For example, add(1, 2) should return 3.", "def add(a, b:\n    return a"),
        (2, "Write a function called add. For example, add(1, 2) should return 3.", "def plus(a):\n    return a"),
        (3, "Write a function called add.", "def add(a):\n    return a"),
        (4, "Write a function called add, add(1) gives 1.", "def add(a):\n    return a"),
    ], "i INT, p STRING, a STRING")
    got = df.withColumn("ok", C.python_parses(G.code_to_parse(P(), A()))).select(
        "i", G.gate_code_static(P(), A(), F.col("ok")).alias("r"), "ok").orderBy("i").collect()
    assert [code(r.r) for r in got] == [None, "does_not_parse", "function_absent", "no_example_call", "example_not_executable"]
    assert got[2].ok is None  # a rejected row never reaches Python


def test_dispatch_marks_empty_and_unknown(spark):
    rows = spark.createDataFrame([("logical", "p", "too short"), ("maths", "p", "12"), ("maths", "p", " "), ("other", "p", "x")],
                                 "family STRING, prompt STRING, answer STRING")
    got = {(r.family, r.answer): (r.reason, r.accepted) for r in G.gate(rows).collect()}
    assert got[("logical", "too short")] == ("too_short", False)
    assert got[("maths", "12")] == (None, True)
    assert got[("maths", " ")] == ("empty_answer", False)
    assert got[("other", "x")] == (None, True)


def test_value_near_name(spark):
    def truth():
        return F.array(F.struct(F.lit("n").alias("name"), F.lit("12").alias("value")))

    far = "n is set. " + "z" * 120 + " 12"
    rows = [("", "n is 12"), ("", far), ("", "12 it is, then"), ("", far + " so n = 12")]
    got = [code(r) for r in reasons(spark, rows, lambda: G.gate_value_near_name(A(), truth()))]
    assert got == [None, "value_not_near", "value_not_near", None]
