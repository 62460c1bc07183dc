"""Questions from competing readings."""

from graphloom.operators import clarify as C

DIFFERENCES = "requirement string, place int, divergent long, severity string, names array<string>"


def _asked(spark, pairs, known=()):
    """Questions of requirements (key, what the names say); their readings say the key."""
    drafts = [(k, place, t, f"It is about {t} {k}.") for k, _ in pairs for place, t in enumerate("ab")]
    drafts = spark.createDataFrame(drafts, "requirement string, place int, title string, assumption string")
    differences = spark.createDataFrame([(k, 1, 2, "important", [f"N{name}"]) for k, name in pairs], DIFFERENCES)
    return C.questions(drafts, differences, spark.createDataFrame([(q,) for q in known], "question string")).collect()


def test_different_questions_of_one_id_are_all_asked(spark):
    """The ids are of 32 bits; these two questions have the same one."""
    pairs = [("41100", "41100"), ("117810", "117810")]
    rows = {r["requirement"]: r for r in _asked(spark, pairs)}
    assert set(rows) == {"41100", "117810"} and len({r["id"] for r in rows.values()}) == 1
    assert {r["requirement"] for r in _asked(spark, pairs, [rows["41100"]["question"].upper() + " "])} == {"117810"}
