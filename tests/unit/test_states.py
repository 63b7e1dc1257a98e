from pyspark.sql import types as T

from tidemark.sources.readers import decoded, newest_states

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_defects_are_set_aside(spark):
    said = {"fine": '{"a": 1, "b": "x"}', "new": '{"a": 2, "c": [1], "d": 0}', "cut": '{"a": 1', "list": "[1]", "text": "nothing", "typed": '{"a": "one", "b": "x"}', "lacking": '{"b": "x"}', "null": '{"a": null}', "blank": " ", "none": None}
    rows = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(said.items())], "k string, at int, said string")
    out = {r["k"]: r for r in decoded(rows, "said", SCHEMA, ["a"]).collect()}
    assert {k: r["defect"] for k, r in out.items()} == {
        "fine": None, "new": None, "cut": "corrupt", "list": "corrupt", "text": "corrupt", "typed": "mistyped", "lacking": "missing", "null": "missing", "blank": "absent", "none": "absent",
    }
    assert out["fine"]["state"].asDict() == {"a": 1, "b": "x"} and out["new"]["drift"] == ["c", "d"]
    assert all((r["state"] is None) == (r["defect"] is not None) for r in out.values())


def test_the_newest_usable_states_stay(spark):
    rows = spark.createDataFrame([("k", i, '{"a": %d}' % i if i != 4 else "{") for i in range(5)], "k string, at int, said string")
    usable, aside = newest_states(rows, "said", SCHEMA, "k", "at", 2, ["a"])
    assert sorted(r["state"]["a"] for r in usable.collect()) == [2, 3] and [(r["at"], r["defect"]) for r in aside.collect()] == [(4, "corrupt")]
