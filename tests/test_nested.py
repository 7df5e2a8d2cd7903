import json

from pyspark.sql import functions as F

from sleuthgrid.functions.nested import flat_object, json_leaves, json_values


def walk(x):
    if isinstance(x, dict):
        return [v for k in sorted(x) for v in walk(x[k])]
    if isinstance(x, list):
        return [v for e in x for v in walk(e)]
    return [] if x is None else [json.dumps(x) if not isinstance(x, str) else x]


def test_values_of_all_levels(spark):
    made = [{"b": {"c": [1, 2.5, {"z": "x"}], "e": True, "n": None}, "a": "t", "d": [], "f": {}}, [], [[["deep"]], "é \n\"q\""], "just text", 5, {"k": [{"l": [{"m": [{"n": -7}]}]}]}]
    texts = [json.dumps(x) for x in made]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(json_values(F.col("t")).alias("v")).collect()
    assert [r["v"]["values"] for r in rows] == [walk(x) for x in made] and all(r["v"]["valid"] for r in rows)


def test_paths_depth_and_texts_that_are_no_json(spark):
    deep = json.dumps({"a": {"b": [{"c": {"d": 1}}], "e": 2}})
    rows = spark.createDataFrame([(0, deep), (1, "no json"), (2, None), (3, ""), (4, "[" * 5000)], "i int, t string").orderBy("i")
    got = rows.select(json_leaves(F.col("t")).alias("all"), json_leaves(F.col("t"), 2).alias("two"), json_values(F.col("t")).alias("v")).collect()
    assert [tuple(x) for x in got[0]["all"]] == [("a.b.c.d", "1"), ("a.e", "2")] and [tuple(x) for x in got[0]["two"]] == [("a.e", "2")]
    assert [r["all"] for r in got[1:]] == [None] * 4
    assert [(r["v"]["values"], r["v"]["valid"]) for r in got[1:]] == [(["no json"], False), ([], False), ([], False), (["[" * 5000], False)]


def test_repeated_names_and_no_python(spark):
    df = spark.createDataFrame([('{"A": 1, "a": 2, "b": {"C": {"x": 1}, "c": {"X": "y"}}}',), ('{"x": {}, "y": [[1, 2]], "z": [{"q": 1}]}',)], "t string").select(flat_object(F.try_parse_json("t")).alias("r"))
    assert [r["r"] for r in df.collect()] == [{"a": "2", "b.c.x": "y"}, {"y": "[1,2]", "z": '{"q":1}'}]
    assert "Python" not in df._jdf.queryExecution().toString()
