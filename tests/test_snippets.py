"""The snippet parser on one case of each kind, with types and faults."""

import pytest

from runlens.functions import snippets


@pytest.mark.parametrize(
    ("text", "kind", "fields", "fault"),
    [
        ('{"a": 1, "b": "x", "c": null, "d": [1, 2], "e": {"f": true}, "g": false}', "json", {"a": ("number", "1"), "b": ("string", "x"), "c": ("null", None), "d": ("array", "[1,2]"), "e": ("object", '{"f":true}'), "g": ("boolean", "false")}, 0),
        ("quantity: -10", "pairs", {"quantity": ("number", "-10")}, 0), ("lat: 0, lon: 0.5", "pairs", {"lat": ("number", "0"), "lon": ("number", "0.5")}, 0),
        ('{item_id: "x",', "pairs", {"item_id": ("string", "x")}, 0), ("coordinates: [32, 34]", "pairs", {"coordinates": ("array", "[32, 34]")}, 0),
        ("a=1; b = two words ; a=3", "pairs", {"a": ("number", "1"), "b": ("string", "two words")}, 0), ("(ok: true, n: undefined)", "pairs", {"ok": ("boolean", "true"), "n": ("null", "undefined")}, 0),
        ("msg: failed (code 3)", "pairs", {"msg": ("string", "failed (code 3)")}, 0), (" (a: 1, b)", "pairs", {"a": ("number", "1")}, 7), ("a: 1, b", "pairs", {"a": ("number", "1")}, 5), ("a: 1, , b: 2", "pairs", {"a": ("number", "1")}, 5), ("<tag>", "text", {}, 1), ("plain words", "text", {}, 1), ("", "text", {}, 0), (None, "text", {}, 0), ("[1, 2]", "text", {}, 1),
        ('{"a": 1', "text", {}, 1), ("x: {y: 1}, z: 'q, r'", "pairs", {"x": ("object", "{y: 1}"), "z": ("string", "q, r")}, 0),
    ],
)
def test_snippets(spark, text, kind, fields, fault):
    r = spark.createDataFrame([(text,)], "s string").select(snippets.parsed(snippets.F.col("s")).alias("p")).first()["p"]
    assert (r["kind"], {k: (v["type"], v["value"]) for k, v in r["fields"].items()}, r["fault"]) == (kind, fields, fault)
