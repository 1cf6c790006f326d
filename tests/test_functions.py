from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.functions import ids, props, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_short_words(spark):
    got = values(spark, [("red green",), ("red",), ("",), (None,), ("a bcde f",)], "x string", F.array_join(F.transform(text.tokens(F.col("x"), 4), lambda t: F.concat(t["token"], F.lit("@"), t["pos"].cast("string"))), " "))
    assert [g[0] for g in got] == ["redgreen@0 green@1", "", "", "", "abcde@0 bcde@1 bcdef@2"]
    assert text.query_tokens("red green", 4) == ["redgreen", "green"] and text.query_tokens("red", 4) == []
    assert text.query_words("Ärger, 3-fach!") == ["ärger", "3", "fach"]


def test_phrases(spark):
    rows = [("The cat, SAT.",), ("cat the sat",), ("",), (None,), ("<b>the</b> cat<script>x</script> sat",)]
    assert [r[0] for r in values(spark, rows, "x string", text.has_phrase(F.col("x"), ["the", "cat", "sat"]))] == [True, False, False, False, True]
    assert values(spark, rows[:1], "x string", text.has_phrase(F.col("x"), []), text.any_word(F.col("x"), ["sat", "z"])) == [(True, True)]


def test_ids(spark):
    [(i, h, s, t, a, p)] = values(spark, [(100 * 86_400 + 7, "a")], "t long, x string", *(c for c in (lambda i: [i, ids.id_hex(i), ids.shard_number(i), ids.id_seconds(i), ids.id_aux(i), ids.parse_id(ids.id_hex(i))])(ids.document_id(F.col("t"), F.col("x")))))
    assert h == "000000640cc175b9" == ids.to_hex(i) and (s, t, a, p) == (100, 8_640_000, 0x0CC175B9, i)
    assert values(spark, [(None,), ("zz",), ("12zz",), ("f" * 16,)], "x string", ids.parse_id(F.col("x"))) == [(0,), (0,), (0x12,), (0,)]
    assert ids.from_hex("12zz") == 0x12 and ids.from_hex(None) == 0 and ids.split_index_name("a.b.c.d") == ("a", "b", "c.d")
    with pytest.raises(ValueError):
        ids.split_index_name("a.b")
    with pytest.raises(ValueError):
        ids.day_floor(-1)


def test_props(spark):
    j = '{"s": "x\\"y", "i": 5, "d": 1.5, "b": true, "big": 99999999999999999999, "a": ["p", 1, "q\\n", null, 2.5], "n": null}'
    x = F.col("x")
    got = values(spark, [(j,), ("junk",), (None,)], "x string", props.get_string(x, "s"), props.get_string(x, "i", "no"), props.get_int(x, "i"), props.get_int(x, "d", -1), props.get_int(x, "big", -2), props.get_int(x, "s", -3), props.get_bool(x, "b"), props.get_strings(x, "a"), props.get_numbers(x, "a"))
    assert got[0] == ('x"y', "no", 5, -1, -2, -3, True, ["p", "q\n"], [1])
    assert got[1] == got[2] == ("", "no", 0, -1, -2, -3, False, [], [])
