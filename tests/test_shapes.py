import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions.shapes import args_shape, content_chars, exact_signature, parsed


def code(v):
    for kind, name in ((bool, "b"), (str, f"s{len(v)}" if isinstance(v, str) else ""), (int, "i"), (float, "f"), (type(None), "n"), (list, f"a{len(v)}" if isinstance(v, list) else ""), (dict, f"o{len(v)}" if isinstance(v, dict) else "")):
        if isinstance(v, kind):
            return name
    return "?"


def slow_shape(v):
    return ",".join(f"{k}:{code(x)}" for k, x in sorted(v.items())) if isinstance(v, dict) else code(v)


def slow_chars(v):
    if isinstance(v, str):
        return len(v)
    texts = [x if isinstance(x, str) else [x.get(k) for k in ("text", "thinking", "content")] if isinstance(x, dict) else [] for x in (v if isinstance(v, list) else [])]
    return sum(len(t) for x in texts for t in ([x] if isinstance(x, str) else x) if isinstance(t, str))


TEXTS = [
    '{"a":1.0}', '{"a":1}', '{"a":1,"a":2}', '{"a":"x","b":{"c":1,"c":2},"a":1.50}', '{"z":-0.0,"y":-0,"x":1e2,"w":1E-2}', '{"n":null,"t":true,"s":"é\\n日"}', "[]", "{}", '""', '"x"', "1.0", "1", "null", "true", "[1.0]", "[1]",
    '["abc",{"text":"de"}]', '[null,5,{"text":5}]', '[{"text":"a","thinking":"bc","content":"def"},["no"],{"content":["x"]}]', '[{"text":"a","text":"bcd"}]', '{"big":123456789012345678901234,"long":9223372036854775807,"less":-9223372036854775808}',
    '{"b":1,"a":2}', '{"a":2,"b":1}', '{"deep":[[1.0],{"a":1.0}]}', '{"deep":[[1],{"a":1}]}', '{"\\u0000":1,"é":2,"Z":3}',
]


@pytest.fixture(scope="module")
def told(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, "{broken", "", None, "NaN"]], "t string").select("t", parsed(F.col("t")).alias("v"))
    rows = rows.select("t", F.col("v").isNull().alias("none"), args_shape(F.col("v")).alias("shape"), content_chars(F.col("v")).alias("chars"), exact_signature(F.col("v")).alias("signature"))
    return {r.t: r for r in rows.collect()}


def test_shapes_and_sizes_match_python(told):
    for t in TEXTS:
        v = json.loads(t)
        assert (told[t].shape, told[t].chars) == (slow_shape(v), slow_chars(v)), t
    assert all(told[t].none and told[t].shape is None and told[t].chars == 0 for t in ("{broken", "", None, "NaN"))


def test_signatures_tell_values_apart(told):
    exact = lambda t: json.dumps(json.loads(t), sort_keys=True)
    for a in TEXTS:
        for b in TEXTS:
            assert (told[a].signature == told[b].signature) == (exact(a) == exact(b)), (a, b)


def test_lines_that_repeat_a_key_are_parsed(spark):
    from tracewright.sources.transcripts import parse_lines

    lines = ['{"type":"user","uuid":"u1","type":"system"}', '{"type":"user"', '{"type":"user","uuid":"u2"}']
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line long, value string")
    good, bad = parse_lines(rows)
    assert {(r.line, r.type, r.uuid) for r in good.collect()} == {(0, "system", "u1"), (2, "user", "u2")}
    assert [r.line for r in bad.collect()] == [1]
