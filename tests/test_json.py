import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir import configure, logs_of_text
from logweir.functions import json as js
from logweir.functions import json_walk as walk
from logweir.operators.details import blocks_of_entries, detail_text, fields_of_entries
from tests.logs import header, rows


def values(spark, column, *texts):
    configure(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v")).alias("x")).collect()]


def test_only_one_whole_value_is_json(spark):
    texts = [
        '{"a":1}', " [1,2] ", "1", '"x"', "null", '{"a":1} x', '{"a":1}{"b":2}', '{"a":1}]', '{"a":1}}',
        '{"a":1},{"b":2}', '1], [2', '1}, {"a":2', "", "  ", "{a:1}", "NaN", '{"a":1,"a":2}',
    ]
    got = values(spark, lambda v: js.strict_json(v).isNotNull(), *texts)
    assert got == [True] * 5 + [False] * 11 + [True]
    plain = [walk.load(t)[0] for t in texts]
    assert plain == got


def test_extract_json(spark):
    texts = [
        'Checkout refused - {"basket":17,"why":"empty"}', "picked: [4,8]", "the queue is idle",
        "mail {to: nobody}", 'query[7] then {"a":1}', '- : {"b":2,"a":1}', 'x {"a":1}\ntail [',
    ]
    assert values(spark, lambda v: js.extract_json(v)[0], *texts) == [
        "Checkout refused", "picked", None, None, None, "", "x",
    ]
    assert values(spark, lambda v: js.extract_json(v)[1], *texts) == [
        '{"basket":17,"why":"empty"}', "[4,8]", None, None, None, '{"a":1,"b":2}', '{"a":1}',
    ]


def test_normalize_json(spark):
    got = values(spark, js.normalize_json, '{ "b": 1, "a": [1, 2] }', "plain text", None, '{"a":1,"a":2}')
    assert got == ['{"a":[1,2],"b":1}', "plain text", None, '{"a":2}']


# Blocks that are JSON, blocks that only balance, and text without brackets.
GOOD = ['{"k":"}"}', "[1,[2]]", '{"x":"\\"}{"}', "{}", "[]", '{"a":{"b":[1]}}', '["a\\\\"]', '{"é":"😀"}']
BALANCED = ["{bad}", "[1,]", "[x [y] z]", '{"a" "]}"}']
FILLER = ["", " ", "ü€😀 ", 'say "hi" ', "a: b, ] } ", "\\ "]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(FILLER), st.sampled_from(GOOD + BALANCED))), min_size=20))
def test_json_blocks(spark, made):
    """Texts put together from known blocks: each good one is found where it was put."""
    texts, wanted = [], []
    for pieces in made:
        text, found = "", []
        for filler, block in pieces:
            text += filler
            if block in GOOD:
                found.append((len(text), json.loads(block)))
            text += block
        texts.append(text + " and {open")
        wanted.append(found)
    got = values(spark, walk.json_blocks, *texts)
    assert [[(b["char_offset"], json.loads(b["json"])) for b in blocks] for blocks in got] == wanted


ODD = [
    r'{"exception":"x","a":"\ud800"}', r'{"exception":"x","a":"\ude00 \ud83d\ude00"}', '{"exception":1e400}',
    '{"exception":1,"a":' + "9" * 400 + "}", '{"exception":' + "[" * 127 + "]" * 127 + "}",
]
FINE = {
    r'{"a":"\ud83d\ude00","b":"\\\\ud800"}': r'{"a":"😀","b":"\\\\ud800"}',
    '{"b":1.0,"a":[1.50,2e2,-0.0,1e-7]}': None, '{"a":1e300,"b":12345678901234567890123}': None,
    '{"a":"1e999 [[["}': '{"a":"1e999 [[["}',
}


def test_texts_that_only_look_like_json_stay_text(spark):
    """One rule in all functions, and no row that stops a job."""
    assert values(spark, js.normalize_json, *ODD) == ODD
    assert values(spark, walk.hide_exception, *ODD) == ODD
    assert values(spark, walk.json_fields, *ODD) == [None] * len(ODD)
    assert values(spark, lambda v: F.size(walk.json_blocks(v)), *ODD[:4]) == [0] * 4
    assert values(spark, lambda v: js.extract_json(F.concat(F.lit("m "), v))[1], *ODD) == [None] * len(ODD)


def test_all_functions_print_alike(spark):
    texts = list(FINE)
    plain = values(spark, js.normalize_json, *texts)
    assert [p for p, t in zip(plain, texts) if FINE[t]] == [w for w in FINE.values() if w]
    blocks = values(spark, walk.json_blocks, *texts)
    assert [b[0]["json"] for b in blocks] == plain
    hidden = [t[:-1] + ',"exception":{}}' for t in texts]
    assert values(spark, walk.hide_exception, *hidden) == plain
    numbers = values(spark, lambda v: F.to_json(walk.json_fields(v)), texts[1])[0]
    shown = [f["value"] for f in json.loads(numbers)]
    assert plain[1] == '{"a":[' + ",".join(shown[:4]) + '],"b":' + shown[4] + "}"


DOC = '{"b":[1,{"exception":"in\\nner","z":null}],"a":{},"exception":{"t":1},"s":"one\\ntwo\\n"}'


def entries(spark):
    df = spark.createDataFrame([("f", header("ERROR", "boom: " + DOC) + "\n" + DOC)], "n string, t string")
    return logs_of_text(df, "n", "t").entries()


def test_json_fields(spark):
    shown = rows(fields_of_entries(entries(spark), F.col("extra_data")), "path", "key", "text_line", "text")
    hidden_free = [
        ("$.a", "a", 0, "{}"), ("$.b[0]", "b", 0, "1"), ("$.b[1].z", "z", 0, "null"),
        ("$.s", "s", 0, "one"), ("$.s", "s", 1, "two"),
    ]
    assert sorted(shown) == sorted(hidden_free)
    full = rows(fields_of_entries(entries(spark), F.col("extra_data"), True), "path", "text")
    assert sorted(set(full) - {(p, t) for p, _, _, t in hidden_free}) == [
        ("$.b[1].exception", "in"), ("$.b[1].exception", "ner"), ("$.exception.t", "1"),
    ]


def test_hide_exception_at_any_depth(spark):
    got = values(spark, walk.hide_exception, DOC, "text with exception", '"exception"', None)
    assert got == ['{"a":{},"b":[1,{"z":null}],"s":"one\\ntwo\\n"}', "text with exception", '"exception"', None]


def test_exception_value(spark):
    got = values(spark, lambda v: js.json_value(v, "$.exception.t", "bigint"), DOC, "x")
    assert got == [1, None]


def test_blocks_of_entries(spark):
    got = rows(blocks_of_entries(entries(spark)), "block_no", "char_offset")
    assert got == [(0, 6)]


def test_detail_block(spark):
    found = entries(spark).select(detail_text(2).alias("d"), detail_text(0, True).alias("full")).first()
    head = (
        "Zeitpunkt:  02.04.2026, 14:00:02 (angepasst, +2h)\nLevel:      ERROR\nRequest:    r1\n"
        "Component:  Vendor.Ext\nZeile:      1\n\nboom\n\nJSON:\n\n"
    )
    short = '{"a":{},"b":[1,{"z":null}],"s":"one\\ntwo\\n"}'
    assert found["d"] == head + short + "\n\nZusätzliche Daten:\n\n" + short
    assert found["full"].startswith("Zeitpunkt:  02.04.2026, 12:00:02\n")
    assert found["full"].count('"exception":"in\\nner"') == 2


def test_detail_of_a_plain_entry(spark):
    df = spark.createDataFrame([("f", header("INFO", "plain", ""))], "n string, t string")
    text = logs_of_text(df, "n", "t").entries().select(detail_text()).first()[0]
    assert text.endswith("Request:    -\nComponent:  Vendor.Ext\nZeile:      1\n\nplain")


def test_deep_documents_are_no_json(spark):
    fits, deep, deeper = ("[" * n + "]" * n for n in (127, 128, 100_000))
    assert [walk.load(t)[0] for t in (fits, deep, deeper)] == [True, False, False]
    got = values(spark, lambda v: js.strict_json(v).isNotNull(), fits, deep, deeper, '"' + "[" * 200 + '"')
    assert got == [True, False, False, True]
