import json
import random

from pyspark.sql import functions as F
from helpers import token

from maskloom import MaskConfig, mask_line
from maskloom.operators.json_lines import is_json_object

CFG = MaskConfig.default("")
MAIL = token("EMAIL", "test@example.com")


def masked(apply, lines, cfg=CFG):
    return apply(lines, lambda c: mask_line(c, cfg))


def test_strings_of_objects_are_masked(apply):
    cases = {
        '{"email": "test@example.com"}': f'{{"email":"{MAIL}"}}',
        '{"user": { "email": "test@example.com", "id": 123 }, "active": true}':
            f'{{"user":{{"email":"{MAIL}","id":123}},"active":true}}',
        '{"z@k.com" : "a@b.c"}': f'{{"z@k.com":"{token("EMAIL", "a@b.c")}"}}',
        ' {"l": ["test@example.com", 1.50, null, ["x  y"]]} ':
            f'{{"l":["{MAIL}",1.50,null,["x  y"]]}}',
        '{"b":1,"a":"10.0.0.1"}': f'{{"b":1,"a":"{token("IP4", "10.0.0.1")}"}}',
        '{"a": ": \\"", "b": "x:"}': '{"a":": \\u0022","b":"x:"}',
        "{}": "{}",
        '{ "q" : "" }': '{"q":""}',
    }
    assert masked(apply, list(cases)) == list(cases.values())


def test_other_lines_take_the_text_route(apply):
    cases = {
        '[{"email": "test@example.com"}, 1]': f'[{{"email": "{MAIL}"}}, 1]',
        "{ invalid json: test@example.com }": f"{{ invalid json: {MAIL} }}",
        '{"a": 1} {"b": "test@example.com"}': f'{{"a": 1}} {{"b": "{MAIL}"}}',
        '{"a": "test@example.com",}': f'{{"a": "{MAIL}",}}',
        "{'a': 'test@example.com'}": f"{{'a': '{MAIL}'}}",
    }
    assert masked(apply, list(cases)) == list(cases.values())


def test_validity(apply):
    lines = ['{"a":1}] {}', '{"a":1}} {"b":2}', '{"a":1},{"b":2}', '{"a":01}', '{"a":NaN}',
             '{"a":1}', ' {"a":[{}]} ', '{"a":1,"a":2}', None]
    assert apply(lines, is_json_object) == [False] * 5 + [True, True, True, False]


def test_keys_may_repeat(apply):
    assert masked(apply, ['{"a":"test@example.com","a":"x","A":"test@example.com"}']) == [f'{{"a":"{MAIL}","a":"x","A":"{MAIL}"}}']


def test_validity_against_another_parser(apply):
    """Lines put together at random, most of them broken, against Python's parser with its extras ruled out."""
    rng = random.Random(11)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"b\\n"', '"\\u00e9"', '"\\q"', '"x', '"\t"', "1", "-0.5e+3", "01", "1.", "true", "null",
             "nul", " ", " ", "NaN", "\ufdd0v", "\ufdd0", "v", "\u00a0", '""', "-", '{"k":', '"k":1', "[]", "{}"]

    def strict(_):
        raise ValueError

    def plain(line):
        try:
            if line.strip(" \t\r\n") != line.strip():
                return False
            return isinstance(json.loads(line, parse_constant=strict), dict)
        except ValueError:
            return False

    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    lines += ["{" + ",".join(f'"k":{rng.choice(parts)}' for _ in range(rng.randrange(4))) + "}" for _ in range(6000)]
    want = [plain(line) for line in lines]
    assert 500 < sum(want) < 9000
    assert [(line, got) for line, got, is_json in zip(lines, apply(lines, is_json_object), want) if got != is_json] == []


def test_depth(apply):
    def nested(n):
        return '{"a":' * n + '"{{{[[["' + "}" * n

    wide = '{"a":[' + ",".join(["{}"] * 200) + "]}"
    assert apply([nested(64), nested(65), wide], is_json_object) == [True, False, True]
    assert apply([nested(3), nested(4)], lambda c: is_json_object(c, 3)) == [True, False]
    line = nested(2).replace("{{{[[[", "test@example.com")
    assert masked(apply, [line], MaskConfig.default("", json_depth=1)) == [line.replace("test@example.com", MAIL)]
    many = '{"a":[' + ",".join(['{"b":[1,"x"]}'] * 50_000) + "]}"
    assert apply([many, many[:-1] + ",}"], is_json_object) == [True, False]


def test_escapes(apply):
    line = '{"k\\u00e9": "\\u0041 \\t é <b> \\/ 😀", "n": "\\ud83d\\ude00"}'
    assert masked(apply, [line]) == [
        '{"k\\u00E9":"A \\t \\u00E9 \\u003Cb\\u003E / \\uD83D\\uDE00","n":"\\uD83D\\uDE00"}']
    plain = MaskConfig.default("", json_ascii=False)
    assert masked(apply, [line], plain) == ['{"ké":"A \\t é <b> / 😀","n":"😀"}']


def test_escaped_values_are_found(apply):
    line = '{"a": "test\\u0040example.com", "p": "CORP\\\\jane"}'
    cfg = MaskConfig.all_types("")
    account = "CORP" + chr(92) + "jane"
    assert masked(apply, [line], cfg) == [f'{{"a":"{MAIL}","p":"{token("USR", account)}"}}']


def test_detection_can_be_off(apply):
    cfg = MaskConfig.default("", detect_json=False)
    assert masked(apply, ['{"e": "test@example.com"}'], cfg) == [f'{{"e": "{MAIL}"}}']


def test_odd_strings(apply):
    long = "x" * (1 << 20)
    lines = [f'{{"a": "{long} test@example.com"}}', '{"a": "\\ud800 test@example.com"}']
    out = masked(apply, lines)
    assert out[0] == f'{{"a":"{long} {MAIL}"}}'
    assert MAIL in out[1]


def test_overlong_strings_stay_whole(spark):
    """A line beyond the parser's limits is JSON all the same, and comes out as it would if it were short."""
    cfg = MaskConfig.default("")
    for middle in ("", "y" * 21_000_000):
        line = F.concat(F.lit('{"a": "1\\n '), F.repeat(F.lit("y"), F.lit(len(middle))), F.lit(' \\u0041 a@b.de", "mail@x.de" : [ "c", 1 ]}'))
        row = spark.range(1).select(line.alias("line")).select(
            is_json_object(F.col("line")).alias("json"), mask_line(F.col("line"), cfg).alias("masked")).first()
        expected = f'{{"a":"1\\n {middle} A {token("EMAIL", "a@b.de")}","mail@x.de":["c",1]}}'
        assert row["json"] and row["masked"] == expected
    broken = F.concat(F.lit('{"a": "'), F.repeat(F.lit("y"), F.lit(2_000_000)), F.lit('\\q"}'))
    assert not spark.range(1).select(is_json_object(broken).alias("json")).first()["json"]
