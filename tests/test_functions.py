import random

from pyspark.sql import functions as F

from partsmith.config import ParseRule
from partsmith.functions import jsontext as J, parse as P, scores as S, text as T


def one(spark, value, fn, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("v")).alias("r")).first()["r"]


def items(spark, text, rule=ParseRule()):
    return [(p["key"], p["value"]) for p in one(spark, text, lambda c: P.parse_desc(c, rule))]


def test_parse_default_rule(spark):
    assert items(spark, "物资名称 冷轧 钢带;规格 1.0;规格 2.0;;无") == [("物资名称", "冷轧 钢带"), ("规格", "2.0"), ("", "无")]
    assert items(spark, None) == [] and items(spark, "") == [] and items(spark, " ; ;") == []


def test_parse_escape(spark):
    rule = ParseRule(item_sep=";", kv_sep=":", escape="\\")
    assert items(spark, "a:b\\;c:d", rule) == [("a", "b\\"), ("c", "d")]
    assert items(spark, "a\\:x:y", rule) == [("a", "x:y")]
    strict = ParseRule(item_sep=";", kv_sep=":", escape="\\", strict_escape=True)
    assert items(spark, "a:b\\;c;d:e", strict) == [("a", "b;c"), ("d", "e")]


def test_parse_keeps_inner_empty_items(spark):
    rule = ParseRule(ignore_empty=False)
    assert items(spark, "a 1;;b 2;;", rule) == [("a", "1"), ("", ""), ("b", "2")]


def test_jaccard(spark):
    df = spark.createDataFrame([("不锈钢板", "不锈钢"), ("a", "a"), ("a", "b"), ("ab", "a"), (None, "a"), (" ", "a")], "a string, b string")
    got = [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [2 / 3, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_trim_and_normalise(spark):
    assert one(spark, "\t\x01 a b \n", T.jtrim) == "a b"
    assert one(spark, "【A-b】(c)_/ {D}", T.norm_name) == "abcd"
    assert one(spark, " 10-01/01_ ", T.norm_code) == "100101"
    assert one(spark, " - ", T.norm_name) is None


def test_json(spark):
    assert one(spark, '{"reason":"45\\C"}', J.fix_escapes) == '{"reason":"45\\\\C"}'
    assert one(spark, 'a\\\\b\\n\\', J.fix_escapes) == 'a\\\\b\\n\\\\'
    assert one(spark, 'x ```json\n{"a":1}\n```', J.json_block) == '{"a":1}'
    assert one(spark, '```\n{"a":{"b":1}} ok\n```', J.json_block) == '{"a":{"b":1}}'
    assert one(spark, "nothing", J.json_block) is None
    assert one(spark, '{"a":{"b":1},"c":null}', J.flat_map) == {"a": '{"b":1}', "c": ""}


def test_hash_and_scores(spark):
    import hashlib

    none = [F.lit(None).cast("string")] * 5
    assert one(spark, "x", lambda c: S.row_hash(*none)) == hashlib.md5(b"||||").hexdigest()
    filled = [F.lit("a"), F.lit(" "), F.lit(None), F.lit("b"), F.lit(""), F.lit("c")]
    assert one(spark, "x", lambda c: S.completeness(*filled)) == 50.0
    for score, want in ((59.9, "needs_review"), (60.0, "approved"), (79.9, "approved"), (80.0, "export_ready")):
        assert one(spark, score, lambda c: S.status_of(c, F.lit(60.0), F.lit(80.0)), "v double") == want


def test_thresholds(spark):
    from dataclasses import replace

    from partsmith.config import DEFAULTS
    from partsmith.operators.scoring import thresholds

    cfg = replace(DEFAULTS, adaptive=True)
    ten = spark.createDataFrame([(1, float(s)) for s in (20, 20, 50, 60, 75, 85, 90, 90, 100, 100)], "title_id long, score double")
    assert tuple(thresholds(ten, "title_id", cfg).first())[1:] == (57.0, 90.0)
    assert tuple(thresholds(ten.where("score > 20 or score < 0").limit(8), "title_id", cfg).first())[1:] == (60.0, 80.0)


def test_repeated_keys_keep_first_place_and_last_value(spark):
    from partsmith.functions.parse import parse_desc

    rng = random.Random(1)
    rows = [(i, ";".join(f"{rng.choice('abcde')} {j}" if rng.random() < 0.8 else f"v{j}" for j in range(rng.choice([0, 1, 3, 9, 60])))) for i in range(300)]
    for r in spark.createDataFrame(rows, "i int, t string").select("t", parse_desc(F.col("t")).alias("items")).collect():
        want = {}
        for item in filter(None, r.t.split(";")):
            key, value = item.split(" ", 1) if " " in item else ("", item)
            want[key] = value
        assert [(p.pos, p.key, p.value) for p in r["items"]] == [(i, k, v) for i, (k, v) in enumerate(want.items())]
