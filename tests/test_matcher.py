import random

import pytest
from pyspark.sql import functions as F

from brute import cosine_sim, edit_sim, match as brute_match, sim as gram_sim
from partsmith.operators import library as L, matcher as M, similarity as S

TAX = "id long, category_code string, category_name string, parent_id long, level int, full_path string, unit string, description string, old_code_1 string, old_name_1 string"
SYN = "id long, category_id long, synonym_name string, synonym_norm string"
SIGNALS = "row_id long, category_name string, category_code string, extras array<string>, material_name string"


def taxonomy(spark, cats):
    rows = [(c["id"], c["code"], c["name"], c["parent"], c["level"], "/" + c["code"], c.get("unit"), c.get("desc"), c.get("old"), None) for c in cats]
    return spark.createDataFrame(rows, TAX)


def run(spark, cats, rows, synonyms=(), similarity=None):
    signals = spark.createDataFrame([(i, r["name"], r["code"], r["extras"], r["material"]) for i, r in enumerate(rows)], SIGNALS)
    syn = spark.createDataFrame(list(synonyms), SYN)
    got = {r["row_id"]: (r["category_id"], r["source"], round(r["confidence"], 12)) for r in M.match(signals, taxonomy(spark, cats), syn, similarity).collect()}
    assert len(got) == len(rows)
    return [got[i] for i in range(len(rows))]


def node(i, name, parent, level):
    return {"id": i, "code": str(i), "name": name, "parent": parent, "level": level}


# Six nodes: two roots, two groups, and leaves whose code does not tell their place.
SMALL = [node(10, "黑色金属", None, 1), node(11, "有色金属", None, 1), node(1001, "钢材", 10, 2), node(1101, "铜材", 11, 2),
         node(100101, "钢棒", 1001, 3), node(100500, "铁合金", 1001, 3), node(110101, "铜棒", 1101, 3)]


def row(name, code=None, extras=(), material=""):
    return {"name": name, "code": code, "extras": list(extras), "material": material}


def test_small_tree(spark):
    got = run(spark, SMALL, [row("铜棒", "10"), row("钢棒", "100101"), row("铁合金", "100101"), row("棒"), row("塑料")])
    assert [g[0] for g in got[:3]] == [110101, 100101, 100500]
    assert [g[1] for g in got[:3]] == ["NAME_EXACT"] * 3
    assert got[3] == (100101, "FUZZY_AMBIGUOUS", 0.5)
    assert got[4] == (None, "UNMATCHED", 0.0)


def test_synonym_wins_and_descends(spark):
    syn = [(5, 1001, "型材", None), (6, 110101, "紫铜", " 紫铜 "), (7, 999, "钢棒", None)]
    got = run(spark, SMALL, [row("型材"), row("紫铜"), row("钢棒")], syn)
    assert got == [(100101, "SYNONYM", 0.95), (110101, "SYNONYM", 0.95), (100101, "NAME_EXACT", 1.0)]


STRATEGIES = {"grams": (None, gram_sim), "edits": (S.EDITS, edit_sim), "cosine": (S.COSINE, cosine_sim)}


@pytest.mark.parametrize("name", ["grams", "edits", "cosine"])
def test_a_search_finds_all_similar_pairs(spark, name):
    strategy, sim = {**STRATEGIES, "grams": (S.GRAMS, gram_sim)}[name]
    rnd = random.Random(4)

    def words(n):
        return sorted({"".join(rnd.choice("abcd钢棒") for _ in range(rnd.randint(1, 12))) for _ in range(n)})

    left, right = words(150), words(150)
    right += [w[:3] + "x" + w[4:] for w in left[:40] if len(w) > 4]
    pairs = strategy.candidates(spark.createDataFrame([(w,) for w in left], "norm string"), "norm",
                                spark.createDataFrame([(w,) for w in set(right)], "cat_norm string"), "cat_norm", 0.55)
    scored = pairs.withColumn("s", strategy.score(F.col("norm"), F.col("cat_norm"))).collect()
    want = {(a, b): sim(a, b) for a in left for b in set(right) if sim(a, b) >= 0.55}
    got = {(r.norm, r.cat_norm): r.s for r in scored if r.s >= 0.55}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert len(scored) < 0.9 * len(left) * len(set(right))  # and not all pairs


@pytest.mark.parametrize("seed, kind", [(1, "grams"), (2, "grams"), (1, "edits"), (2, "cosine")])
def test_blocked_equals_nested_loops(spark, seed, kind):
    rnd = random.Random(seed)
    letters = "abc钢"

    def word(lo=1, hi=6):
        return "".join(rnd.choice(letters) for _ in range(rnd.randint(lo, hi)))

    cats = [node(10 + i, word(), None, 1) for i in range(3)]
    cats += [node(1000 + i, word(), 10 + i % 3, 2) for i in range(6)]
    cats += [node(100000 + 100 * (i % 6) + i, word(), 1000 + i % 6, 3) for i in range(40)]
    rows = []
    for _ in range(150):
        base = rnd.choice(cats)["name"]
        name = rnd.choice([word(), base, base + word(1, 2), f"[{base.upper()}]", None, " "])
        rows.append(row(name, rnd.choice([None, "", "10", "1000", rnd.choice(cats)["code"], "10-01", "zz"]),
                        [word() for _ in range(rnd.randint(0, 3))], rnd.choice(["", word(), base, "  " + base])))
    strategy, sim = STRATEGIES[kind]
    got = run(spark, cats, rows, (), strategy)
    want = [brute_match(r, cats, sim) for r in rows]
    assert got == [(a, b, round(c, 12)) for a, b, c in want]


def test_a_common_name_yields_only_what_can_tie(spark):
    """One name held by 2,000 categories, of which the row's code chooses one group; a prefix that 2,000 codes share."""
    cats = [node(10, "金属", None, 1)] + [node(1000 + g, f"组{g}", 10, 2) for g in range(200)]
    cats += [node(100000 + 100 * g + i, "螺栓" if i % 2 else f"零件{g}x{i}", 1000 + g, 3) for g in range(200) for i in range(20)]
    rows = [row("螺栓", "1007"), row("螺栓", "100703"), row(None, "1007", [], "螺栓"), row("无关名称", "10"), row("无关名称", "1150"), row("无关名称", "100704"), row("螺栓")]
    signals = spark.createDataFrame([(i, r["name"], r["code"], r["extras"], r["material"]) for i, r in enumerate(rows)], SIGNALS)
    parts = M.match_parts(signals, taxonomy(spark, cats), spark.createDataFrame([], SYN))
    opened = dict(parts.rows.join(parts.top, "sig_id").groupBy("row_id").count().collect())
    ranked = parts.rows.join(parts.ranked, "sig_id").select("row_id", "rank_score").collect()
    ties = {}
    for r in ranked:
        best, n = ties.get(r.row_id, (0, 0))
        ties[r.row_id] = (r.rank_score, 1) if r.rank_score > best else (best, n + (r.rank_score == best))
    assert opened == {i: n for i, (_, n) in ties.items()}
    assert opened[0] == opened[2] == 10 and opened[4] == 20 and opened[6] == 2000
    got = run(spark, cats, rows)
    assert got == [(a, b, round(c, 12)) for a, b, c in (brute_match(r, cats) for r in rows)]


def test_recall_and_rule_check(spark):
    cats = [{"id": 1, "code": "B07", "name": "不锈钢板", "parent": None, "level": 3, "unit": "千克", "desc": "各种不锈钢板"}]
    tax, syn = taxonomy(spark, cats), spark.createDataFrame([], SYN)
    idx = L.build_indexes(tax, syn)
    rows = spark.createDataFrame(
        [(1, "B07", None, "不锈钢板", "不锈钢 钢板", "", "304", None, "千克", 1), (2, "X", None, None, None, None, None, None, None, None)],
        "row_id long, category_code string, material_code string, category_name string, full_description string, material_name string, "
        "specification string, grade string, unit string, category_id long")
    hits = L.recall(rows, tax, idx).collect()
    assert [(h["row_id"], h["category_code"], h["relevance"]) for h in hits] == [(1, "B07", 1.0)]
    checked = {r["row_id"]: r for r in L.rule_check(rows, tax, idx).collect()}
    assert (checked[1]["score"], checked[1]["consistent"]) == (90.0, True)
    assert (checked[2]["score"], checked[2]["consistent"]) == (20.0, False)
    empty = L.rule_check(rows, tax.where("false"), L.build_indexes(tax.where("false"), syn)).select("score").distinct().collect()
    assert [r[0] for r in empty] == [50.0]


def test_recall_posting_cut_is_exact(spark):
    cats = [{"id": i, "code": f"{(i * 37) % 101:03d}", "name": f"steel-part.{i}", "parent": None, "level": 3} for i in range(1, 60)]
    tax, syn = taxonomy(spark, cats), spark.createDataFrame([], SYN)
    rows = spark.createDataFrame([(i, f"steel-part.{i}", f"steelpart {i + 1}") for i in range(1, 30)], "row_id long, category_name string, material_name string")
    idx = L.build_indexes(tax, syn)
    small = {tuple(r) for r in L.recall(rows, tax, idx, k=4).collect()}
    full = {tuple(r) for r in L.recall(rows, tax, idx, k=1000).where("rank <= 4").collect()}
    assert small == full


def test_hot_signature_is_matched_once(spark):
    rows = [row("钢棒", "100101", ["x", "y"], "钢棒")] * 300 + [row("铜棒")]
    signals = spark.createDataFrame([(i, r["name"], r["code"], r["extras"], r["material"]) for i, r in enumerate(rows)], SIGNALS)
    parts = M.match_parts(signals, taxonomy(spark, SMALL), spark.createDataFrame([], SYN))
    assert parts.sigs.count() == 2
    assert parts.outcome.where(F.col("category_id") == 100101).count() == 300
