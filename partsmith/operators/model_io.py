"""The table ends of model-assisted steps: prompts out, responses in.

The call itself is left to the user: write the requests, run any service over
them, read the responses back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partsmith.functions import jsontext as J, text as T
from partsmith.operators import library as L
from partsmith.operators.mapping import best_targets, resolve_header

# Notes and reasons attached to requests and verdicts.
IN_LIBRARY = ("系统分类编码 ", " 存在于标准库中，但仍须依据物料内容独立判断其是否正确。")
NOT_IN_LIBRARY = ("系统分类编码 ", " 不在标准库中，请从候选中选出正确编码。")
FALLBACK = "AI 失败，"
DETECT_TEMPLATE = (
    "物料代码：{material_code}\n物料名称：{material_name}\n规格：{specification}\n牌号：{grade}\n技术标准：{technical_standard}\n"
    "计量单位：{unit}\n全描述：{full_description}\n分类编码：{category_code}\n分类路径：{category_full_path}\n候选：\n{candidates}\n{note}")
EXTRACT_TEMPLATE = "目标字段：{fields}\n描述：{description}"
DESCRIPTION_CUT = 200


def detect_requests(cleaned: DataFrame, recalled: DataFrame, taxonomy: DataFrame, idx: L.Indexes,
                    template: str = DETECT_TEMPLATE) -> DataFrame:
    """``(row_id, prompt)``: row fields, recalled candidates and whether the code is known."""
    cats = taxonomy.select(F.col("id").alias("category_id"), "category_name", "full_path", T.cut(F.col("description"), DESCRIPTION_CUT).alias("d"))
    line = F.concat_ws(" | ", "category_code", "category_name", "full_path", F.nullif("d", F.lit("")))
    listed = recalled.join(cats, "category_id").groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("c")).select(
        "row_id", F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("candidates"))
    known = L.by_code(cleaned, "category_code", idx, "_known").join(listed, "row_id", "left")
    code = F.coalesce("category_code", F.lit(""))
    note = F.when(F.col("_known").isNotNull(), F.concat(F.lit(IN_LIBRARY[0]), code, F.lit(IN_LIBRARY[1]))).otherwise(
        F.concat(F.lit(NOT_IN_LIBRARY[0]), code, F.lit(NOT_IN_LIBRARY[1])))
    slots = {n: F.col(n) for n in ("material_code", "material_name", "specification", "grade", "technical_standard", "unit",
                                   "full_description", "category_code", "category_full_path", "candidates")} | {"note": note}
    return known.select("row_id", T.fill_template(template, slots).alias("prompt"))


def extract_requests(parsed: DataFrame, cleaned: DataFrame, std_header: DataFrame, idx: L.Indexes, taxonomy: DataFrame,
                     template: str = EXTRACT_TEMPLATE) -> DataFrame:
    """``(row_id, prompt)`` with the target fields of the row's category header.

    The category is that of the cleaned row, else the declared category read as
    a code, else as a name.
    """
    given = parsed.select("row_id", "full_description", T.jtrim(F.col("declared_category")).alias("declared")).join(
        cleaned.select("row_id", F.col("category_code").alias("own")), "row_id", "left")
    coded = L.by_code(given, "declared", idx, "_by_code")
    codes = taxonomy.select(F.col("id").alias("_by_code"), F.col("category_code").alias("code_of"))
    names = taxonomy.groupBy(F.col("category_name").alias("declared")).agg(F.min("category_code").alias("name_of"))
    chosen = coded.join(codes, "_by_code", "left").join(names, "declared", "left").withColumn(
        "category_code", F.coalesce("own", "code_of", "name_of"))
    fields = std_header.groupBy("std_id").agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("f")).select(
        "std_id", F.array_join(F.transform("f", lambda x: x["target"]), "、").alias("fields"))
    ready = resolve_header(chosen.where(~T.is_blank(F.col("full_description"))), std_header).join(fields, "std_id")
    return ready.select("row_id", T.fill_template(template, {"fields": F.col("fields"), "description": F.col("full_description")}).alias("prompt"))


def parse_detect(responses: DataFrame, checked: DataFrame, idx: L.Indexes, taxonomy: DataFrame) -> DataFrame:
    """``(row_id, score, matched, best_code, best_name, reason)``; a bad response falls back to the rule check.

    ``checked(row_id, score, consistent, best_code, best_name, reason)``.
    """
    body = J.json_or_fixed(J.json_block(F.col("response")))
    fields = F.from_json(body, "struct<score:string,matched:string,bestMatchCode:string,reason:string>")
    read = responses.withColumn("_b", F.when(F.get_json_object(body, "$").isNotNull(), fields))
    rule = checked.select("row_id", *[F.col(c).alias("_" + c) for c in ("score", "consistent", "best_code", "best_name", "reason")])
    score = F.when(F.col("_b.score").isNull(), F.lit(0.0)).otherwise(F.col("_b.score").try_cast("double"))
    usable = F.col("_b").isNotNull() & score.isNotNull()
    verdict = read.join(rule, "row_id").select(
        "row_id", usable.alias("answered"),
        F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(F.col("_score")).alias("score"),
        F.when(usable, F.lower("_b.matched") == "true").otherwise(F.col("_consistent")).alias("matched"),
        F.when(usable, T.jtrim(F.col("_b.bestMatchCode"))).otherwise(F.col("_best_code")).alias("best_code"),
        F.when(usable, F.col("_b.reason")).otherwise(F.concat(F.lit(FALLBACK), F.col("_reason"))).alias("reason"),
        F.col("_best_name"))
    names = taxonomy.select(F.col("id").alias("_id"), F.col("category_name").alias("_named"))
    return L.by_code(verdict, "best_code", idx, "_id").join(names, "_id", "left").select(
        "row_id", "score", "matched", "best_code", F.when(F.col("answered"), F.col("_named")).otherwise(F.col("_best_name")).alias("best_name"), "reason")


def endorsed(reason: Column, code: Column, name: Column) -> Column:
    """The reason mentions the suggested code or name."""
    by_code = ~T.is_blank(code) & F.contains(reason, code)
    by_name = ~T.is_blank(name) & F.contains(reason, name)
    return F.coalesce(~T.is_blank(reason) & (F.coalesce(by_code, F.lit(False)) | F.coalesce(by_name, F.lit(False))), F.lit(False))


def reconcile(verdicts: DataFrame, cleaned: DataFrame, recalled: DataFrame, idx: L.Indexes, taxonomy: DataFrame) -> DataFrame:
    """``(row_id, score, consistent, suggested_code, reason)`` from model verdicts."""
    rows = L.by_code(verdicts.join(cleaned.select("row_id", "category_code"), "row_id"), "category_code", idx, "_sys")
    code, own = F.col("best_code"), F.col("category_code")
    drop = F.coalesce(F.col("matched"), F.lit(False)) & ~T.is_blank(code) & ~code.eqNullSafe(own) & ~endorsed(F.col("reason"), code, F.col("best_name"))
    kept = rows.withColumn("best_code", F.when(~drop & ~T.is_blank(code), code))
    looked = L.by_code(kept, "best_code", idx, "_best")
    top = recalled.where("rank = 1").select("row_id", F.col("category_code").alias("_top"))
    same = (
        F.when(F.col("_sys").isNull(), False).when(F.col("_best").isNull(), F.coalesce("matched", F.lit(False)))
        .otherwise(F.col("_sys") == F.col("_best")))
    joined = looked.join(top, "row_id", "left").withColumn("consistent", same)
    suggested = F.when(F.col("_sys").isNull() & F.col("best_code").isNull(), F.col("_top")).otherwise(F.col("best_code"))
    hide = F.col("consistent") | F.coalesce(F.col("_sys") == F.col("_best"), F.lit(False))
    return joined.select("row_id", "score", "consistent", F.when(~hide, suggested).alias("suggested_code"), "reason")


def recategorise(cleaned: DataFrame, verdicts: DataFrame, idx: L.Indexes, taxonomy: DataFrame, review: float = 60.0) -> DataFrame:
    """Replace the category where the model rejects it and the rules agree with its choice.

    ``(row_id, category_id, category_code, quality_score, reason)``.
    """
    v = verdicts.select("row_id", F.col("score").alias("v_score"), "matched", "best_code", "best_name", F.col("reason").alias("v_reason"))
    code = F.col("best_code")
    offered = (
        (F.col("v_score") < review) & ~F.coalesce("matched", F.lit(False)) & ~T.is_blank(code)
        & ~code.eqNullSafe(F.col("category_code")) & endorsed(F.col("v_reason"), code, F.col("best_name")))
    rows = cleaned.join(v, "row_id").withColumn("_asked", F.when(offered, code))
    target = L.by_code(rows, "_asked", idx, "_target")
    checked = L.rule_check(target.drop("best_code", "best_name"), taxonomy, idx, "_target")
    better = F.col("_target").isNotNull() & (F.col("score") > F.col("v_score"))
    reason = F.concat(
        F.lit("AI 辅助重分类："), F.coalesce("best_name", F.lit("")), F.lit("（原 "), F.coalesce("category_code", F.lit("")),
        F.lit("）；"), F.coalesce("v_reason", F.lit("null")))
    return checked.select(
        "row_id", F.when(better, F.col("_target")).otherwise(F.col("category_id")).alias("category_id"),
        F.when(better, F.col("best_code")).otherwise(F.col("category_code")).alias("category_code"),
        F.when(better, F.col("score")).otherwise(F.col("v_score")).alias("quality_score"),
        F.when(better, reason).otherwise(F.col("v_reason")).alias("reason"))


def parse_extract(responses: DataFrame, cleaned: DataFrame, std_header: DataFrame) -> DataFrame:
    """``(row_id, target, value)``: response keys matched to the fields of the row's header."""
    body = J.json_or_fixed(J.json_block(F.col("response")))
    items = responses.select("row_id", F.explode(J.flat_map(body)).alias("source", "value"))
    rows = resolve_header(cleaned.select("row_id", "category_code"), std_header).where("std_id is not null")
    keyed = items.join(rows.select("row_id", "std_id"), "row_id")
    return best_targets(keyed, std_header).where("target is not null").groupBy("row_id", "target").agg(
        F.min_by("value", "source").alias("value"))


def collect_extracted(extracted: DataFrame, responses: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(attrs(title_id, row_id, key, value), counters(title_id, success, error))``."""
    attrs = extracted.join(titles, "row_id").select("title_id", "row_id", F.col("target").alias("key"), "value")
    ok = extracted.select("row_id").distinct().withColumn("_ok", F.lit(True))
    counters = responses.select("row_id").join(titles, "row_id").join(ok, "row_id", "left").groupBy("title_id").agg(
        F.count_if(F.col("_ok").isNotNull()).alias("success"), F.count_if(F.col("_ok").isNull()).alias("error"))
    return attrs, counters
