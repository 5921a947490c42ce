"""Queries over taxonomy maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.oracle import blank, cte, words
from partsmith.functions import text as T
from partsmith.operators import library as L, reports as R, taxonomy as X

cte("down", "taxonomy", """
SELECT id AS root_id, id, 0 AS depth FROM taxonomy
UNION ALL SELECT p.id, c.id, 1 FROM taxonomy p JOIN taxonomy c ON c.parent_id = p.id
UNION ALL SELECT p.id, c.id, 2 FROM taxonomy p JOIN taxonomy m ON m.parent_id = p.id JOIN taxonomy c ON c.parent_id = m.id
""")


@query("set_tree_cte", """WITH RECURSIVE r AS (SELECT id AS root_id, id, 0 AS depth FROM taxonomy WHERE level = 1
 UNION ALL SELECT r.root_id, c.id, r.depth + 1 FROM r JOIN taxonomy c ON c.parent_id = r.id) SELECT root_id, id, depth FROM r""")
def _(t):
    roots = t["taxonomy"].where("level = 1").select(F.col("id").alias("root_id"))
    return X.closure(t["taxonomy"]).join(roots, "root_id", "left_semi")


@query("tx_tree", "SELECT d.root_id, d.id, d.depth, t.sort_order, t.category_code FROM down d JOIN taxonomy t ON t.id = d.id WHERE d.root_id IN (SELECT id FROM taxonomy WHERE level = 2)")
def _(t):
    return X.tree(t["taxonomy"], t["taxonomy"].where("level = 2").select(F.col("id").alias("root_id")))


@query("set_search_union", "SELECT id, category_code FROM taxonomy WHERE starts_with(category_code, '12') OR contains(category_name, 'bolt')")
def _(t):
    return t["taxonomy"].where(
        F.startswith("category_code", F.lit("12")) | F.contains("category_name", F.lit("bolt"))).orderBy("category_code").select("id", "category_code")


@query("lib_by_level", "SELECT id, category_code FROM taxonomy WHERE level = 2")
def _(t):
    return t["taxonomy"].where("level = 2").orderBy("category_code").select("id", "category_code")


@query("lib_children", "SELECT parent_id, id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, category_code) AS INTEGER) AS pos FROM taxonomy WHERE parent_id IS NOT NULL")
def _(t):
    return X.order_siblings(t["taxonomy"].where("parent_id is not null")).select(
        "parent_id", "id", (F.col("sort_order") + 1).alias("pos"))


@query("lib_ancestors", """SELECT d.id, d.root_id AS ancestor_id, m.top - d.depth AS depth FROM down d JOIN (SELECT id, max(depth) AS top FROM down GROUP BY id) m ON m.id = d.id""")
def _(t):
    return X.ancestors(t["taxonomy"])


@query("lib_subtree", """WITH k AS (SELECT t.id, CASE t.level WHEN 3 THEN [g.sort_order, p.sort_order, t.sort_order] WHEN 2 THEN [p.sort_order, t.sort_order] ELSE [t.sort_order] END AS key
  FROM taxonomy t LEFT JOIN taxonomy p ON t.parent_id = p.id LEFT JOIN taxonomy g ON p.parent_id = g.id)
 SELECT d.root_id, d.id AS node_id, CAST(row_number() OVER (PARTITION BY d.root_id ORDER BY k.key) AS INTEGER) AS pos FROM down d JOIN k ON k.id = d.id WHERE d.root_id IN (SELECT id FROM taxonomy WHERE level < 3)""")
def _(t):
    return X.subtree(t["taxonomy"], t["taxonomy"].where("level < 3").select(F.col("id").alias("root_id")))


@query("win_sibling_order", "SELECT id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, category_code) - 1 AS INTEGER) AS sort_order FROM taxonomy")
def _(t):
    return X.order_siblings(t["taxonomy"]).select("id", "sort_order")


@query("tx_rebuild_paths", "SELECT id, level, full_path FROM taxonomy")
def _(t):
    return X.rebuild_paths(t["taxonomy"].drop("level", "full_path").withColumns({"level": F.lit(0), "full_path": F.lit("")})).select(
        "id", "level", "full_path")


def moves(t):
    """First leaf of every group to the group's sibling of lowest code; a root below its own child; a missing parent."""
    tax = t["taxonomy"]
    low = tax.where("level = 2").groupBy("parent_id").agg(F.min("id").alias("new_parent_id"))
    mid = tax.where("level = 2").select(F.col("id").alias("mid"), F.col("parent_id").alias("top"))
    leaf = tax.where("level = 3 and sort_order = 1").join(mid, F.col("parent_id") == F.col("mid")).join(
        low.withColumnRenamed("parent_id", "top"), "top").select("id", "new_parent_id")
    root = low.select(F.col("parent_id").alias("id"), "new_parent_id")
    lost = tax.where("level = 2 and sort_order = 2").select("id", F.lit(999999).cast("long").alias("new_parent_id"))
    return leaf.unionByName(root).unionByName(lost)


_moved = """WITH low AS (SELECT parent_id AS top, min(id) AS target FROM taxonomy WHERE level = 2 GROUP BY parent_id),
 m AS (SELECT t.id, low.target FROM taxonomy t JOIN taxonomy p ON t.parent_id = p.id JOIN low ON low.top = p.parent_id WHERE t.level = 3 AND t.sort_order = 1),
 n AS (SELECT t.* REPLACE (coalesce(m.target, t.parent_id) AS parent_id) FROM taxonomy t LEFT JOIN m ON m.id = t.id)"""


@query("tx_move", _moved + """ SELECT n.id, n.parent_id, n.level, CASE n.level WHEN 3 THEN p.full_path||'/'||n.category_code ELSE n.full_path END AS full_path,
 CAST(row_number() OVER (PARTITION BY n.parent_id ORDER BY n.sort_order, n.category_code) - 1 AS INTEGER) AS sort_order FROM n LEFT JOIN taxonomy p ON p.id = n.parent_id""")
def _(t):
    return X.move(t["taxonomy"], moves(t))[0].select("id", "parent_id", "level", "full_path", "sort_order")


@query("tx_move_rejected", """SELECT parent_id AS id, min(id) AS new_parent_id, 'cycle' AS reason FROM taxonomy WHERE level = 2 GROUP BY parent_id
 UNION ALL SELECT id, 999999, 'missing parent' FROM taxonomy WHERE level = 2 AND sort_order = 2""")
def _(t):
    return X.move(t["taxonomy"], moves(t))[1]


def edits(t):
    """A new leaf per group, a taken code, and new codes and names for groups."""
    tax = t["taxonomy"]
    cols = ["id", "parent_id", "category_code", "category_name"]
    new = tax.where("level = 2").select(
        (F.col("id") * 1000 + 1).alias("id"), F.col("id").alias("parent_id"),
        F.concat("category_code", F.lit("99")).alias("category_code"), F.concat(F.lit("new "), "category_name").alias("category_name"))
    taken = tax.where("level = 1").select(
        (F.col("id") * 100000 + 7).alias("id"), F.col("id").alias("parent_id"), "category_code", F.lit("copy").alias("category_name"))
    recode = tax.where("level = 2 and sort_order = 3").select(
        "id", "parent_id", F.concat(F.lit("R"), "category_code").alias("category_code"), F.upper("category_name").alias("category_name"))
    return new.select(cols).unionByName(taken.select(cols)).unionByName(recode.select(cols))


@query("tx_upsert", """WITH c AS (SELECT id, parent_id, level, CASE WHEN level = 2 AND sort_order = 3 THEN 'R'||category_code ELSE category_code END AS category_code,
   CASE WHEN level = 2 AND sort_order = 3 THEN upper(category_name) ELSE category_name END AS category_name, sort_order FROM taxonomy),
 n AS (SELECT t.id * 1000 + 1 AS id, t.id AS parent_id, 3 AS level, t.category_code||'99' AS category_code, 'new '||t.category_name AS category_name,
   CAST(coalesce((SELECT max(sort_order) FROM taxonomy k WHERE k.parent_id = t.id), -1) + 1 AS INTEGER) AS sort_order FROM taxonomy t WHERE level = 2),
 u AS (SELECT * FROM c UNION ALL SELECT * FROM n)
 SELECT u.id, u.parent_id, u.level, u.category_code, u.category_name, u.sort_order,
  '/'||CASE u.level WHEN 1 THEN u.category_code WHEN 2 THEN p.category_code||'/'||u.category_code ELSE g.category_code||'/'||p.category_code||'/'||u.category_code END AS full_path
 FROM u LEFT JOIN c p ON p.id = u.parent_id LEFT JOIN c g ON g.id = p.parent_id""")
def _(t):
    return X.upsert(t["taxonomy"], edits(t))[0].select(
        "id", "parent_id", "level", "category_code", "category_name", "sort_order", "full_path")


@query("tx_upsert_rejected", "SELECT id * 100000 + 7 AS id, category_code, 'code in use' AS reason FROM taxonomy WHERE level = 1")
def _(t):
    return X.upsert(t["taxonomy"], edits(t))[1]


@query("tx_code_gen", """SELECT NULL::BIGINT AS parent_id, lpad(CAST(max(CAST(category_code AS INTEGER)) + 1 AS VARCHAR), 2, '0') AS next_code FROM taxonomy WHERE parent_id IS NULL
 UNION ALL SELECT p.id, p.category_code||lpad(CAST(coalesce(max(CAST(right(c.category_code, 2) AS INTEGER)), 0) + 1 AS VARCHAR), 2, '0') FROM taxonomy p LEFT JOIN taxonomy c ON c.parent_id = p.id GROUP BY p.id, p.category_code""")
def _(t):
    return X.next_codes(t["taxonomy"])


@query("tx_deactivate", "SELECT id, id NOT IN (SELECT id FROM down WHERE root_id IN (SELECT min(id) FROM taxonomy WHERE level = 2 GROUP BY parent_id)) AS is_active FROM taxonomy")
def _(t):
    first = t["taxonomy"].where("level = 2").groupBy("parent_id").agg(F.min("id").alias("id")).select("id")
    return X.deactivate(t["taxonomy"], first).select("id", "is_active")


@query("tx_delete_check", """WITH s AS (SELECT t.id, (SELECT count(*) FROM taxonomy k WHERE k.parent_id = t.id) AS kids, (SELECT count(*) FROM cleaned c WHERE c.category_id = t.id) AS n FROM taxonomy t)
 SELECT id, kids = 0 AND n = 0 AS can_delete, CASE WHEN kids > 0 THEN '分类下有 '||kids||' 个子分类，无法删除' WHEN n > 0 THEN '分类下有 '||n||' 条数据，无法删除' ELSE '可以安全删除' END AS message FROM s""")
def _(t):
    return X.delete_check(R.category_stats(t["taxonomy"], cleaned(t)))


@query("tx_sort", """WITH o AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, category_code) AS rn, count(*) OVER (PARTITION BY parent_id) AS n FROM taxonomy WHERE level = 3)
 SELECT id, CAST(CASE WHEN rn = n THEN least(1, n - 1) WHEN rn = 1 OR n <= 2 THEN rn - 1 ELSE rn END AS INTEGER) AS sort_order FROM o WHERE n > 1""")
def _(t):
    tax = t["taxonomy"].where("level = 3")
    last = tax.groupBy("parent_id").agg(F.max_by("id", "sort_order").alias("id"), F.count("*").alias("n")).where("n > 1")
    many = tax.join(last.select("parent_id"), "parent_id", "left_semi")
    return X.place_at(many, last.select("id", F.lit(1).alias("position"))).select("id", "sort_order")


@query("tx_validate_code", f"""WITH c AS (SELECT DISTINCT col1 AS code FROM raw_rows) SELECT code, NOT {blank('code')} AND code NOT IN (SELECT category_code FROM taxonomy) AS ok FROM c""")
def _(t):
    return X.validate_codes(t["raw_rows"].select(F.col("col1").alias("code")).distinct(), t["taxonomy"])


def pairs(t):
    """Fold the group of highest code into the one of lowest code, per root."""
    return t["taxonomy"].where("level = 2").groupBy("parent_id").agg(
        F.max("id").alias("source_id"), F.min("id").alias("target_id")).where("source_id <> target_id")


@query("tx_merge", """WITH p AS (SELECT max(id) AS s, min(id) AS g FROM taxonomy WHERE level = 2 GROUP BY parent_id HAVING max(id) <> min(id)),
 n AS (SELECT t.id, coalesce(p.g, t.parent_id) AS parent_id, t.category_code, t.level, t.full_path FROM taxonomy t LEFT JOIN p ON p.s = t.parent_id WHERE t.id NOT IN (SELECT s FROM p))
 SELECT n.id, n.parent_id, CASE n.level WHEN 3 THEN k.full_path||'/'||n.category_code ELSE n.full_path END AS full_path, (SELECT count(*) FROM cleaned c WHERE c.category_id = n.id) AS n_rows
 FROM n LEFT JOIN taxonomy k ON k.id = n.parent_id""")
def _(t):
    tree, rows = X.merge(t["taxonomy"], cleaned(t), pairs(t))
    counts = rows.where("category_full_path is not null").groupBy("category_full_path").agg(F.count("*").alias("n_rows"))
    return tree.join(counts, F.col("full_path") == F.col("category_full_path"), "left").select(
        "id", "parent_id", "full_path", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("tx_propagate", _moved + """ SELECT c.row_id, c.category_code, c.category_level, CASE WHEN n.id IS NULL THEN c.category_full_path ELSE p.full_path||'/'||n.category_code END AS category_full_path
 FROM cleaned c LEFT JOIN n ON n.id = c.category_id LEFT JOIN taxonomy p ON p.id = n.parent_id""")
def _(t):
    return X.propagate(cleaned(t), X.move(t["taxonomy"], moves(t))[0]).select(
        "row_id", "category_code", "category_level", "category_full_path")


cte("row_attr", "filled std_header", """
SELECT f.row_id, f.category_code, h.target, CASE h.target WHEN '物资名称' THEN nullif(f.material_name, '') WHEN '规格' THEN f.specification WHEN '牌号' THEN f.grade
 WHEN '技术标准号' THEN f.technical_standard WHEN '计量单位' THEN f.unit ELSE f.material_code END AS value FROM filled f JOIN (SELECT DISTINCT category_code, target FROM std_header) h USING (category_code)
""")


def row_attrs(t):
    """Long attribute values of rows that have a standard header."""
    values = F.create_map(*[x for name, col in (
        ("物资名称", F.nullif("material_name", F.lit(""))), ("规格", F.col("specification")), ("牌号", F.col("grade")),
        ("技术标准号", F.col("technical_standard")), ("计量单位", F.col("unit")), ("物料代码", F.col("material_code")))
        for x in (F.lit(name), col)])
    rows = cleaned(t).select("row_id", "category_code", F.explode(values).alias("target", "value"))
    return rows.join(t["std_header"].select("category_code", "target").distinct(), ["category_code", "target"], "left_semi")


@query("tx_field_validation", f"""SELECT a.row_id, a.target, a.value, 'rule' AS kind FROM row_attr a JOIN field_rules r USING (category_code, target)
 WHERE CASE WHEN a.value IS NULL THEN r.is_required ELSE length(a.value) < r.min_length OR length(a.value) > r.max_length OR (r.pattern <> '' AND NOT regexp_full_match(a.value, r.pattern)) END
 UNION ALL SELECT a.row_id, a.target, a.value, 'required' FROM row_attr a JOIN std_header h USING (category_code, target) WHERE h.is_must AND {blank('a.value')}""")
def _(t):
    must = t["std_header"].where("is_must").select("category_code", "target")
    return X.field_violations(row_attrs(t), t["field_rules"], must)


@query("fn_field_valid", """SELECT a.row_id, a.target, CASE WHEN a.value IS NULL THEN NOT r.is_required ELSE NOT (length(a.value) < r.min_length OR length(a.value) > r.max_length OR (r.pattern <> '' AND NOT regexp_full_match(a.value, r.pattern))) END AS ok
 FROM row_attr a JOIN field_rules r USING (category_code, target)""")
def _(t):
    from partsmith.functions.scores import field_valid

    return row_attrs(t).join(t["field_rules"], ["category_code", "target"]).select(
        "row_id", "target", field_valid(F.col("value"), F.col("is_required"), F.col("min_length"), F.col("max_length"), F.col("pattern")).alias("ok"))
