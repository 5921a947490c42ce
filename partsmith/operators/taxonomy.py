"""Taxonomy maintenance as set operations over the parent links.

Descendants and paths are found level by level until no new node turns up, so
trees may be of any depth; links that form a cycle end where they meet a node
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from partsmith.functions import scores as S, text as T
from partsmith.operators.edits import last_edits
from partsmith.session import stage


def closure(taxonomy: DataFrame) -> DataFrame:
    """``(root_id, id, depth)``: every node with itself and everything below it.

    Each level is written to the shared folder; the loop ends with the deepest.
    """
    links = stage(taxonomy.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("id")), "links")
    out = taxonomy.select(F.col("id").alias("root_id"), "id", F.lit(0).alias("depth"))
    level, depth = links.select(F.col("id").alias("root_id"), F.col("child").alias("id")), 1
    while True:
        level = level.join(out.select("root_id", "id"), ["root_id", "id"], "left_anti").withColumn("depth", F.lit(depth))
        level = stage(level, "closure")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        level = level.join(links, "id").select("root_id", F.col("child").alias("id"))
        depth += 1


def tree(taxonomy: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root_id, id, depth, sort_order, category_code)`` below given nodes (``roots.root_id``)."""
    return closure(taxonomy).join(roots, "root_id", "left_semi").join(
        taxonomy.select("id", "sort_order", "category_code"), "id")


def ancestors(taxonomy: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """``(id, ancestor_id, depth)`` from the root (depth 0) down to the node itself; ``below`` is the closure, if at hand."""
    up = (closure(taxonomy) if below is None else below).select("id", F.col("root_id").alias("ancestor_id"), F.col("depth").alias("up"))
    height = up.groupBy("id").agg(F.max("up").alias("height"))
    return up.join(height, "id").select("id", "ancestor_id", (F.col("height") - F.col("up")).alias("depth"))


def subtree(taxonomy: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root_id, node_id, pos)`` in preorder, siblings by sort order, then code."""
    step = F.struct(F.coalesce("sort_order", F.lit(0)).alias("s"), F.coalesce("category_code", F.lit("")).alias("c"))
    steps = taxonomy.select(F.col("id").alias("ancestor_id"), step.alias("step"))
    below = closure(taxonomy)
    trail = (
        ancestors(taxonomy, below).join(steps, "ancestor_id").groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "step"))).alias("trail")))
    w = Window.partitionBy("root_id").orderBy("trail")
    return (
        below.join(roots, "root_id", "left_semi").join(trail, "id")
        .select("root_id", F.col("id").alias("node_id"), F.row_number().over(w).alias("pos")))


def rebuild_paths(taxonomy: DataFrame) -> DataFrame:
    """Level and ``/a/b/c`` path of every node, from the parent links alone.

    The climb reads the links several times, so edited links are staged first.
    """
    taxonomy = stage(taxonomy, "links")
    codes = taxonomy.select(F.col("id").alias("ancestor_id"), "category_code")
    trail = (
        ancestors(taxonomy).join(codes, "ancestor_id").groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "category_code"))).alias("trail"))
        .select("id", F.size("trail").alias("level"),
                F.concat(F.lit("/"), F.array_join(F.transform("trail", lambda s: s["category_code"]), "/")).alias("full_path")))
    return taxonomy.drop("level", "full_path").join(trail, "id", "left")


def order_siblings(taxonomy: DataFrame) -> DataFrame:
    """Renumber siblings 0..n-1 by sort order, then code."""
    w = Window.partitionBy("parent_id").orderBy(F.coalesce("sort_order", F.lit(0)), "category_code", "id")
    return taxonomy.withColumn("sort_order", (F.row_number().over(w) - 1).cast("int"))


def move(taxonomy: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reparent ``edits(id, new_parent_id)``: ``(taxonomy, rejected(id, new_parent_id, reason))``.

    An edit is rejected when the node or the parent is missing, the parent is
    inactive, or the parent lies inside the moved subtree.  Edits that only
    together would close a cycle cut their nodes off from every root; those
    are rejected too.
    """
    edits = last_edits(edits, ["id"])
    active = F.col("is_active") if "is_active" in taxonomy.columns else F.lit(True)
    nodes = taxonomy.select(F.col("id").alias("node"), active.alias("active"))
    inside = closure(taxonomy).select(F.col("root_id").alias("id"), F.col("id").alias("new_parent_id"), F.lit(True).alias("inside"))
    own = nodes.select(F.col("node").alias("id"), F.lit(True).alias("known"))
    checked = (
        edits.join(own, "id", "left")
        .join(nodes.withColumnRenamed("node", "new_parent_id"), "new_parent_id", "left")
        .join(inside, ["id", "new_parent_id"], "left")
        .withColumn("reason", F.when(F.col("known").isNull(), "missing node")
                    .when(F.col("new_parent_id").isNotNull() & F.col("active").isNull(), "missing parent")
                    .when(F.col("new_parent_id").isNotNull() & ~F.col("active"), "inactive parent")
                    .when(F.col("inside"), "cycle")))
    checked = stage(checked, "edits")
    good = checked.where("reason is null").select("id", "new_parent_id")
    tried = stage(taxonomy.join(good.withColumn("_m", F.lit(True)), "id", "left").select(
        "id", F.when(F.col("_m"), F.col("new_parent_id")).otherwise(F.col("parent_id")).alias("parent_id")), "tried")
    rooted = closure(tried).join(
        tried.where("parent_id is null").select(F.col("id").alias("root_id")), "root_id", "left_semi").select("id")
    loose = good.join(rooted, "id", "left_anti").withColumn("reason", F.lit("cycle"))
    final = good.join(rooted, "id", "left_semi").withColumn("_ok", F.lit(True))
    moved = taxonomy.join(final, "id", "left").withColumn(
        "parent_id", F.when(F.col("_ok"), F.col("new_parent_id")).otherwise(F.col("parent_id"))).drop("_ok", "new_parent_id")
    rejected = checked.where("reason is not null").select("id", "new_parent_id", "reason").unionByName(loose)
    return order_siblings(rebuild_paths(moved)).select(*taxonomy.columns), rejected


def upsert(taxonomy: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert or change nodes: ``edits(id, parent_id, category_code, category_name)``.

    A known id is renamed or recoded, a new one is inserted below its parent
    with the next sort order.  A code that another node owns, or that two edits
    claim (the lower id keeps it), is rejected; code changes reach all paths.
    """
    edits = last_edits(edits, ["id"])
    known = taxonomy.select("id", F.col("category_code").alias("old_code"), F.lit(True).alias("exists"))
    owners = taxonomy.select("category_code", F.col("id").alias("owner_id"))
    parents = taxonomy.select(F.col("id").alias("parent_id"), F.lit(True).alias("has_parent"))
    claims = edits.groupBy("category_code").agg(F.min("id").alias("first_id"))
    checked = (
        edits.join(known, "id", "left").join(owners, "category_code", "left").join(parents, "parent_id", "left")
        .join(claims, "category_code", "left")
        .withColumn("reason", F.when(T.is_blank(F.col("category_code")), "blank code")
                    .when(F.col("owner_id").isNotNull() & (F.col("owner_id") != F.col("id")), "code in use")
                    .when(F.col("first_id") != F.col("id"), "code in use")
                    .when(F.col("exists").isNull() & F.col("parent_id").isNotNull() & F.col("has_parent").isNull(), "missing parent")))
    good = checked.where("reason is null")
    last = taxonomy.groupBy("parent_id").agg(F.max("sort_order").alias("last_order"))
    w = Window.partitionBy("parent_id").orderBy("id")
    fresh = (
        good.where("exists is null").select("id", "parent_id", "category_code", "category_name")
        .join(last.withColumnRenamed("parent_id", "p"), F.col("parent_id").eqNullSafe(F.col("p")), "left")
        .withColumn("sort_order", (F.coalesce("last_order", F.lit(-1)) + F.row_number().over(w)).cast("int"))
        .select("id", "parent_id", "category_code", "category_name", "sort_order"))
    changes = good.where("exists").select(
        "id", F.col("category_code").alias("_code"), F.col("category_name").alias("_name"))
    changed = taxonomy.join(changes, "id", "left").withColumns({
        "category_code": F.coalesce("_code", "category_code"), "category_name": F.coalesce("_name", "category_name"),
    }).drop("_code", "_name")
    merged = changed.unionByName(fresh, allowMissingColumns=True)
    rejected = checked.where("reason is not null").select("id", "category_code", "reason")
    return rebuild_paths(merged).select(*taxonomy.columns), rejected


def next_codes(taxonomy: DataFrame) -> DataFrame:
    """``(parent_id, next_code)`` for every node as parent and for the top (null parent)."""
    roots = taxonomy.where("parent_id is null").agg(
        F.coalesce(F.max(F.expr("try_cast(category_code AS long)")), F.lit(0)).alias("top"))
    top = roots.select(F.lit(None).cast("long").alias("parent_id"), F.format_string("%02d", F.col("top") + 1).alias("next_code"))
    suffix = F.expr("try_cast(right(category_code, 2) AS int)")
    used = taxonomy.where("parent_id is not null").groupBy("parent_id").agg(F.max(suffix).alias("top"))
    below = taxonomy.select(F.col("id").alias("parent_id"), "category_code").join(used, "parent_id", "left").select(
        "parent_id", F.concat("category_code", F.format_string("%02d", F.coalesce("top", F.lit(0)) + 1)).alias("next_code"))
    return top.unionByName(below)


def deactivate(taxonomy: DataFrame, ids: DataFrame) -> DataFrame:
    """Switch off given nodes and everything below them (``ids.id``)."""
    gone = closure(taxonomy).join(ids.select(F.col("id").alias("root_id")), "root_id", "left_semi").select("id").distinct()
    active = F.col("is_active") if "is_active" in taxonomy.columns else F.lit(True)
    return taxonomy.join(gone.withColumn("_off", F.lit(True)), "id", "left").withColumn(
        "is_active", active & F.col("_off").isNull()).drop("_off")


def delete_check(stats: DataFrame) -> DataFrame:
    """``(id, can_delete, message)`` from child and data counts."""
    kids, data = F.col("child_count"), F.col("data_count")
    message = (
        F.when(kids > 0, F.concat(F.lit("分类下有 "), kids.cast("string"), F.lit(" 个子分类，无法删除")))
        .when(data > 0, F.concat(F.lit("分类下有 "), data.cast("string"), F.lit(" 条数据，无法删除")))
        .otherwise("可以安全删除"))
    return stats.select(F.col("category_id").alias("id"), ((kids == 0) & (data == 0)).alias("can_delete"), message.alias("message"))


def place_at(taxonomy: DataFrame, edits: DataFrame) -> DataFrame:
    """Move each ``edits(id, position)`` to its place among siblings and renumber them.

    At most one node per set of siblings: positions refer to the old order.
    """
    edited = taxonomy.join(last_edits(edits, ["id"]), "id", "left")
    w = Window.partitionBy("parent_id").orderBy(
        F.col("position").isNotNull(), F.coalesce("sort_order", F.lit(0)), "category_code")
    # Others keep the slots 0, 1, 2, ...; the moved node goes in front of the slot it asks for.
    slot = F.when(F.col("position").isNotNull(), F.col("position") - 0.5).otherwise(F.row_number().over(w) - 1)
    again = Window.partitionBy("parent_id").orderBy("slot")
    return edited.withColumn("slot", slot).withColumn(
        "sort_order", (F.row_number().over(again) - 1).cast("int")).drop("slot", "position")


def validate_codes(codes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(code, ok)``: a code is free when it is not blank and nobody owns it."""
    used = taxonomy.select(F.col("category_code").alias("code"), F.lit(True).alias("used")).distinct()
    return codes.join(used, "code", "left").select(
        "code", (~T.is_blank(F.col("code")) & F.col("used").isNull()).alias("ok"))


def resolve_pairs(pairs: DataFrame) -> DataFrame:
    """``(source_id, target_id)`` with every chain followed to its end.

    The last edit of a source holds.  Each round doubles the steps that a pair
    reaches, so a chain of n pairs takes log2(n) rounds; a pair that has not
    come to an end by then runs in a circle or into one.
    """
    to = stage(last_edits(pairs.select(*[c for c in pairs.columns if c in ("source_id", "target_id", "seq")]), ["source_id"])
               .where("target_id is not null and source_id <> target_id"), "pairs")
    rounds = max(1, to.count()).bit_length()
    for _ in range(rounds):
        onward = to.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("_next"))
        if to.join(onward, "target_id", "left_semi").isEmpty():
            return to
        to = stage(to.join(onward, "target_id", "left").select("source_id", F.coalesce("_next", "target_id").alias("target_id")), "pairs")
    return to.join(to.select(F.col("source_id").alias("target_id")), "target_id", "left_anti")


def merge(taxonomy: DataFrame, cleaned: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold ``pairs(source_id, target_id)``: children and rows go to the target, the source is dropped.

    Chains of pairs lead to their last target; pairs that run in a circle are
    left out, and so are pairs whose last target does not exist.
    """
    to = resolve_pairs(pairs).join(taxonomy.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    kept = taxonomy.join(to.select(F.col("source_id").alias("id")), "id", "left_anti")
    relinked = kept.join(to, kept["parent_id"] == to["source_id"], "left").withColumn(
        "parent_id", F.coalesce("target_id", "parent_id")).drop("source_id", "target_id")
    tree_ = rebuild_paths(relinked).select(*taxonomy.columns)
    rows = cleaned.join(to, cleaned["category_id"] == to["source_id"], "left").withColumn(
        "category_id", F.coalesce("target_id", "category_id")).drop("source_id", "target_id")
    return tree_, propagate(rows, tree_)


def propagate(cleaned: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Write code, level, path and name of the current taxonomy into cleaned rows."""
    now = taxonomy.select(
        F.col("id").alias("category_id"), F.col("category_code").alias("_c"), F.col("level").alias("_l"),
        F.col("full_path").alias("_p"), F.col("category_name").alias("_n"))
    return cleaned.join(now, "category_id", "left").withColumns({
        "category_code": F.coalesce("_c", "category_code"), "category_level": F.coalesce("_l", "category_level"),
        "category_full_path": F.coalesce("_p", "category_full_path"), "category_name": F.coalesce("_n", "category_name"),
    }).drop("_c", "_l", "_p", "_n")


def field_violations(attrs: DataFrame, rules: DataFrame, required: DataFrame) -> DataFrame:
    """``(row_id, target, value, kind)``: values that break a rule, and required blanks.

    ``attrs(row_id, category_code, target, value)``; ``required(category_code, target)``.
    A rule may carry ``allowed``, a JSON array of the values it permits.
    """
    ruled = attrs.join(rules, ["category_code", "target"])
    ok = S.field_valid(F.col("value"), F.col("is_required"), F.col("min_length"), F.col("max_length"), F.col("pattern"),
                       F.col("allowed") if "allowed" in rules.columns else None)
    broken = ruled.where(~ok).select("row_id", "target", "value", F.lit("rule").alias("kind"))
    blank = attrs.join(required, ["category_code", "target"], "left_semi").where(T.is_blank(F.col("value"))).select(
        "row_id", "target", "value", F.lit("required").alias("kind"))
    return broken.unionByName(blank)
