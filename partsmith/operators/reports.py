"""Counts, statistics and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.functions import scores as S


def by_status(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def by_category(cleaned: DataFrame, taxonomy: DataFrame, top: int | None = None) -> DataFrame:
    """Rows per category, counted before the names are joined; ``top`` breaks ties by code."""
    counts = cleaned.where("category_id is not null").groupBy("category_id").agg(F.count("*").alias("n"))
    named = counts.join(
        taxonomy.select(F.col("id").alias("category_id"), "category_code", "category_name"), "category_id")
    return named.orderBy(F.col("n").desc(), "category_code").limit(top) if top else named


def by_category_per_title(cleaned: DataFrame, taxonomy: DataFrame, top: int = 10) -> DataFrame:
    counts = cleaned.where("category_id is not null").groupBy("title_id", "category_id").agg(F.count("*").alias("n"))
    named = counts.join(
        taxonomy.select(F.col("id").alias("category_id"), "category_code", "category_name"), "category_id")
    w = Window.partitionBy("title_id").orderBy(F.col("n").desc(), "category_code")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def total_rows(titles: DataFrame) -> DataFrame:
    return titles.agg(F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total"))


def average_score(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(S.round1(F.avg("quality_score")).alias("avg_score"))


# Names of the two pairs that a dashboard draws.
PAIR_NAMES = {"matched": "分类匹配", "unmatched": "分类不匹配", "filled": "填充成功", "failed": "填充失败"}


def _distribution(df: DataFrame, keys: tuple[str, ...], top: int | None = None) -> DataFrame:
    """``(all_files, title_id, place, *keys, n)``: rows per value of ``keys``, of each file and of all rows.

    The most frequent stand first, equal ones by the last key.  Only counts
    are ranked; of those a task keeps the first ``top`` of a file before they meet.
    """
    one, every = [F.col("title_id"), *map(F.col, keys)], [F.col(k) for k in keys]
    counts = df.groupingSets([one, every], *one).agg(F.grouping("title_id").cast("boolean").alias("all_files"), F.count("*").alias("n"))
    w = Window.partitionBy("all_files", "title_id").orderBy(F.col("n").desc(), *[F.col(k).asc_nulls_last() for k in reversed(keys)])
    ranked = counts.withColumn("place", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("place") <= top)


def dashboard(titles: DataFrame, raw: DataFrame, cleaned: DataFrame, results: DataFrame, failed: DataFrame,
              samples: DataFrame, taxonomy: DataFrame, top: int = 10) -> DataFrame:
    """One row per file (scope ``file``) and one, with a null ``title_id``, for everything (scope ``all``).

    Each table is reduced to one small row per file first; the grand total is
    then rolled up from those.  It holds the rows of no known file too, which
    have no row of their own.  Statuses are all there are, categories the
    ``top`` most frequent; rows without a category count as one.
    """
    f = titles.groupBy("title_id").agg(
        F.min("file_name").alias("file_name"), F.count("*").alias("files"), F.sum("total_rows").alias("total_rows"))
    c = cleaned.groupBy("title_id").agg(
        F.count("*").alias("cleaned"), F.count_if(F.col("match_source") == "UNMATCHED").alias("unmatched"),
        F.sum("is_duplicate").alias("duplicates"), F.sum("quality_score").alias("score_sum"),
        F.count("quality_score").alias("scored"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("needs_review", "approved", "export_ready")])
    owner = raw.select("row_id", "title_id")

    def per_title(df: DataFrame, key: str, name: str) -> DataFrame:
        if "title_id" in df.columns:
            return df.groupBy("title_id").agg(F.count("*").alias(name))
        return df.groupBy(F.col(key).alias("row_id")).agg(F.count("*").alias("n")).join(owner, "row_id", "left").groupBy(
            "title_id").agg(F.sum("n").alias(name))

    parts = [f, c, per_title(results, "row_id", "filled"), per_title(failed, "row_id", "failed"),
             per_title(samples, "entity_id", "low_confidence")]
    names = ("files", "total_rows", "cleaned", "unmatched", "duplicates", "filled", "failed", "low_confidence", "needs_review",
             "approved", "export_ready")
    numbers = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).rollup("title_id").agg(
        F.grouping("title_id").cast("boolean").alias("all_files"), F.min("file_name").alias("file_name"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        S.round1(F.sum("score_sum") / F.nullif(F.sum("scored"), F.lit(0))).alias("avg_score"),
    ).where("all_files or files > 0").withColumn("matched", F.greatest(F.lit(0), F.col("cleaned") - F.col("unmatched")))

    def listed(ranked: DataFrame, name: str, *fields: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct("place", *fields)))
        return ranked.groupBy("all_files", "title_id").agg(
            F.transform(entries, lambda e: F.struct(*[e[x].alias(x) for x in fields])).alias(name))

    names_of = taxonomy.groupBy(F.col("id").alias("category_id")).agg(F.min("category_name").alias("category_name"))
    common = _distribution(cleaned, ("category_id", "category_code"), top).join(names_of, "category_id", "left")
    joined = numbers
    for part in (listed(_distribution(cleaned, ("status",)), "status_distribution", "status", "n"),
                 listed(common, "category_distribution", "category_id", "category_code", "category_name", "n")):
        name = part.columns[-1]
        part = part.toDF("_all", "_title", name)
        joined = joined.join(
            part, (F.col("all_files") == F.col("_all")) & F.col("title_id").eqNullSafe(F.col("_title")), "left"
        ).drop("_all", "_title").withColumn(name, F.coalesce(name, F.array()))

    def pair(first: str, second: str) -> Column:
        return F.array(*[F.struct(F.lit(PAIR_NAMES[n]).alias("name"), F.col(n).alias("value")) for n in (first, second)])

    return joined.select(
        F.when(F.col("all_files"), "all").otherwise("file").alias("scope"), "title_id",
        F.when(~F.col("all_files"), F.col("file_name")).alias("file_name"), *names, "avg_score", "matched",
        "status_distribution", "category_distribution", pair("matched", "unmatched").alias("match_distribution"),
        pair("filled", "failed").alias("fill_distribution"))


def quality_report(cleaned: DataFrame, title_id: int | None = None) -> DataFrame:
    part = cleaned if title_id is None else cleaned.where(F.col("title_id") == title_id)
    return part.agg(F.count("*").alias("total"), F.avg("quality_score").alias("avg_score"))


def cleaning_stats(titles: DataFrame, cleaned: DataFrame) -> DataFrame:
    done = cleaned.groupBy("title_id").agg(F.count("*").alias("cleaned_rows"))
    return titles.select("title_id", "file_name", "total_rows", "status").join(done, "title_id", "left").fillna(0, ["cleaned_rows"])


def distinct_codes(cleaned: DataFrame) -> DataFrame:
    """Non-blank category codes of a file with the first row that carries each."""
    return cleaned.where("category_code is not null and category_code <> ''").groupBy("title_id", "category_code").agg(
        F.min("row_id").alias("first_id"))


def count_where(df: DataFrame, conditions: dict[str, Column], *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def category_stats(taxonomy: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Direct children and rows of every category."""
    children = taxonomy.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("child_count"))
    data = cleaned.where("category_id is not null").groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("data_count"))
    return taxonomy.select("id").join(children, "id", "left").join(data, "id", "left").fillna(0).withColumnRenamed("id", "category_id")


def category_tree_stats(closure: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Totals of a category with everything below it; ``closure(ancestor_id, id)`` includes the node."""
    own = cleaned.where("category_id is not null").groupBy(F.col("category_id").alias("id")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin(*S.EXPORTABLE)).alias("valid"),
        F.count_if(F.col("status") == "needs_review").alias("pending"), F.max("created_at").alias("last_update"))
    return closure.join(own, "id", "left").groupBy(F.col("ancestor_id").alias("category_id")).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.max("last_update").alias("last_update"))


def export_stats(batches: DataFrame, since: Column) -> DataFrame:
    """One pass over recent batches with grouping sets: overall and by status, format, type, user."""
    recent = batches.where(F.col("created_at") >= since)
    dims = ("status", "format", "batch_type", "created_by")
    sets = [[]] + [[F.col(d)] for d in dims]
    out = recent.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        *[F.grouping(d).alias("g_" + d) for d in dims],
        F.count("*").alias("n"), F.sum("total_records").alias("records"), F.sum("exported_records").alias("exported"),
        F.sum("file_size").alias("bytes"), F.floor(F.avg("file_size")).alias("mean_bytes"),
        (F.count_if(F.col("status") == "completed") * 100.0 / F.count("*")).alias("success_pct"))
    dimension, value = F.lit("all"), F.lit(None).cast("string")
    for d in dims:
        dimension = F.when(F.col("g_" + d) == 0, d).otherwise(dimension)
        value = F.when(F.col("g_" + d) == 0, F.col(d)).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n", "records", "exported", "bytes", "mean_bytes", "success_pct")


# Task states and the bounds of the load classes.
TASK_STATES = ("pending", "assigned", "in_progress", "completed", "cancelled")
TASK_TYPES = ("field_mapping", "category_match", "data_validation")
OVERLOADED, IDLE = 1.5, 0.5


def task_stats(tasks: DataFrame, now: Column, user: str) -> DataFrame:
    open_task = F.col("status").isin("pending", "assigned", "in_progress")
    mine = F.col("assignee") == user
    soon = (F.col("due_at") >= now) & (F.col("due_at") <= now + F.expr("INTERVAL 24 HOURS"))
    return tasks.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in TASK_STATES],
        *[F.count_if(F.col("task_type") == t).alias(t) for t in TASK_TYPES],
        F.count_if(mine & F.col("status").isin("assigned", "in_progress")).alias("my_pending"),
        F.count_if(mine & (F.col("status") == "completed")).alias("my_completed"),
        F.count_if(open_task & soon).alias("due_soon"), F.count_if(open_task & (F.col("due_at") < now)).alias("overdue"))


def task_user_stats(tasks: DataFrame) -> DataFrame:
    """Tasks per assignee and state, zero where there are none."""
    return tasks.where("assignee is not null").groupBy("assignee").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in TASK_STATES])


def workload(tasks: DataFrame) -> DataFrame:
    per = tasks.where("assignee is not null").groupBy("assignee").agg(F.count("*").alias("n"))
    mean = per.agg(F.avg("n")).scalar()
    load = (
        F.when(F.col("n") > OVERLOADED * F.col("mean_n"), "overloaded")
        .when((F.col("n") > 0) & (F.col("n") < IDLE * F.col("mean_n")), "idle").otherwise("normal")
    )
    return per.withColumn("mean_n", mean).withColumn("load_class", load)


def check_summary(checked: DataFrame) -> DataFrame:
    """Totals of a re-check per file; ``checked`` carries score, consistent and both bounds."""
    return checked.groupBy("title_id").agg(
        F.count("*").alias("total"), S.round1(F.sum("score") / F.count("*")).alias("avg_score"),
        F.count_if("consistent").alias("matched_count"), F.count_if(~F.col("consistent")).alias("mismatch_count"),
        F.max("review").alias("review"), F.max("export").alias("export"))
