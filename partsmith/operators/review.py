"""Review tasks: creation, state changes from events, queues, reminders, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.functions import scores as S, text as T
from partsmith.operators import search as Q
from partsmith.operators.edits import last_edits
from partsmith.operators.order import numbered
from partsmith.session import stage

# Task states and the bounds of the derived priority.
STATES = ("pending", "assigned", "in_progress", "completed", "cancelled")
OPEN = ("pending", "assigned", "in_progress")
HIGH_BELOW, MEDIUM_BELOW = 0.7, 0.9
ANYONE_ELSE = "\u0001"


def _step(state: Column, e: Column) -> Column:
    """One action on ``state(status, assignee, ok)``; ``ok`` tells whether it was allowed."""
    status, holder, action, user = state["status"], state["assignee"], e["action"], e["user_id"]
    mine = holder.eqNullSafe(user)
    allowed = (
        ((action == "assign") & (status == "pending") & ~T.is_blank(user))
        | ((action == "reassign") & status.isin("assigned", "in_progress") & ~T.is_blank(user))
        | ((action == "start") & (status == "assigned") & mine)
        | ((action == "complete") & (status == "in_progress") & mine & ~T.is_blank(e["resolution"]))
        | ((action == "cancel") & status.isin("pending", "assigned"))
        | ((action == "reopen") & status.isin("completed", "cancelled")))
    ok = F.coalesce(allowed, F.lit(False))
    to = (
        F.when(action.isin("assign", "reassign"), "assigned").when(action == "start", "in_progress")
        .when(action == "complete", "completed").when(action == "cancel", "cancelled").otherwise("pending"))
    holder_after = F.when(action.isin("assign", "reassign"), user).when(action == "reopen", F.lit(None)).otherwise(holder)
    # one branch for all three fields, so that the guards are worked out once per event
    return F.when(ok, F.struct(to.alias("status"), holder_after.alias("assignee"), F.lit(True).alias("ok"))).otherwise(
        F.struct(status.alias("status"), holder.alias("assignee"), F.lit(False).alias("ok")))


def _state(status: Column, assignee: Column) -> Column:
    """A start state whose fields may become null while folding."""
    def open_type(c: Column) -> Column:
        return F.nullif(c.cast("string"), F.lit("\u0002"))

    return F.struct(open_type(status).alias("status"), open_type(assignee).alias("assignee"), F.lit(True).alias("ok"))


def _fold(events: Column, status: Column, assignee: Column) -> Column:
    return F.aggregate(events, _state(status, assignee), _step)


def _trace(events: Column, status: Column, assignee: Column) -> Column:
    """The state after every event of a segment, in order."""
    seen = F.aggregate(events, F.array(_state(status, assignee)), lambda acc, e: F.concat(acc, F.array(_step(F.element_at(acc, -1), e))))
    return F.slice(seen, 2, F.size(events))


#: events of a segment, and segments or groups of them that are joined at once
SEGMENT_EVENTS, FAN = 256, 64
_EVENT = ["ts", "event_id", "action", "user_id", "resolution"]


def _segments(events: DataFrame, size: int) -> DataFrame:
    """``(task_id, seg, ev)``: up to ``size`` events of a task that follow each other; ``seg`` grows with time within a task.

    Events are numbered in the order of (task, time), so the history of one
    busy task, or of one busy day of it, is spread like any other.
    """
    placed = numbered(events.select("task_id", *_EVENT), ["task_id", *_EVENT])
    return placed.groupBy("task_id", F.expr(f"place div {size}").alias("seg")).agg(F.sort_array(F.collect_list(F.struct(*_EVENT))).alias("ev"))


def _users(names: Column) -> Column:
    return F.array_union(F.array_compact(F.array_distinct(names)), F.array(F.lit(ANYONE_ELSE)))


def _starts(users: Column) -> Column:
    """Every state a segment could begin in: each status, held by each user it names or by anyone else."""
    return F.flatten(F.transform(F.array(*[F.lit(s) for s in STATES]), lambda s: F.transform(
        users, lambda u: F.struct(s.alias("status"), u.alias("assignee")))))


def _through(now: Column, ends: Column) -> Column:
    """The state after a segment with the transition map ``ends`` that begins in ``now``."""
    def at(a: Column) -> Column:
        hit = F.filter(ends, lambda e: (e["start"]["status"] == now["status"]) & (e["start"]["assignee"] == a))
        return F.get(hit, F.lit(0))["end"]

    end = F.coalesce(at(now["assignee"]), at(F.lit(ANYONE_ELSE)))
    holder = F.when(end["assignee"] == ANYONE_ELSE, now["assignee"]).otherwise(end["assignee"])
    return F.struct(end["status"].alias("status"), holder.alias("assignee"))


def _folded(pieces: DataFrame) -> DataFrame:
    """The transition map of each segment: its end for every state it could begin in."""
    starts = _starts(_users(F.transform("ev", lambda e: e["user_id"])))

    def end(st: Column) -> Column:
        state = _fold(F.col("ev"), st["status"], st["assignee"])
        return F.struct(state["status"].alias("status"), state["assignee"].alias("assignee"))

    return pieces.select("task_id", F.col("seg").alias("node"), F.transform(starts, lambda st: F.struct(st.alias("start"), end(st).alias("end"))).alias("ends"))


def _composed(chains: DataFrame) -> DataFrame:
    """The transition map of each group of segments, theirs one after the other."""
    named = F.flatten(F.transform("chain", lambda c: F.transform(c["ends"], lambda e: e["start"]["assignee"])))

    def end(st: Column) -> Column:
        begin = F.struct(F.nullif(st["status"], F.lit("\u0002")).alias("status"), F.nullif(st["assignee"], F.lit("\u0002")).alias("assignee"))
        return F.aggregate("chain", begin, lambda now, c: _through(now, c["ends"]))

    starts = _starts(_users(F.filter(named, lambda u: u != ANYONE_ELSE)))
    return chains.select("task_id", F.col("parent").alias("node"), F.transform(starts, lambda st: F.struct(st.alias("start"), end(st).alias("end"))).alias("ends"))


def _begin_states(pieces: DataFrame, tasks: DataFrame, fan: int) -> DataFrame:
    """``(task_id, seg, s, a)``: the state in which each segment begins.

    Maps of up to ``fan`` segments in a row are composed, round by round until
    one is left per task; then states are handed down the same tree.  No list
    is longer than ``fan``; the rounds are the logarithm of the segments.
    """
    base = tasks.select("task_id", F.col("status").alias("s"), F.col("assignee").alias("a"))
    count = pieces.groupBy("task_id").agg(F.count("*").alias("n"), F.min("seg").alias("seg"))
    begin = count.where("n = 1").join(base, "task_id").select("task_id", "seg", "s", "a")
    long = count.where("n > 1").select("task_id")
    if long.isEmpty():
        return begin
    level = _folded(pieces.join(long, "task_id", "left_semi"))
    chains: list[DataFrame] = []
    while True:
        chain = level.groupBy("task_id", F.expr(f"node div {fan}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "ends"))).alias("chain"))
        chains.append(stage(chain, "review_chains"))
        if chains[-1].groupBy("task_id").count().where("count > 1").isEmpty():
            break
        level = _composed(chains[-1])

    empty = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("node"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("a"))), 1, 0)

    def walk(acc: Column, c: Column) -> Column:
        entry = F.struct(c["node"].alias("node"), acc["now"]["status"].alias("s"), acc["now"]["assignee"].alias("a"))
        return F.struct(_through(acc["now"], c["ends"]).alias("now"), F.concat(acc["begun"], F.array(entry)).alias("begun"))

    known = chains[-1].join(base, "task_id")
    while chains:
        start = F.struct(F.struct(F.col("s").alias("status"), F.col("a").alias("assignee")).alias("now"), empty.alias("begun"))
        below = known.select("task_id", F.inline(F.aggregate("chain", start, walk)["begun"]))
        chains.pop()
        if chains:
            known = chains[-1].join(below.withColumnRenamed("node", "parent"), ["task_id", "parent"])
    return begin.unionByName(below.withColumnRenamed("node", "seg"))


def apply_events(tasks: DataFrame, events: DataFrame, segment_events: int = SEGMENT_EVENTS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Fold ordered actions into task states: ``(tasks, judged events with accepted)``.

    A task's history is cut into segments of ``segment_events`` events.  Each
    is folded once for every state it could start from (five statuses, each
    user it names, anyone else); these maps are composed in a tree, which gives
    the true start of every segment, and a last pass judges its events from
    there.  A task of one segment is folded from its own state alone.
    """
    pieces = stage(_segments(events, segment_events), "review_segments")
    begin = _begin_states(pieces, tasks, fan)
    traced = stage(pieces.join(begin, ["task_id", "seg"]).withColumn("states", _trace(F.col("ev"), F.col("s"), F.col("a"))), "review_states")
    final = traced.groupBy("task_id").agg(F.max_by(F.struct(F.element_at("states", -1).alias("now")), "seg").alias("_end")).select(
        "task_id", F.col("_end.now.status").alias("_status"), F.col("_end.now.assignee").alias("_assignee"))
    judged = traced.select("task_id", F.inline(F.arrays_zip("ev", "states"))).select(
        "task_id", "ev.ts", "ev.event_id", "ev.action", "ev.user_id", "ev.resolution", F.col("states.ok").alias("accepted"))
    orphan = events.join(tasks.select("task_id"), "task_id", "left_anti").select(
        "task_id", "ts", "event_id", "action", "user_id", "resolution", F.lit(False).alias("accepted"))

    # The remaining fields follow from accepted events alone, by plain aggregates.
    order = F.struct("ts", "event_id")
    ends_task = F.col("action").isin("complete", "reopen")
    gives = F.col("action").isin("assign", "reassign", "reopen")
    done = F.when(F.col("action") == "complete", F.struct("resolution", F.col("ts").alias("completed_at")))
    fields = judged.where("accepted").groupBy("task_id").agg(
        F.max_by(F.struct(done.alias("d")), F.when(ends_task, order)).alias("done"),
        F.max(F.when(ends_task, 1)).alias("closed"),
        F.max_by(F.struct(F.when(F.col("action") != "reopen", F.col("ts")).alias("at")), F.when(gives, order)).alias("given"),
        F.max(F.when(gives, 1)).alias("regiven"))
    joined = tasks.join(final, "task_id", "left").join(fields, "task_id", "left")
    changed = joined.withColumns({
        "status": F.coalesce("_status", "status"),
        "assignee": F.when(F.col("_status").isNull(), F.col("assignee")).otherwise(F.col("_assignee")),
        "resolution": F.when(F.col("closed") == 1, F.col("done.d.resolution")).otherwise(F.col("resolution")),
        "completed_at": F.when(F.col("closed") == 1, F.col("done.d.completed_at")).otherwise(F.col("completed_at")),
        "assigned_at": F.when(F.col("regiven") == 1, F.col("given.at")).otherwise(F.col("assigned_at")),
    }).select(*tasks.columns)
    return changed, judged.unionByName(orphan)


def priority_for(confidence: Column) -> Column:
    return F.when(confidence < HIGH_BELOW, "high").when(confidence < MEDIUM_BELOW, "medium").when(confidence.isNotNull(), "low").otherwise("medium")


def category_audits(cleaned: DataFrame) -> DataFrame:
    """A category audit task per row, its priority and title from the match confidence."""
    share = F.format_string("%.1f", F.col("match_confidence") * 100)
    return cleaned.select(
        F.col("row_id").alias("entity_id"), F.lit("category_match").alias("task_type"), F.lit("cleaned_data").alias("entity_type"),
        priority_for(F.col("match_confidence")).alias("priority"), F.lit("pending").alias("status"),
        F.concat(F.lit("分类审核 - 数据 #"), F.col("row_id").cast("string"), F.lit(" ("), share, F.lit("% 置信度)")).alias("title"),
        F.concat(F.lit("分类审核任务\n\n数据ID: "), F.col("row_id").cast("string"), F.lit("\n系统分配分类ID: "),
                 F.coalesce(F.col("category_id").cast("string"), F.lit("null")), F.lit("\n分类置信度: "), share, F.lit("%\n")).alias("description"))


def mapping_audits(mappings: DataFrame, ident: str) -> DataFrame:
    share = F.format_string("%.1f", F.col("confidence") * 100)
    return mappings.select(
        F.col(ident).alias("entity_id"), F.lit("field_mapping").alias("task_type"), priority_for(F.col("confidence")).alias("priority"),
        F.concat(F.lit("字段映射审核 - 映射 #"), F.col(ident).cast("string"), F.lit(" ("), share, F.lit("% 置信度)")).alias("title"))


def create(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Default and validate requests: ``(tasks, rejected with reasons)``."""
    problems = F.array_compact(F.array(
        F.when(F.col("task_type").isNull(), F.lit("task type missing")),
        F.when(T.is_blank(F.col("title")), F.lit("title missing")),
        F.when(F.col("entity_id").isNull(), F.lit("entity missing"))))
    checked = requests.withColumn("problems", problems)
    tasks = checked.where(F.size("problems") == 0).drop("problems").withColumns({
        "status": F.coalesce("status", F.lit("pending")), "priority": F.coalesce("priority", F.lit("medium"))})
    return tasks, checked.where(F.size("problems") > 0)


def search_tasks(tasks: DataFrame, keyword: str | None = None, statuses: tuple = (), priorities: tuple = (),
                 assignee: str | None = None, task_type: str | None = None, created: tuple = (None, None)) -> DataFrame:
    cond = Q.between("created_at", created)
    if keyword:
        cond.append(F.contains("title", F.lit(keyword)) | F.contains("description", F.lit(keyword)))
    if statuses:
        cond.append(F.col("status").isin(*statuses))
    if priorities:
        cond.append(F.lower("priority").isin(*[p.lower() for p in priorities]))
    if assignee:
        cond.append(F.col("assignee") == assignee)
    if task_type:
        cond.append(F.col("task_type") == task_type)
    return tasks.where(Q.all_of(cond))


def _urgency() -> list[Column]:
    return [S.priority_weight(F.col("priority")).desc(), F.col("due_at").asc(), F.col("created_at").desc(), F.col("task_id").asc()]


def by_urgency(tasks: DataFrame) -> DataFrame:
    """Highest priority first, then earliest due, then newest."""
    return tasks.orderBy(*_urgency())


def place_by_urgency(tasks: DataFrame) -> DataFrame:
    """All tasks with their ``place`` (from 0) in the order of :func:`by_urgency`."""
    return numbered(tasks, _urgency())


def queue(tasks: DataFrame, name: str, user: str | None = None) -> DataFrame:
    mine = F.col("assignee") == user
    conditions = {
        "my_pending": mine & F.col("status").isin("assigned", "in_progress"), "assigned": mine,
        "my_completed": mine & (F.col("status") == "completed"), "unassigned": F.col("status") == "pending",
        "in_progress": F.col("status") == "in_progress"}
    return tasks.where(conditions[name])


def select_tasks(tasks: DataFrame, task_type: str | None = None, entity_type: str | None = None, entity_id: int | None = None,
                 priority: str | None = None, status: str | None = None) -> DataFrame:
    """Tasks by type, entity, priority or status; what is not asked for does not filter."""
    asked = {"task_type": task_type, "entity_type": entity_type, "entity_id": entity_id, "priority": priority, "status": status}
    return tasks.where(Q.all_of([F.col(c) == v for c, v in asked.items() if v is not None]))


def quality_tasks(issues: DataFrame) -> DataFrame:
    """A data check task per entity of ``issues(entity_type, entity_id, priority, place, description, severity, field)``.

    Issues of an entity are few and listed by ``place``; an entity with a null
    description has none.
    """
    line = F.concat(
        F.lit(". "), F.col("description"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("   严重程度: "), F.col("severity"), F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("   字段: "), F.col("field"), F.lit("\n")), F.lit("")))
    found = issues.groupBy("entity_type", "entity_id").agg(
        F.max("priority").alias("priority"), F.sort_array(F.collect_list(F.when(F.col("description").isNotNull(), F.struct("place", line.alias("line"))))).alias("found"))
    n, ident = F.size("found"), F.col("entity_id").cast("string")
    listed = F.array_join(F.transform("found", lambda f, i: F.concat((i + 1).cast("string"), f["line"])), "")
    return found.select(
        "entity_type", "entity_id", F.lit("data_validation").alias("task_type"), F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.lit("pending").alias("status"),
        F.concat(F.lit("数据质量检查 - "), "entity_type", F.lit(" #"), ident, F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(" 个问题)"))).otherwise("")).alias("title"),
        F.concat(F.lit("数据质量检查任务\n\n实体类型: "), "entity_type", F.lit("\n实体ID: "), ident, F.lit("\n\n"),
                 F.when(n > 0, F.concat(F.lit("发现问题:\n"), listed)).otherwise("")).alias("description"))


def due(tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Add ``overdue``, ``due_soon`` and ``expiring`` to open tasks."""
    edge = now + F.expr(f"INTERVAL {hours} HOURS")
    is_open = F.col("status").isin(*OPEN)
    return tasks.where(is_open & F.col("due_at").isNotNull() & (F.col("due_at") <= edge)).withColumns({
        "overdue": F.col("due_at") < now, "due_soon": F.col("due_at") >= now, "expiring": F.col("due_at") <= edge})


def reminders(tasks: DataFrame, now: Column, user: str) -> DataFrame:
    """``(task_id, type, amount)``: due within a day, urgent, or assigned for over two days."""
    mine = queue(tasks, "my_pending", user)
    soon = (F.col("due_at") >= now) & (F.col("due_at") < now + F.expr("INTERVAL 24 HOURS"))
    stale = (F.col("status") == "assigned") & (F.col("assigned_at") < now - F.expr("INTERVAL 2 DAYS"))

    def kind(name: str, amount: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), amount.cast("long").alias("amount"))

    found = F.array(
        F.when(soon, kind("due_soon", F.timestamp_diff("HOUR", now, F.col("due_at")))),
        F.when(F.lower("priority").isin("high", "urgent"), kind("high_priority", S.priority_weight(F.col("priority")))),
        F.when(stale, kind("long_pending", F.timestamp_diff("DAY", F.col("assigned_at"), now))))
    return mine.select("task_id", F.inline(F.array_compact(found)))


def history(tasks: DataFrame) -> DataFrame:
    """``(task_id, type, at, detail)`` records of every task."""
    def record(name: str, at: str, detail: Column) -> Column:
        return F.when(F.col(at).isNotNull(), F.struct(F.lit(name).alias("type"), F.col(at).alias("at"), detail.alias("detail")))

    rows = F.array(
        record("create", "created_at", F.lit("任务创建")),
        record("assign", "assigned_at", F.concat(F.lit("分配给 "), F.coalesce("assignee", F.lit("null")))),
        record("status_change", "updated_at", F.concat(F.lit("状态变更为 "), F.col("status"))),
        record("complete", "completed_at", F.concat(F.lit("任务完成，解决方式: "), F.coalesce("resolution", F.lit("null")))))
    return tasks.withColumn(
        "updated_at", F.coalesce("completed_at", "assigned_at", "created_at")).select("task_id", F.inline(F.array_compact(rows)))


def auto_assign(tasks: DataFrame, block: int = 1024) -> DataFrame:
    """``(task_id, assignee)``: each pending task goes to the reviewer who has least by then.

    The reviewers with least open tasks are filled up to one level, as water
    would: prefix sums over the staff list tell how many share the tasks and
    what each gets.  Tasks, numbered in ranges, are dealt in runs of those
    numbers.  Afterwards two loads differ by more than one only where the
    higher got nothing.  Without reviewers nobody is assigned.
    """
    pending = numbered(tasks.where("status = 'pending'").select("task_id"), ["task_id"], "n")
    total = pending.agg(F.count("*")).scalar()
    load = tasks.where("assignee is not null").groupBy("assignee").agg(F.count_if(F.col("status").isin(*OPEN)).alias("load"))
    # One row per reviewer: a staff list, not data that grows with the tasks.
    staff, everyone = Window.partitionBy(F.lit(0)).orderBy("load", "assignee"), Window.partitionBy(F.lit(0))
    so_far = staff.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sharing = load.withColumns({"k": F.row_number().over(staff), "sum": F.sum("load").over(so_far)}).where(F.col("k") * F.col("load") - F.col("sum") <= total)
    water = sharing.withColumns({"all": F.count("*").over(everyone), "held": F.sum("load").over(everyone) + total})
    share = water.withColumn("quota", F.expr("held div `all`") - F.col("load") + F.when(F.col("k") <= F.col("held") % F.col("all"), 1).otherwise(0))
    runs = share.withColumn("to", F.sum("quota").over(so_far)).withColumn("from", F.col("to") - F.col("quota")).where("quota > 0")
    blocks = runs.withColumn("block", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}"))))
    return pending.withColumn("block", F.expr(f"n div {block}")).join(blocks, "block").where("n >= `from` and n < `to`").select("task_id", "assignee")


# What an approval does to a task, and how its comment is written down.
APPROVALS = {"approve": ("completed", "approved"), "reject": ("pending", "rejected"), "hold": ("pending", None)}
APPROVAL_NOTE = "审批意见"


def apply_approvals(tasks: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tasks, refused(task_id, at, reason))`` after ``approvals(task_id, user_id, result, comments, at, seq)`` in order.

    An approval completes the task, a rejection or a hold returns it; a hold
    keeps the resolution, and who completed a task stays written down.  Every
    comment is added to the description.  Only the last of each kind matters,
    so the state is one aggregate per task; comments of a task are few.
    """
    known = tasks.select("task_id", F.lit(True).alias("_known"))
    checked = approvals.join(known, "task_id", "left").withColumn(
        "reason", F.when(T.is_blank(F.col("user_id")), "blank user").when(T.is_blank(F.col("result")), "blank result")
        .when(F.col("_known").isNull(), "missing task"))
    good = checked.where("reason is null")
    place = F.struct("at", "seq")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.when(when, value), F.when(when, place))

    def effect(k: int) -> Column:
        out = F.lit(None).cast("string")
        for name, done in APPROVALS.items():
            out = F.when(F.col("result") == name, F.lit(done[k])).otherwise(out)
        return out

    moved, settled, approved = F.col("result").isin(*APPROVALS), F.col("result").isin("approve", "reject"), F.col("result") == "approve"
    said = ~T.is_blank(F.col("comments"))
    note = F.concat(F.lit(f"{APPROVAL_NOTE} ["), F.col("at").cast("string"), F.lit("] ["), "user_id", F.lit("]: "), "comments")
    after = good.groupBy("task_id").agg(
        last(effect(0), moved).alias("_status"), last(effect(1), settled).alias("_resolution"),
        last(F.col("user_id"), approved).alias("_by"), F.max(F.when(approved, F.col("at"))).alias("_done"),
        F.sort_array(F.collect_list(F.when(said, F.struct("at", "seq", note.alias("note"))))).alias("_notes"), F.max("at").alias("_at"))
    notes = F.transform("_notes", lambda n: n["note"])

    def old(c: str, kind: str) -> Column:
        return F.col(c) if c in tasks.columns else F.lit(None).cast(kind)

    written = F.concat_ws("\n\n", F.array_compact(F.concat(F.array(old("description", "string")), F.coalesce(notes, F.array().cast("array<string>")))))
    out = tasks.join(after, "task_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "resolution": F.coalesce(F.col("_resolution"), old("resolution", "string")),
        "completed_by": F.coalesce(F.col("_by"), old("completed_by", "string")), "completed_at": F.coalesce(F.col("_done"), old("completed_at", "timestamp_ntz")),
        "description": F.when(F.size("_notes") > 0, written).otherwise(old("description", "string")),
        "updated_at": F.coalesce(F.col("_at"), old("updated_at", "timestamp_ntz"))}).drop(
        "_status", "_resolution", "_by", "_done", "_notes", "_at")
    return out, checked.where("reason is not null").select("task_id", "at", "reason")


def set_status(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Apply ``edits(key, status, reviewer, comment)`` to matching rows.

    The last edit of a key holds; what an edit leaves null, and all of a row
    without an edit, stays as it was.
    """
    new = last_edits(edits, [key]).select(key, F.col("status").alias("_s"), F.col("reviewer").alias("_r"), F.col("comment").alias("_c"))

    def kept(new_value: str, column: str) -> Column:
        return F.coalesce(F.col(new_value), F.col(column)) if column in df.columns else F.col(new_value)

    return df.join(new, key, "left").withColumns({
        "status": kept("_s", "status"), "reviewer": kept("_r", "reviewer"), "comment": kept("_c", "comment")}).drop("_s", "_r", "_c")
