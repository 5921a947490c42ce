"""Headline timings.  Prints one JSON line.

The rows are ``raw_rows_big``: one spreadsheet row per lineitem.  Input views
are written before the clock starts, as imported files would be; every timed
query recomputes its own work and feeds a sink that discards the rows, or, for
the cleaning run, writes the cleaned table that the later queries read.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from partsmith.catalog import cleaned as C, externals as X, libraries as L, mappings as M, registry  # noqa: E402,F401
from partsmith.catalog.tables import Tables  # noqa: E402
from partsmith.operators import checks, external, ingest, library, mapping, reports, review, scoring  # noqa: E402
from partsmith.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = build_session("bench", CPUS, shuffle_partitions=2 * int(CPUS))
    t = Tables(spark, SF_DIR, {"raw_rows": "raw_rows_big", "raw_header": "raw_header_big"})
    for name in ("taxonomy", "synonyms", "std_header", "raw_rows", "raw_header", "review_tasks", "review_events", "callbacks"):
        t[name].count()
    timings: dict[str, float] = {}

    def timed(name: str, build) -> None:
        start = time.time()
        df = build()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)

    tax, syn, raw, header = t["taxonomy"], t["synonyms"], t["raw_rows"], t["raw_header"]
    timed("extract_attrs", lambda: ingest.extract_attrs(raw, header))

    def clean() -> None:
        C.cleaned(t)

    timed("clean_batch", clean)
    rows = C.cleaned(t)
    idx = L.indexes(t)
    timed("recall", lambda: library.recall(rows, tax, idx))
    timed("rule_check", lambda: library.rule_check(rows, tax, idx))
    timed("dup_flag", lambda: scoring.flag_duplicates(rows.drop("is_duplicate")))
    timed("thresholds", lambda: scoring.thresholds(rows.select("title_id", F.col("quality_score").alias("score"))))
    timed("fill_all", lambda: mapping.fill_all(rows, M.mappings(t), C.parsed(t), header, t["std_header"]))
    timed("recheck", lambda: checks.detect(L.recheck_input(t), tax, idx))
    timed("category_counts", lambda: reports.by_category(rows, tax))
    timed("classify_documents", lambda: checks.classify_text(
        t["documents"].select(F.col("doc_id").alias("text_id"), "text"), tax, idx))
    timed("review_fold", lambda: review.apply_events(t["review_tasks"], t["review_events"])[0])
    timed("callback_merge", lambda: external.upsert_rows(X.stored(t), external.result_items(external.once(t["callbacks"]))))

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": SF_DIR.rstrip("/").split("sf")[-1], "rows": raw.count(), "cores": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
