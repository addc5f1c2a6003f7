"""Benchmark: the whole survey workflow on one scale factor.

Runs every registered query in workflow order on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``; each query is executed to
completion into Spark's no-op sink (nothing is collected).  One warm-up run,
then ``$BENCH_RUNS`` timed runs (default 3), each on a fresh workflow object
so shared intermediates are rebuilt every run; per-query and total times are
medians.  The queries that write and read files (round trips, exports) are
timed once, after the others, and are not part of the total.  Shuffle bytes written and stage counts per query come from Spark's
event log of the last run, written to a fresh scratch folder.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

ORDER = [
    "round_stack", "null_tokens_sentinels", "geo_enrich", "centroid_union", "market_other",
    "unit_price", "mean_national", "mean_market", "mean_settlement", "mean_district",
    "mean_region", "mean_all_levels", "count_region", "count_national", "settlements_per_region",
    "median_settlement", "impute_hierarchical", "basket_settlement", "basket_region",
    "basket_national", "rank_top_bottom", "pct_change_settlement", "pct_change_region",
    "pct_change_national", "pct_change_meb_settlement", "pct_change_meb_region",
    "pct_change_meb_national", "pct_change_merged", "share_select_one", "share_select_multiple",
    "numeric_mean_ci", "label_first_match", "top_answers", "area_scalars", "stat_format",
    "attach_p_value",
    "flag_substring", "unpivot_items", "pivot_two_values", "area_by_var_wide",
    "cleaning_apply", "cleaning_changelog", "cleaning_rejects", "derive_followups",
    "report_long", "report_by_settlement", "report_row", "rank_all", "analyse_plan", "label_by_list",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from souk.plans import catalog
    from souk.session import local_session
    from souk.sources.store import release
    scratch = tempfile.mkdtemp(prefix="souk-bench-")
    events = os.path.join(scratch, "events")
    os.makedirs(events)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="souk-bench",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": events,
                                 "spark.eventLog.compress": "false",
                                 "spark.eventLog.rolling.enabled": "false",
                                 "spark.checkpoint.dir": os.path.join(scratch, "checkpoints")})
    names = [n for n in ORDER if n in catalog.QUERIES]
    with_files = [n for n in catalog.QUERIES if n not in ORDER]

    def one_run(tag: str, names: list[str], fresh: bool = True) -> dict[str, float]:
        if fresh:
            catalog._ROUNDS.clear()
            spark.catalog.clearCache()
        out = {}
        for name in names:
            spark.sparkContext.setJobGroup(f"{tag}:{name}", name)
            t = time.perf_counter()
            catalog.run(name, spark, sf_dir, compare=False).write.format("noop").mode("overwrite").save()
            out[name] = time.perf_counter() - t
        return out

    one_run("warmup", names)  # JIT, file listing
    timed = [one_run(f"run{i}", names) for i in range(runs)]
    files = one_run("files", with_files, fresh=False)
    release(spark)
    per_query = {n: round(statistics.median(r[n] for r in timed), 3) for n in names}
    totals = [sum(r.values()) for r in timed]
    spark.stop()
    shuffle, stages = shuffle_metrics(events, f"run{runs - 1}:")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "workflow_total_sec", "value": round(statistics.median(totals), 3),
                      "unit": "sec", "queries": per_query, "file_queries": {n: round(t, 3) for n, t in files.items()}, "sf": sf, "cpus": cpus, "runs": runs,
                      "shuffle_bytes_total": sum(shuffle.values()),
                      "shuffle_bytes": shuffle, "stages": stages}))


def shuffle_metrics(events_dir: str, prefix: str) -> tuple[dict[str, int], dict[str, int]]:
    """Shuffle bytes written and completed stages per query (job group) of one
    run, from the event log."""
    stage_group: dict[int, str] = {}
    shuffle: dict[str, int] = {}
    stages: dict[str, int] = {}
    files = [os.path.join(d, f) for d, _, fs in os.walk(events_dir) for f in fs
             if not f.startswith("appstatus")]
    for path in files:
        with open(path) as fh:
            for line in fh:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "")
                    if group.startswith(prefix):
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group[len(prefix):]
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    name = stage_group.get(info["Stage ID"])
                    if name is None:
                        continue
                    stages[name] = stages.get(name, 0) + 1
                    for acc in info.get("Accumulables", []):
                        if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                            shuffle[name] = shuffle.get(name, 0) + int(acc.get("Value", 0))
    return shuffle, stages


if __name__ == "__main__":
    main()
