"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with cold and warm seconds."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webfacts.registry import load_all  # noqa: E402
from webfacts.session import local_session  # noqa: E402

HEADLINE = [
    "vec_02_knn", "vec_04_knn_join", "vec_04b_knn_join_cells", "vec_05_lsh_knn", "vec_07b_bm25", "vec_11_hybrid_search", "vec_21_uniqueness", "vec_30_embedding",
    "src_02_find_or_create_pages", "jn_06_lateral_topk", "jn_09_color_match", "jn_10_keyword_dictionary",
    "agg_02_industry_averages", "agg_09_latency_floor_index", "agg_10_latency_interpolated", "agg_15_motion_summary",
    "win_04_running_offset", "win_09_gap_sessions", "win_11_recent_history", "win_12_cumulative_percentile",
    "ts_02_sequence_shift", "ts_04_autocorrelation", "ts_07_animation_category",
    "pg_01_sections", "pg_02_section_content", "pg_09_complexity", "pg_16_motions", "pg_27_content_gaps", "sc_09_html_quality", "sc_14_batch_evaluation",
    "st_02_hourly_stats",
]


def run(fn, spark, folder) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    queries, _ = load_all()
    cold, warm, failed = {}, {}, {}
    for name in HEADLINE:
        try:
            cold[name] = run(queries[name], spark, folder)
            warm[name] = run(queries[name], spark, folder)
        except Exception as e:
            failed[name] = str(e)[:200]
    from webfacts.sources.tables import load

    n_pages, n_vec = load(spark, folder, "pages").count(), load(spark, folder, "embeddings").count()
    out = {
        "metric": "warm seconds, sum over headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "failed": failed,
        "pages_per_sec": {q: round(n_pages / warm[q]) for q in ("pg_02_section_content", "pg_09_complexity", "sc_09_html_quality") if q in warm},
        "knn_pairs_per_sec": round(n_vec * n_vec / warm["vec_04_knn_join"]) if "vec_04_knn_join" in warm else None,
        "cores": int(cpus),
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
