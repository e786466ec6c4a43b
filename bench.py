"""Headline queries at one scale: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_statistics", "fingerprint", "skip_filter", "chunk_text", "text_entries", "known_new_split", "duplicate_groups",
    "chunk_join_paths", "upsert_paths", "full_refresh", "incremental_refresh", "index_documents",
    "route", "search_terms", "knn_join", "knn_in_cells", "search_presets", "photo_search", "hybrid_merge",
    "render_content_groups", "dispatch", "folder_tree", "cluster_tree", "last_message", "question_answer_pairs",
    "assemble_tokens", "latest_change_per_path", "debounce", "top_processes",
    "extractive_layer", "format_layer", "domain_layer", "curriculum", "cap_layers", "combine_layers",
]


def refreshes(spark, folder):
    """The documents as files: a first index run over all of them and a second run with nothing changed."""
    from quarry.plans import index
    from quarry.plans.snapshot import Store
    from quarry.session import new_folder
    from quarry.sources import files
    from workload import trees
    from workload.registry import Tables

    store, root = Store(spark, new_folder(spark, "store")), trees.documents_tree(Tables(spark, folder))
    roots = trees.roots(root)[:-1]

    def run(batch):
        return lambda: index.refresh_from_disk(store, files.scan_files(spark, roots), root, roots, batch)

    return {"first_index": run("first"), "rescan_unchanged": run("second")}


def seconds(job, most: int) -> float:
    """The median of up to three runs; a job of over four seconds runs fewer times."""
    times: list[float] = []
    while len(times) < most and sum(times) < 8:
        start = time.perf_counter()
        job()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    from quarry.session import local_session
    from workload.catalog import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"), "bench")
    names = sys.argv[1:] or HEADLINE
    QUERIES["classify_source"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up the JVM
    times = {}
    jobs = {n: (lambda n=n: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save(), 3) for n in names}
    if not sys.argv[1:]:
        jobs |= {n: (job, 1) for n, job in refreshes(spark, folder).items()}
    for name, (job, most) in jobs.items():
        times[name] = seconds(job, most)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
