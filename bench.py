"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Every query is written to the noop sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from semspace.bindings import QUERIES
from semspace.session import build_session

HEADLINE = [
    "feature_table", "name_score_lookup", "dedup_keep_first", "item_text",
    "anchor_affinity", "top3_anchors", "group_minmax", "knn_exact", "grid_radius_nearest", "kmeans_assign",
    "kmeans_clusters", "layout_pca", "pca_reduce", "quantize_int8",
    "tfidf_vocab", "tfidf_weights", "lsa_embed",
    "combine_pairs", "combine_memo", "expand_round", "hub_candidates", "reach_closure",
    "assemble_points", "neighbor_edges", "palette_sections", "recipe_lookup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.ui.showConsoleProgress": "false"})
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").mapInArrow(  # start the JVM and the workers
        lambda batches: batches, "vec_id long, embedding array<float>, label int").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
