"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sievework.plans import all_plans  # noqa: F401
from sievework.plans.registry import QUERIES
from sievework.session import local_session

HEADLINE = [
    "inverted_index", "keyword_search", "bm25_search", "name_search", "lookup_longest", "lookup_similar", "vector_topk",
    "hybrid_search", "classified_intent", "consensus_cards_by_brand", "concept_index", "resolved_routes", "unique_slugs",
    "page_records", "context_ordered_items", "ttl_cache_hits", "recent_distinct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
