"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "locate_contracts_by_product_amount", "saved_queries_results", "product_amount_status", "product_rollup_per_contract",
    "claims_folded", "payment_status", "material_facts_page", "material_facts_by_file", "mention_contracts",
    "contract_table_rows", "contract_header_facts", "claim_ledger_rows", "document_sections", "material_fact_extraction",
    "time_requirements", "path_roles", "question_conditions", "section_search_top10", "evidence_packs",
    "vector_neighbours", "near_duplicate_clusters", "catalog_delta_counts", "ledger_next_snapshot", "draft_untraceable_numbers",
    "recall_per_query",
]


def main() -> None:
    from docketlens.session import get_spark
    from workload import load
    from workload.registry import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    load()
    spark = get_spark("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
