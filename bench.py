"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tonearm.plans import load  # noqa: E402
from tonearm.plans.registry import QUERIES  # noqa: E402
from tonearm.session import session  # noqa: E402
from tonearm.sources.adapters import Catalogue  # noqa: E402

HEADLINE = ["q_recommend_similar", "q_transition_chain", "q_recommend_personalized", "q_search_fuzzy", "q_seen", "q_taste",
            "q_history", "q_lyric_features", "q_content_knn", "q_normalize_frames"]


def peak_mb(pid: int) -> int | None:
    """Largest resident size of a process so far."""
    try:
        with open(f"/proc/{pid}/status") as lines:
            return next(int(line.split()[1]) // 1024 for line in lines if line.startswith("VmHWM"))
    except OSError:
        return None


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    load()
    spark = session(cpus, "tonearm-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times, rows = {}, {}

    def timed(name, fn):
        start = time.time()
        df = fn()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    catalogue = Catalogue.of(spark, folder)
    # stored once per catalogue, like the tables of a running system; timed on its own
    timed("prepare_library", lambda: catalogue.blocks)
    for name in names:
        timed(name, lambda: QUERIES[name](spark, folder))
    tracks = catalogue.fingerprints.count()
    pairs = tracks * (tracks - 1)
    out = {
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus, "library_rows": tracks,
    }
    if "q_recommend_similar" in times:
        out["similar_pairs_per_sec"] = round(pairs / times["q_recommend_similar"])
    if "q_transition_chain" in times:
        out["chain_pairs_per_sec"] = round(5 * pairs / times["q_transition_chain"])  # five steps
    out["jvm_peak_mb"] = peak_mb(spark._jvm.java.lang.ProcessHandle.current().pid())
    print(json.dumps(out))


if __name__ == "__main__":
    main()
