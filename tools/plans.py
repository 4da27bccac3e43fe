"""Write PLANS.md: the physical operator tree of the headline queries.

Usage: python tools/plans.py [sf_dir]   (default /root/testdata/sf0.1)
Each query is run once first so the adaptive plan shown is the final one.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from migtrack.session import get_session  # noqa: E402
from migtrack.plans import registry  # noqa: E402

NOTES = {
    "clean_script": "One projection, no Python and no exchange: 1000x the corpus is 1000x the tasks.",
    "drop_marked": "One projection (one linear regex per text, skipped by a byte search when a text "
                   "holds no marker).",
    "param_list": "The first exchange moves (name, ordinal, descriptor, count) after a map-side count, so a "
                  "name repeated across many schemas arrives collapsed; the second deals the distinct entries "
                  "by ranges, so a hot name is sorted by many tasks; the third brings the entries of a name and "
                  "range together, the last one part per name and range.",
    "metadata_upsert": "The batch is collapsed per key (a hot key leaves each task as one row), and one full outer "
                       "join with the target gives updates and inserts: one exchange a side. Rows with a NULL "
                       "key part go past the join on both sides (the other branches of the union). With "
                       "Store(buckets=N) the target's read is not shuffled.",
    "latest_status": "One exchange after a partial max_by: each task sends one row per procedure, "
                     "whatever the size of a procedure's history.",
    "attach_params": "param_list, then a left join on name; the list side is broadcast only when AQE "
                     "measures it below the threshold, otherwise both sides shuffle by name and a "
                     "skewed routine name is split by AQE.",
    "result_upsert": "Two log upserts (the first builds the target). Each is one aggregate over the "
                     "union of target and batch, both read once.",
    "stage_dedup": "Uploads parsed in a projection, union with the batch, null-safe anti join against "
                   "the staged keys (pruned to four columns), then the first row per key: a window limit "
                   "in each task before the shuffle, another after it.",
    "script_status": "latest_status (partial max_by) joined to the scripts; the status side is one "
                     "row per procedure and broadcast only when measured small.",
    "call_build": "param_list, routine join, partial min_by per name, call text in a projection.",
    "test_ids": "Three passes, cut by the same bounds: a sample of the order columns gives the bounds (the "
                "subquery), a count per range the offsets (the broadcast side, four rows a shuffle partition "
                "at most), and a window per range the positions. No checkpoint.",
    "step_counts": "Counts of every step's rows for the comparison with the oracle; the flows take "
                   "theirs from observations of what they write.",
}


def shape(plan: str) -> str:
    plan = plan.split("== Initial Plan ==")[0]  # an executed adaptive plan prints both trees
    out = []
    for i, line in enumerate(plan.splitlines()):
        # tree lines only: the root, or a child marked "+- " / ":- " (literals in
        # expressions can span lines and must not be read as operators)
        m = re.match(r"^((?:[ :|]*[+:]- )?)(\*\(\d+\) )?([A-Z][A-Za-z]+)(.*)$", line)
        if not m or (i > 0 and not m.group(1)):
            continue
        indent, _, op, rest = m.groups()
        detail = ""
        if op in ("Exchange", "BroadcastExchange"):
            detail = " " + rest.strip().split(",")[0].split("(")[0]
        if op == "FileScan":
            table = re.search(r"/(\w+)\.parquet", rest)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", rest)
            detail = f" {table.group(1) if table else ''}" + (f" pushed=[{pushed.group(1)}]" if pushed and pushed.group(1) else "")
        if op.endswith("Join"):
            kind = re.search(r"\b(Inner|LeftOuter|LeftAnti|LeftSemi|RightOuter|FullOuter)\b", rest)
            detail = f" {kind.group(1)}" if kind else ""
        out.append(f"{indent}{op}{detail}")
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    from bench import HEADLINE
    parts = ["# Physical plans of the headline queries\n",
             f"Final adaptive plans (after AQE re-planned with measured sizes) at `{sf_dir}` on "
             "`local[8]`, operators only, generated by `tools/plans.py`. `Exchange` is a shuffle, "
             "`ShuffleQueryStage`/`AQEShuffleRead` its materialised stage and coalesced read, "
             "`BroadcastExchange` a broadcast chosen from a measured size.\n"]
    for name in HEADLINE:
        df = registry.queries()[name](spark, sf_dir)
        plan_exec = df._jdf.queryExecution().executedPlan()
        plan_exec.execute().count()  # run this plan object, so AQE finalises it
        plan = plan_exec.toString()
        parts.append(f"## `{name}`\n\n{NOTES.get(name, '')}\n\n```\n{shape(plan)}\n```\n")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
