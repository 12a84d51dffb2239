"""Times of headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, as one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from tidewatch import catalog  # noqa: E402
from tidewatch.operators import rules  # noqa: E402
from tidewatch.sources import readers  # noqa: E402

HEADLINES = (
    "rule_counter_threshold rule_dedup rule_sequence_3step rule_delay_absence rule_checknotice rule_explain agg_count_grouped agg_distinct_count_grouped agg_top_grouped win_sliding_count win_sliding_distinct_count"
    " win_tumbling_hourly_sum node_dual_div node_sequence_mean late_classification filter_tree_nested hmac_at_rest alerts_trend rollup_hourly check_risk_decision"
).split()


def strategies(n: int, apart: bool = False) -> list[rules.Strategy]:
    """Rules in the shape of the usual ones: a trigger, a counter over one of four windows, a field guard. apart: no two share a counter."""
    out = []
    for i in range(n):
        event = ("signup", "error", "click", "view", "purchase")[i % 5]
        counter = {"kind": "counter", "counter": {"event": event, "window": (3600, 21_600, 86_400, 259_200)[i % 4] + apart * i, "algorithm": ("count", "sum", "count", "distinct_count")[i % 4], "operand": [[], ["amount"], [], ["grp"]][i % 4], "groupby": ["uid"]}}
        tree = {"op": "and", "conditions": [{"left": {"kind": "event_field", "field": "amount"}, "op": ">", "right": {"kind": "constant", "value": str(i % 50)}}, {"left": counter, "op": ">", "right": {"kind": "constant", "value": str(1 + i % 3)}}]}
        out.append(rules.Strategy(f"rule_{i}", tree, event, action={"check_value": "uid", "dedup_window": 300}))
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = readers.events_table(spark, sf).count()
    jobs = {q: (lambda q=q: catalog.QUERIES[q](spark, sf)) for q in HEADLINES}
    jobs |= {f"rules_{n}": (lambda n=n: rules.run(readers.events_table(spark, sf), strategies(n), catalog.EVENTS)) for n in (10, 50, 170)}
    jobs["rules_170_apart"] = lambda: rules.run(readers.events_table(spark, sf), strategies(170, apart=True), catalog.EVENTS)
    took = {}
    for name, job in jobs.items():
        job().write.format("noop").mode("overwrite").save()  # compiles
        began = time.time()
        job().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    rates = {f"events_per_s_{n}_rules": round(events / took[f"rules_{n}"]) for n in (10, 50, 170)}
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "cores": int(cpus), "events": events, **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
