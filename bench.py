"""Headline queries on the benchmark tables; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.hashing import hash_uniform, keyed_hash
from plumbline.functions.scores import with_scores
from plumbline.operators import bootstrap as B
from plumbline.operators import calibration as C
from plumbline.operators import crossfit as X
from plumbline.operators import sampling as P
from plumbline.operators import summaries as S
from plumbline.plans.study import calibration_study
from plumbline.queries import derived as D
from plumbline.queries import all_queries
from plumbline.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def segment_systems(spark: SparkSession) -> DataFrame:
    """Three systems answering a five-way question about every customer."""
    segments = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    c = D.table(spark, SF_DIR, "customer").select(
        "c_custkey", "c_acctbal", (F.array_position(segments, F.col("c_mktsegment")) - 1).cast("int").alias("gold")
    )
    systems = F.array(*[F.struct(F.lit(n).alias("s"), F.lit(b).alias("b")) for n, b in (("one", 1.6), ("two", 1.1), ("three", 0.7))])
    noise = lambda i: hash_uniform(keyed_hash("bench", F.col("_s.s"), F.col("c_custkey"), i))
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda i: 3.0 * noise(i) + F.when(i == F.col("gold"), F.col("_s.b")).otherwise(0.0)
    )
    key = F.col("c_custkey")
    return D.spread(c).withColumn("_s", F.explode(systems)).select(
        F.col("_s.s").alias("system"), F.concat(F.lit("b"), (key % 9).cast("string")).alias("benchmark"),
        key.cast("string").alias("item_id"), key.cast("string").alias("question_id"), (key % 4).cast("string").alias("stratum"),
        segments.alias("keys"), V.softmax(logits).alias("probs"), F.col("gold").alias("gold_idx"), F.lit("choice:5:segments").alias("signature"),
    ).where("gold_idx >= 0")


def runs(spark: SparkSession):
    scored = lambda: with_scores(D.noul_preds(spark, SF_DIR))
    cluster = ["benchmark", "question_id"]

    def crossfit_temperature() -> DataFrame:
        items = D.noul_preds(spark, SF_DIR)
        folds = C.assign_folds(items)
        rows = C.training_rows(items.join(folds, [*cluster, "stratum"]), ["system", "benchmark"])
        return C.fit_temperature(rows, ["system", "benchmark"])

    def study() -> DataFrame:
        s = calibration_study(segment_systems(spark), X.DEFAULT_ARMS, reference="one", n_resamples=10_000)
        return s.estimates.join(s.deltas.groupBy("system", "arm", "benchmark").count(), ["system", "arm", "benchmark"], "left")

    yield "item_scores", lambda: drain(scored())
    yield "benchmark_summary", lambda: all_queries()["benchmark_summary"](spark, SF_DIR).collect()
    yield "ece_equal_mass", lambda: S.ece_equal_mass(scored(), ["system", "benchmark"]).collect()
    yield "split_halves", lambda: drain(P.split_halves(D.noul_preds(spark, SF_DIR).select("benchmark", F.col("item_id").alias("question_id"), "stratum")))
    yield "latest_records", lambda: drain(all_queries()["latest_records"](spark, SF_DIR))
    yield "latency_percentiles", lambda: all_queries()["latency_percentiles"](spark, SF_DIR).collect()
    yield "bootstrap_10k", lambda: B.bootstrap_intervals(scored(), ["system", "benchmark"], cluster, ["correct", "nll", "brier"], 10_000).collect()
    yield "crossfit_temperature", lambda: crossfit_temperature().collect()
    yield "first_token_read", lambda: drain(all_queries()["first_token_read"](spark, SF_DIR))
    yield "pride_debiased", lambda: drain(all_queries()["pride_debiased"](spark, SF_DIR))
    yield "question_bank", lambda: drain(all_queries()["question_bank"](spark, SF_DIR))
    yield "calibration_study", lambda: study().collect()


def main() -> None:
    spark = local_session(CPUS, int(CPUS), "plumbline-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers
    wanted = sys.argv[1:]
    times: dict[str, float] = {}
    for name, run in runs(spark):
        if wanted and name not in wanted:
            continue
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
