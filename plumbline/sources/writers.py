"""Sinks: compacted records, frozen splits with digests, parameter tables, reports."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import checkpoint

DIGEST_BUCKETS = 4096


def write_records(latest: DataFrame, path: str) -> None:
    """One row per item, replacing only the (system, benchmark, split) partitions written."""
    (
        latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("system_id", "benchmark", "split").parquet(path)
    )


def table_digest(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest per group: hashes of the rows' JSON are summed per hash bucket in four 48-bit
    lanes (a multiset hash that aggregates partially), and the bucket digests are hashed in
    bucket order."""
    groups = list(groups)
    hashed = df.select(
        *groups, F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in groups])), 256).alias("_h")
    )
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    lanes = [
        F.sum(F.conv(F.substring("_h", 4 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_l{i}")
        for i in range(4)
    ]
    per_bucket = hashed.groupBy(*groups, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), *lanes)
    text = F.concat_ws(":", F.col("_n").cast("string"), "_l0", "_l1", "_l2", "_l3")
    # At most DIGEST_BUCKETS entries per group.
    whole = per_bucket.groupBy(*groups).agg(
        F.sum("_n").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct("_bucket", F.sha2(text, 256).alias("d")))).alias("_b"),
    )
    return whole.select(
        *groups, "n_rows",
        F.sha2(F.array_join(F.transform("_b", lambda b: F.concat(b["_bucket"].cast("string"), F.lit("="), b["d"])), "\n"), 256).alias("digest"),
    )


def freeze_split(items: DataFrame, path: str, benchmark: str, split: str, seed: int, screen_size: int | None = None) -> DataFrame:
    """Items of a frozen split: written on first use, afterwards read back and checked against the
    stored parameters and digest."""
    spark = items.sparkSession
    meta_path, items_path = f"{path}/{benchmark}.{split}.meta", f"{path}/{benchmark}.{split}.items"
    wanted = (benchmark, split, seed, screen_size)
    if not _exists(spark, f"{meta_path}/_SUCCESS"):
        items.write.mode("overwrite").parquet(items_path)
        digest = table_digest(spark.read.parquet(items_path)).select(
            F.lit(benchmark).alias("benchmark"), F.lit(split).alias("split"), F.lit(seed).alias("seed"),
            F.lit(screen_size).cast("int").alias("screen_size"), "n_rows", "digest",
        )
        digest.coalesce(1).write.mode("overwrite").json(meta_path)
    stored = spark.read.schema(
        "benchmark string, split string, seed int, screen_size int, n_rows long, digest string"
    ).json(meta_path).first()
    found = (stored["benchmark"], stored["split"], stored["seed"], stored["screen_size"])
    if found != wanted:
        raise ValueError(f"{meta_path} holds {found}, requested {wanted}; use another folder")
    frozen = spark.read.parquet(items_path)
    current = table_digest(frozen).first()
    if current is None or current["digest"] != stored["digest"]:
        raise ValueError(f"{items_path} was modified after it was written")
    return frozen


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# --- manifests -----------------------------------------------------------------------------------

RUN_FIELDS = ("benchmark", "split", "status", "n_items", "n_ok", "n_errors", "spent_usd")
CALL_FIELDS = ("started_at", "finished_at", "status", "concurrency", "n_called", "n_errors", "n_cache_hits", "spent_usd")
MANIFEST_SCHEMA = (
    "system_id string, run_key string, benchmark string, split string, status string, n_items bigint, n_ok bigint, n_errors bigint, spent_usd double, "
    "invocations array<struct<started_at:timestamp,finished_at:timestamp,status:string,concurrency:int,n_called:bigint,n_errors:bigint,n_cache_hits:bigint,spent_usd:double>>"
)
COMMIT_TRIES = 20
WHOLE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
T_COLUMNS = ("system_id", "run_key", *RUN_FIELDS, "invocations")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def read_manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Run rows (:data:`MANIFEST_SCHEMA`) of the newest published version, or of ``version``; no rows
    before the first."""
    published = _versions(spark, folder)
    if not published:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).option("timestampFormat", WHOLE_TIME).json(f"{folder}/v{published[-1] if version is None else version}")


def merged_manifest(known: DataFrame, more: DataFrame) -> DataFrame:
    """Both manifests' runs, one row each: invocations are those of either, one for each start (a
    finished one beats its running state), and the run's own figures come from whoever saw the newest
    invocation (ties: more items answered). The merge does not depend on the order of its inputs, and
    merging the same rows again changes nothing."""
    keys = ["system_id", "run_key"]
    both = known.select(*T_COLUMNS).unionByName(more.select(*T_COLUMNS))
    newest = F.array_max(F.transform("invocations", lambda i: F.coalesce(i["started_at"], F.lit("1970-01-01").cast("timestamp"))))
    figures = F.struct(*RUN_FIELDS)
    own = both.groupBy(*keys).agg(F.max_by(figures, F.struct(newest.alias("seen"), F.col("n_ok"), F.col("n_items"), F.to_json(figures))).alias("_r"))
    calls = both.select(*keys, F.inline("invocations"))
    call = F.struct(*CALL_FIELDS)
    state = F.struct(F.col("finished_at").isNotNull().alias("done"), F.col("finished_at"), F.col("n_called"), F.to_json(call).alias("text"))
    one = calls.groupBy(*keys, "started_at").agg(F.max_by(call, state).alias("call"))
    # A run's invocations are one list by the manifest's own format.
    listed = one.groupBy(*keys).agg(F.sort_array(F.collect_list("call")).alias("invocations"))
    none = F.expr("cast(array() as " + MANIFEST_SCHEMA.split("invocations ", 1)[1] + ")")
    return own.join(listed, keys, "left").select(*keys, "_r.*", F.coalesce("invocations", none).alias("invocations"))


def commit_manifest(runs: DataFrame, folder: str) -> int:
    """Publishes ``runs`` merged into the manifest of ``folder`` and returns the version that holds them.

    A version is written aside and published by one rename to a name that must not exist (atomic as far
    as the file system's rename is), so readers see whole versions only. A writer that finds its version's name taken merges with what the other
    one published and tries the next. Runs that change nothing (a replay) publish nothing.
    """
    spark = runs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), conf) if "://" in folder else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    runs = checkpoint(runs.select(*T_COLUMNS))
    for _ in range(COMMIT_TRIES):
        version = (_versions(spark, folder) or [0])[-1]
        known = read_manifest(spark, folder)
        merged = checkpoint(merged_manifest(known, runs))
        if version and table_digest(merged).first() == table_digest(merged_manifest(known, known.limit(0))).first():
            return version
        aside = f"{folder}/_aside-{uuid4().hex}"
        merged.repartition("system_id").write.option("timestampFormat", WHOLE_TIME).json(aside)
        try:
            files.rename(path(aside), path(f"{folder}/v{version + 1}"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            files.delete(path(aside), True)
            if "already exists" not in str(error.java_exception).lower() and "alreadyexists" not in str(error.java_exception).lower():
                raise
            continue
        return version + 1
    raise RuntimeError(f"{folder}: {COMMIT_TRIES} versions in a row were published by others")


def save_parameters(table: DataFrame, path: str) -> None:
    """Calibrators or priors as JSON rows (arrays and NULLs survive the round trip)."""
    table.write.mode("overwrite").json(path)


def load_parameters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_study(predictions: DataFrame, estimates: DataFrame, fits: DataFrame, path: str) -> None:
    """Per-item predictions (six decimals, one partition per system), estimates and fits."""
    rounded = predictions.withColumn("probs", F.transform("probs", lambda x: F.round(x, 6)))
    rounded.write.mode("overwrite").partitionBy("system").parquet(f"{path}/predictions")
    estimates.write.mode("overwrite").json(f"{path}/estimates")
    fits.write.mode("overwrite").json(f"{path}/fits")


# --- markdown -------------------------------------------------------------------------------------


def markdown_table(
    summary: DataFrame, columns: Sequence[tuple[str, str, str]], order: Sequence[Column | str]
) -> str:
    """A summary table (aggregated rows only) as markdown. ``columns``: (column, title, format);
    a missing value prints empty. Rows come over a partition at a time."""
    rows = summary.select(*summary.columns).orderBy(*order).toLocalIterator()
    lines = ["| " + " | ".join(title for _, title, _ in columns) + " |", "|" + " --- |" * len(columns)]
    for row in rows:
        cells = ["" if row[c] is None else format(row[c], spec) for c, _, spec in columns]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"


def interval_text(estimate: Column, low: Column, high: Column, digits: int = 4, signed: bool = False) -> Column:
    """``estimate [low, high]`` with fixed decimals."""
    spec = f"%{'+' if signed else ''}.{digits}f"
    return F.format_string(f"{spec} [{spec}, {spec}]", estimate, low, high)
