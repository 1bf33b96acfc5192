"""Run folders: what lies where, dumps of samples, the usage ledger, committed versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.documents import document_rows
from .readers import write_table

#: Where trajectories and rollouts lie below a run's folder.
TRAJECTORIES = "single_run/*/*.traj.json"
ROLLOUTS = {"naive": "naive_out/rollout_*/*/*/task-*/rollouts/rollout_*/messages.json", "lane": "lane_out/rollout_*/*/*/task-*/groups/group_*/branches/branch_*/summary.json"}
LEDGER = "schema_version string, event_id string, timestamp double, event_type string, group_id string, disposition string, reason string, phase string, payload string"


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files of a pattern in any store that Spark reads, sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(s.getPath().toString() for s in (found or []))


def find_trajectories(spark: SparkSession, run: str) -> list[str]:
    return _paths(spark, f"{run}/{TRAJECTORIES}")


def find_rollouts(spark: SparkSession, run: str) -> list[tuple[str, str]]:
    """(layout, folder) of each rollout, naive ones first."""
    return [(kind, path.rsplit("/", 1)[0]) for kind, pattern in ROLLOUTS.items() for path in _paths(spark, f"{run}/{pattern}")]


def expand_runs(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Folders of all patterns, each once, in order of first sight."""
    return list(dict.fromkeys(p for pattern in patterns for p in _paths(spark, pattern)))


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, document): whole files as texts."""
    if not paths:
        return spark.createDataFrame([], "path string, document string")
    return spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def context_rows(documents: DataFrame) -> DataFrame:
    """(path, row): the contexts of each document as JSON texts; a document without any raises."""
    rows = document_rows(F.col("document"))
    found = documents.select("path", rows.alias("_rows"))
    checked = F.when(F.col("_rows").isNotNull(), F.col("_rows")).otherwise(F.raise_error(F.concat(F.lit("no contexts in "), "path")).cast("array<string>"))
    return found.select("path", F.explode(checked).alias("row"))


def run_records(plan: list[dict] | None, spark: SparkSession, root: str | None) -> list[dict]:
    """Runs of a plan, or the folders below a root; exactly one of both, and no instance twice or none at all."""
    if (plan is None) == (root is None):
        raise ValueError("exactly one of plan and root is needed")
    rows = plan if plan is not None else [{"instance_id": p.rstrip("/").rsplit("/", 1)[1], "run_dir": p} for p in _paths(spark, f"{root}/*")]
    names = [r["run_dir"] for r in rows]
    if not rows or len(set(names)) != len(names):
        raise ValueError("no runs, or one of them twice")
    return sorted(rows, key=lambda r: (str(r["instance_id"]), r["run_dir"]))


def dump_path(template: str, rollout: int, evaluation: bool) -> str:
    return template.format(rollout_id=("eval_" if evaluation else "") + str(rollout))


def save_dump(samples: DataFrame, template: str, rollout: int, evaluation: bool = False) -> None:
    write_table(samples, dump_path(template, rollout, evaluation))


def resolve_dump(spark: SparkSession, template: str, rollout: int, evaluation: bool = False) -> str:
    """The dump of a rollout; a training one falls back to rollout 0, an evaluation never does."""
    for number in dict.fromkeys([rollout] if evaluation else [rollout, 0]):
        path = dump_path(template, number, evaluation)
        if _paths(spark, path):
            return path
    raise FileNotFoundError(dump_path(template, rollout, evaluation))


def load_dump(spark: SparkSession, template: str, rollout: int, evaluation: bool = False) -> DataFrame:
    return spark.read.parquet(resolve_dump(spark, template, rollout, evaluation))


def append_events(events: DataFrame, path: str) -> None:
    """Appends rows to the ledger; a missing event id is a hash of the row, a missing time is now."""
    names = [n.split()[0] for n in LEDGER.split(", ")]
    rows = events.select(*((F.col(n) if n in events.columns else F.lit(None).cast("string")).alias(n) for n in names))
    rows = rows.withColumns({
        "timestamp": F.coalesce(F.col("timestamp").cast("double"), F.unix_millis(F.current_timestamp()) / 1000), "schema_version": F.coalesce("schema_version", F.lit("usage.v1")),
        "event_id": F.coalesce("event_id", F.md5(F.to_json(F.struct(*names)).cast("binary"))),
    })
    rows.write.mode("append").json(path)


def record_disposition(spark: SparkSession, path: str, group: str, disposition: str, reason: str = "", phase: str = "train") -> None:
    row = [("group_disposition", group, disposition, reason, phase)]
    append_events(spark.createDataFrame(row, "event_type string, group_id string, disposition string, reason string, phase string"), path)


def ledger_events(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """First row of each event id; malformed lines are skipped. ``files``: only these, as a checkpoint named them."""
    rows = spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(files if files is not None else path)
    return rows.groupBy("event_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "event_id")), "timestamp").alias("r")).select("event_id", "r.*")


def ledger_offset(spark: SparkSession, path: str) -> list[str]:
    """The ledger's files so far: what a checkpoint keeps, so that a resumed run passes over later, orphaned ones."""
    return _paths(spark, f"{path}/*.json*")


def committed_version(spark: SparkSession, path: str) -> str:
    """The committed policy version: one row, not blank, or it raises."""
    rows = spark.read.schema("policy_version string").json(path).collect()
    if len(rows) != 1 or not (rows[0].policy_version or "").strip():
        raise ValueError(f"no single committed policy version in {path}")
    return rows[0].policy_version


def read_samples(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Samples of JSON lines by their schema, with ``rest``: a map of the members that it doesn't name, as JSON texts."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.filter(F.json_object_keys("value"), lambda k: ~k.isin(list(schema.names)))
    whole = F.from_json("value", "map<string,string>")
    rest = F.map_filter(whole, lambda k, v: F.array_contains(keys, k))
    return lines.select(F.from_json("value", schema).alias("s"), rest.alias("rest")).select("s.*", "rest")


def dataset_rows(tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Rows of several datasets under one schema: each with a map of its column names to the common ones; missing ones are null."""
    out = None
    for name, (rows, columns) in sorted(tables.items()):
        one = rows.select(*(F.col(columns.get(c, c)).alias(c) for c in _common(tables) if columns.get(c, c) in rows.columns), F.lit(name).alias("dataset"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _common(tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> list[str]:
    names = dict.fromkeys(n for rows, columns in tables.values() for n in [*columns, *(c for c in rows.columns if c not in columns.values())])
    return list(names)
