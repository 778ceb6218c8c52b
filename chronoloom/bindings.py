"""The driver's tables bound to the engine's relations, by integer rules that SQL can repeat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.globs import is_ignored
from .functions.names import UNKNOWN
from .operators.classify import with_category
from .operators.intervals import KEY

#: Path templates of changed files; the braces take a supplier's key.
PATHS = (
    "src/core/file{}.rs", "tests/unit/test_{}.py", "docs/guide{}.md", "config/app{}.yaml", "assets/logo{}.png",
    "node_modules/lib{}/index.js", "web/app{}.min.js", "pkg{}/.gitignore", "pkg{}/README", "data/blob{}.xyz",
    "Arc.Core.Specs/for_Thing/when_it{}.cs", "src/Latest{}Test.java",
)
START = "2024-01-01"


@dataclass
class Tables:
    sessions: DataFrame
    points: DataFrame
    human: DataFrame
    exact: DataFrame
    tokens: DataFrame
    commits: DataFrame
    files: DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a table is too small to be read by as many tasks; large tables stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are taken as UTC, the session's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their session: one for each user and six-hour slot."""
    user = F.col("user_id")
    slot = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(START).cast("timestamp"))) / 21_600_000_000)
    provider = F.get(F.array(*map(F.lit, ("claude", "codex", "gemini", "pi"))), (user % 4).cast("int"))
    root = F.concat(F.lit("root"), user % 3)
    repo = F.concat(F.lit("repo"), user % 10)
    return load(spark, sf_dir, "events").select(
        provider.alias("provider"),
        F.concat(F.lit("u"), user, F.lit("-"), slot.cast("long")).alias("session_id"),
        F.concat(F.lit("/work/"), root, F.lit("/"), repo).alias("cwd"),
        repo.alias("repo"),
        root.alias("root"),
        (user % 5 == 0).alias("is_subagent"),
        "ts",
        F.when(F.col("event_type") == "view", UNKNOWN).otherwise(F.concat(F.lit("m-"), "event_type")).alias("model"),
        F.col("event_id").alias("ord"),
        "event_type",
        "value",
        "props",
        "user_id",
    )


def commit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line, as commits."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return _as_commits(orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"))


def _as_commits(with_files: DataFrame) -> DataFrame:
    root, repo = F.concat(F.lit("root"), F.col("o_custkey") % 3), F.concat(F.lit("repo"), F.col("o_custkey") % 10)
    minute = (F.col("o_orderkey") * 37) % 43_200
    return with_files.select(
        F.md5(F.col("o_orderkey").cast("string")).alias("sha"),
        F.timestamp_micros(F.unix_micros(F.lit(START).cast("timestamp")) + minute * 60_000_000).alias("ts"),
        repo.alias("repo"),
        F.concat(F.lit("/work/"), root, F.lit("/"), repo).alias("cwd"),
        root.alias("root"),
        (F.col("o_orderstatus") == "P").alias("agent_authored"),
        (F.col("o_orderpriority") == "1-URGENT").alias("agent_assisted"),
        (F.col("o_orderpriority") == "5-LOW").alias("autofix_assisted"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = [p.split("{}") for p in PATHS]
    kind = (F.col("l_partkey") % len(PATHS)).cast("int")
    at = lambda i: F.get(F.array(*[F.lit(h[i]) for h in halves]), kind)
    lines = spread(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount"))
    # A generator of one row: filters by path rules stay above it, after the rows are dealt out.
    return lines.withColumn("path", F.explode(F.array(F.concat(at(0), F.col("l_suppkey").cast("string"), at(1))))).select(
        F.md5(F.col("l_orderkey").cast("string")).alias("sha"),
        "path",
        F.col("l_quantity").cast("long").alias("additions"),
        F.round(F.col("l_discount") * 100).cast("long").alias("deletions"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files with ``is_ignored`` and ``category``, row by row: a narrow step needs no shuffle."""
    kept = raw_files(spark, sf_dir).withColumn("is_ignored", is_ignored(F.col("path")))
    return with_category(kept).select("sha", "path", "additions", "deletions", "is_ignored", "category")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    ev = events(spark, sf_dir)
    stamp = [*KEY, "ts", "model", "ord"]
    k = F.get_json_object("props", "$.k").cast("long")
    purchase = ev.where("event_type = 'purchase'")
    return Tables(
        sessions=ev.select(*KEY, "cwd", "repo", "root", "is_subagent").distinct(),
        points=ev.select(*stamp),
        human=ev.where("event_type = 'click' AND NOT is_subagent").select(*stamp),
        exact=purchase.select(
            *KEY,
            F.col("ts").alias("start"),
            F.timestamp_micros(F.unix_micros("ts") + F.floor("value").cast("long") * 1_000_000).alias("end"),
            "model",
            "ord",
        ),
        tokens=ev.where("event_type = 'error'").select(
            *KEY,
            "ts",
            "model",
            k.alias("input_tokens"),
            (k * 2).alias("output_tokens"),
            (k % 7).alias("cache_read_tokens"),
            (k % 3).alias("cache_creation_tokens"),
        ),
        # Every reader joins the sums of ``files`` and so keeps orders with a line only; to look lines up here too would be one more exchange.
        commits=_as_commits(load(spark, sf_dir, "orders")),
        files=commit_files(spark, sf_dir),
    )
