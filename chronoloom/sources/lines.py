"""Line records: bounded, strict about types, and ordered within their file.

A line is known by its file and ``ord``, which grows with its place in the file. Bodies are
parsed to declared fields in the projection that reads them and go no further.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_CAP, MAX_WARNINGS = 8 << 20, 20
KEY = ["provider", "session_id"]
_KINDS = {
    "string": r"^(STRING|VOID)$",
    "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|VOID)$",
    "boolean": r"^(BOOLEAN|VOID)$",
    "object": r"^(OBJECT.*|VOID)$",
    "required string": r"^STRING$",
}


@dataclass
class History:
    """What a source gives: sessions and their points, intervals, tokens, and what was wrong."""

    sessions: DataFrame
    points: DataFrame
    human: DataFrame
    exact: DataFrame
    tokens: DataFrame
    diagnostics: DataFrame
    #: (provider, session_id, source_file) where sessions are folded from several files; else each session names its own.
    owners: DataFrame | None = None


SESSION = "provider string, session_id string, cwd string, is_subagent boolean, approximate_cwd boolean, source_file string"
POINT = "provider string, session_id string, ts timestamp, model string, ord long"
EXACT = "provider string, session_id string, start timestamp, end timestamp, model string, ord long"
TOKEN = "provider string, session_id string, ts timestamp, model string, ord long, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"
DIAGNOSTIC = "source_file string, malformed_lines long, content_rejections long, unreadable_files long"


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = "*.jsonl") -> DataFrame:
    """(file, ord, value). Within a file, ``ord`` follows split offsets and, in a split, row numbers.

    A split holds no more rows than bytes, so twice its offset plus the row's number in
    the task keeps the order of the file.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * 2 + row).alias("ord"), "value"
    )


def literal_paths(files: list[str]) -> list[str]:
    """Paths that Spark's readers take as they are, not as patterns."""
    return [re.sub(r"([\\\[\]{}*?,])", r"\\\1", f) for f in files]


def kind_at(value: Column, path: str) -> Column:
    """The JSON type at a path; VOID for null, null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant"))


def well_formed(value: Column, kinds: dict[str, str], cap: int = LINE_CAP) -> Column:
    """Whether a line within the cap is a JSON object whose declared fields have their types.

    The line is parsed once, as the only item of an array whose items are tested: a filter
    that Spark moves down repeats a column's expression wherever it names the column.
    """

    def typed(record: Column) -> Column:
        ok = record.isNotNull()
        for path, kind in kinds.items():
            here = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
            ok = ok & F.coalesce(here, F.lit("" if kind.startswith("required") else "VOID")).rlike(_KINDS[kind])
        return ok

    small = (F.octet_length(value) <= cap) & value.rlike(r"^\s*\{")
    return F.coalesce(small & F.exists(F.array(F.try_parse_json(value)), typed), F.lit(False))


def parsed(lines: DataFrame, schema: str, kinds: dict[str, str], cap: int = LINE_CAP, **more: Column) -> DataFrame:
    """(file, ord, ok, r): records with only the declared fields; ``more`` are derived flags.

    They come out of a generator of one row, so that later filters on them are not moved
    below it, where each would parse the line again.
    """
    found = F.struct(
        well_formed(F.col("value"), kinds, cap).alias("ok"), F.from_json("value", schema).alias("r"), *[c.alias(k) for k, c in more.items()]
    )
    rows = lines.select("file", "ord", F.explode(F.array(found)).alias("x"))
    return rows.select("file", "ord", "x.*")


def diagnostics(lines: DataFrame, rejected: Column | None = None) -> DataFrame:
    """Malformed lines (empty ones too) and rejected records of each file."""
    bad = F.count_if(~F.col("ok"))
    turned_away = F.count_if(F.col("ok") & rejected) if rejected is not None else F.lit(0)
    return lines.groupBy(F.col("file").alias("source_file")).agg(
        bad.alias("malformed_lines"), turned_away.cast("long").alias("content_rejections"), F.lit(0).cast("long").alias("unreadable_files")
    )


def warnings(diagnostics_: DataFrame) -> DataFrame:
    """A message for each file with something wrong; the first malformed lines only are told one by one."""
    n = F.col("malformed_lines")
    told = F.concat(F.least(n, F.lit(MAX_WARNINGS)).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" malformed line(s): "), "source_file")
    turned = F.concat(F.col("content_rejections").cast("string"), F.lit(" content-bearing event record(s) skipped: "), "source_file")
    messages = F.array_compact(F.array(F.when(n > 0, told), F.when(F.col("content_rejections") > 0, turned)))
    return diagnostics_.withColumn("messages", messages)


def local_path(file: Column) -> Column:
    """A file's path without scheme."""
    from ..functions.paths import percent_decoded

    return percent_decoded(F.regexp_replace(file, "^[a-z]+:(//[^/]*)?", ""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent(path: Column, up: int = 1) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), "/")


def last_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_to(path: Column, root: str) -> Column:
    """The path below a root; the whole path if it is elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def nonzero(tokens: DataFrame) -> DataFrame:
    return tokens.where("input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens > 0")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a relation by name and type; absent ones are null."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def history(
    sessions: DataFrame, points: DataFrame, human: DataFrame, diagnostics_: DataFrame,
    exact: DataFrame | None = None, tokens: DataFrame | None = None, owners: DataFrame | None = None,
) -> History:
    spark = sessions.sparkSession
    return History(
        conform(sessions, SESSION), conform(points, POINT), conform(human, POINT),
        conform(exact, EXACT) if exact is not None else empty(spark, EXACT),
        conform(tokens, TOKEN) if tokens is not None else empty(spark, TOKEN),
        conform(diagnostics_, DIAGNOSTIC), owners,
    )


def union(histories: list[History]) -> History:
    from functools import reduce

    names = ("sessions", "points", "human", "exact", "tokens", "diagnostics")
    return History(*[reduce(DataFrame.unionByName, [getattr(h, n) for h in histories]) for n in names])


def usage(input_: Column, output: Column, read: Column, creation: Column) -> dict[str, Column]:
    """Token counters; input that was read from a cache is given as read, not as input, by the caller."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return {"input_tokens": zero(input_), "output_tokens": zero(output), "cache_read_tokens": zero(read), "cache_creation_tokens": zero(creation)}


def minus_cached(total: Column, cached: Column) -> Column:
    return F.greatest(F.coalesce(total, F.lit(0)) - F.coalesce(cached, F.lit(0)), F.lit(0))
