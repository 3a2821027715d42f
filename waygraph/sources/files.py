"""Content hashes, protected outputs, timing files, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import file_sha256
from ..schema import TIMINGS
from .text_formats import FormatError


#: rows that a report may have
REPORT_ROWS = 1000


def one_file(spark: SparkSession, path: str) -> str:
    """The file that a path, folder or pattern stands for; another number of files is an error."""
    found = spark.read.text(path).inputFiles()
    if len(found) != 1:
        raise FormatError(f"{path} is not one file")
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(found[0])).toString()


def sha256(spark: SparkSession, path: str) -> str:
    """Hash of one file's bytes."""
    return file_sha256(spark, one_file(spark, path))


def protect(outputs: list[str], inputs: list[str] = ()) -> None:
    """Outputs must be new, different from each other and from the inputs."""
    out = [Path(p).resolve() for p in outputs]
    if len(set(out)) != len(out) or set(out) & {Path(p).resolve() for p in inputs}:
        raise ValueError("outputs must differ from each other and from the inputs")
    for p in out:
        if p.exists():
            raise FileExistsError(str(p))


def read_timings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Timings of a run; the older header without wait and latency is read with wait 0 and latency = duration."""
    names = [f.split()[0] for f in TIMINGS.split(", ")]
    head = spark.read.text(path).limit(1).collect()
    got = head[0].value.strip().split(",") if head else []
    if got not in (names, names[:4]):
        raise FormatError("unexpected header of a timings file")
    schema = TIMINGS if got == names else ", ".join(TIMINGS.split(", ")[:4])
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    if got == names[:4]:
        df = df.withColumn("wait_ns", F.lit(0).cast("bigint")).withColumn("latency_ns", F.col("duration_ns"))
    return df


def write_timings_csv(timings: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in TIMINGS.split(", ")]
    timings.select(*names).write.mode("errorifexists").csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    """A report as a JSON file and a Markdown table beside it; more than REPORT_ROWS rows are an error, as they are no report."""
    rows = [r.asDict(recursive=True) for r in report.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows: write a table instead")
    protect([path, path + ".md"])
    Path(path).write_text(json.dumps(rows if len(rows) != 1 else rows[0], indent=2, default=str) + "\n", encoding="utf-8")
    cols = report.columns
    table = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(str(r[c]) for c in cols) + " |" for r in rows)]
    Path(path + ".md").write_text("\n".join(table) + "\n", encoding="utf-8")
