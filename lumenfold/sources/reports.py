"""Sinks for people: JSON and text results, HTML reports, metrics."""

from __future__ import annotations

import html
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "at timestamp, operation string, duration double, metadata map<string,string>"
#: Groups of one page of a report.
PAGE = 1000


def write_json(results: DataFrame, folder: str) -> None:
    results.write.mode("overwrite").json(folder)


def write_lines(results: DataFrame, folder: str, *, id_col: str = "id") -> None:
    """Ranked results as text, one a line, with the similarity as a percentage."""
    line = F.format_string("%d. %s (%.1f%%)", "rank", F.col(id_col).cast("string"), F.col("similarity") * 100)
    results.orderBy("rank").select(line.alias("value")).write.mode("overwrite").text(folder)


def html_report(groups: DataFrame, savings: dict, path: str, *, page: int = PAGE) -> int:
    """Pages with all groups (leader, n, bytes_saved, size_text), those that save most first, and totals on the first.
    `path` is the first page; the others are numbered beside it.  Returns the number of pages.  Rows are sorted by
    Spark and come one partition at a time, so the driver holds a page and a partition."""
    ordered = groups.orderBy(F.desc("bytes_saved"), "leader")
    first, rows, n = Path(path), [], 0
    name = lambda k: first if k == 0 else first.with_name(f"{first.stem}-{k + 1}{first.suffix}")
    head = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>\n" for k, v in savings.items())

    def put(k: int, last: bool) -> None:
        links = [f'<a href="{html.escape(name(at).name)}">{word}</a>' for at, word, there in ((k - 1, "before", k > 0), (k + 1, "next", not last)) if there]
        body = "".join(f"<tr><td>{html.escape(str(r['leader']))}</td><td>{r['n']}</td><td>{html.escape(r['size_text'])}</td></tr>\n" for r in rows)
        totals = f"<ul>\n{head}</ul>\n" if k == 0 else ""
        name(k).write_text(f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>Duplicates</title></head><body><h1>Duplicates</h1>\n{totals}<table><tr><th>kept</th><th>files</th><th>saved</th></tr>\n{body}</table><p>{' '.join(links)}</p></body></html>\n")

    for row in ordered.toLocalIterator():
        if len(rows) == page:
            put(n, False)
            rows, n = [], n + 1
        rows.append(row)
    put(n, True)
    return n + 1


class MetricLog:
    """Durations of operations, kept on the driver and written as rows of METRICS."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def log(self, operation: str, duration: float, **metadata) -> None:
        self.rows.append((time.time(), operation, float(duration), {k: str(v) for k, v in metadata.items()}))

    @contextmanager
    def timed(self, operation: str, **metadata):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.log(operation, time.perf_counter() - began, **metadata)

    def table(self) -> DataFrame:
        rows = self.spark.createDataFrame(self.rows, "at double, operation string, duration double, metadata map<string,string>")
        return rows.withColumn("at", F.timestamp_seconds("at"))

    def save(self, folder: str) -> None:
        self.table().write.mode("append").json(folder)


class StreamProgress(StreamingQueryListener):
    """Rows of METRICS for every batch of every stream of a session: how long its parts took, and what was observed in
    it.  They are written at the end, together with what else came to `log`.

        with StreamProgress(spark, folder) as progress:
            incremental.index_stream(..., log=progress.log).awaitTermination()
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, MetricLog(spark)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        parts = {f"ms.{k}": v for k, v in p.durationMs.items()}
        self.log.log("stream_batch", p.durationMs.get("triggerExecution", 0) / 1000, stream=p.name or str(p.id), batch=p.batchId, input_rows=p.numInputRows, **seen, **parts)

    def __enter__(self) -> StreamProgress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        self.spark.streams.removeListener(self)
        if self.log.rows:
            self.log.save(self.folder)


def health_report(catalog_images: DataFrame, files: DataFrame, path: str) -> None:
    """Counts and sizes of the catalog and of a folder's files, as text."""
    n, size = catalog_images.count(), files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    Path(path).write_text(f"images indexed: {n}\nfiles: {size['n']}\nbytes: {size['b']}\n")
