"""Tracks fetched over HTTP as a batch data source."""

from __future__ import annotations

import csv
import gzip
import io
import time
from collections.abc import Iterator, Mapping, Sequence
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import MISSING, staged

FORMAT = "tracks"


def fetch(url: str, tries: int, wait: float, timeout: float) -> tuple[str | None, str | None]:
    """(text, None), or (None, reason) after so many tries; a status below 500 but 429 isn't tried again."""
    reason = "no tries"
    for k in range(tries):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        try:
            with urlopen(url, timeout=timeout) as reply:  # noqa: S310
                body = reply.read()
            return (gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body).decode("utf-8", "replace"), None
        except HTTPError as e:
            reason = f"status {e.code}"
            if e.code < 500 and e.code != 429:
                break
        except (OSError, EOFError) as e:  # refused, reset, timed out, torn
            reason = f"{type(e).__name__}: {e}"
    return None, reason


def number(text: str | None) -> float | None:
    """None for empty and missing marks and for what is no number."""
    if text is None or text.strip() in ("", MISSING):
        return None
    try:
        value = float(text)
    except ValueError:
        return None
    return None if value != value else value


class Tracks(DataSource):
    """Options: url (a prefix that track ids are put behind), tracks (lines of caseid, tname, tid), batch, tries, wait, timeout."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "caseid int, tname string, tid string, t double, v double, error string"

    def reader(self, schema) -> TracksReader:  # noqa: ANN001
        return TracksReader(self.options)


class Batch(InputPartition):
    def __init__(self, tracks: Sequence[Sequence[str]]) -> None:
        super().__init__(None)
        self.tracks = tracks


class TracksReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.url = options["url"]
        self.tries, self.wait, self.timeout = int(options.get("tries", 3)), float(options.get("wait", 1)), float(options.get("timeout", 60))
        self.batch = max(1, int(options.get("batch", 16)))
        self.tracks = [row for row in csv.reader(io.StringIO(options["tracks"])) if row]

    def partitions(self) -> Sequence[Batch]:
        return [Batch(self.tracks[k : k + self.batch]) for k in range(0, len(self.tracks), self.batch)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for caseid, tname, tid in partition.tracks:
            case = int(caseid) if caseid else None
            text, reason = fetch(self.url + quote(tid), self.tries, self.wait, self.timeout)
            if text is None:
                yield case, tname, tid, None, None, reason
                continue
            rows = csv.reader(io.StringIO(text))
            next(rows, None)  # the header
            for row in rows:
                if row:
                    yield case, tname, tid, number(row[0]), number(row[1] if len(row) > 1 else None), None


def fetched(spark: SparkSession, tracks: DataFrame, url: str, batch: int = 16, tries: int = 3, wait: float = 1.0, timeout: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(values, failed) of the tracks (caseid, tname, tid): rows (caseid, tname, tid, t, v), and (caseid, tname, tid, error).

    The list of tracks, a short line each, goes to the driver as the reader's partitions; tasks fetch a batch of tracks each and
    parse it. A track that can't be had after the tries is a row of ``failed`` and stops nothing. What was fetched is written
    once, so nothing is asked for twice. The first column of a file is the time, the second the value; missing marks are null.
    """
    spark.dataSource.register(Tracks)
    lines = io.StringIO()
    csv.writer(lines).writerows([row["caseid"], row["tname"], row["tid"]] for row in tracks.select("caseid", "tname", "tid").distinct().toLocalIterator())
    options = {"url": url, "tracks": lines.getvalue(), "batch": str(batch), "tries": str(tries), "wait": str(wait), "timeout": str(timeout)}
    rows = staged(spark.read.format(FORMAT).options(**options).load(), "tracks")
    failed = F.col("error").isNotNull()
    return rows.where(~failed).drop("error"), rows.where(failed).select("caseid", "tname", "tid", "error")
