"""From API records to all-string raw tables.

Fetchers are plain functions of an opener (url, parameters -> decoded JSON), so
any transport can stand behind them; nothing here opens a connection.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomwork.functions.columns import quote

from .versions import Versions

Record = dict[str, Any]
Opener = Callable[[str, dict[str, Any]], Any]


class TooManyRequests(Exception):
    """Raised by an opener for HTTP 429."""


class NotAvailable(Exception):
    """Raised by an opener for other HTTP errors."""


def patient(opener: Opener, url: str, parameters: dict[str, Any], wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Open, and once more after a pause if there were too many requests."""
    try:
        return opener(url, parameters)
    except TooManyRequests:
        sleep(wait)
        return opener(url, parameters)


def paged(opener: Opener, url: str, size: int, **more: Any) -> list[Record]:
    """The first page of ``size`` records."""
    return patient(opener, url, {"per_page": size, "page": 1, **more})


def each(opener: Opener, url: str, ids: Iterable[str]) -> list[Record]:
    """A record per id; ids that the service does not have are skipped."""
    out = []
    for one in ids:
        try:
            out.append(patient(opener, f"{url}/{one}", {}))
        except NotAvailable:
            continue
    return out


def first(opener: Opener, url: str, limit: int, under: str | None = None) -> list[Record]:
    """The first records of a listing, or of the list at key ``under``."""
    found = opener(url, {})
    return (found[under] if under else found)[:limit]


def decoded(envelope: Record) -> list[Record]:
    """Rows of an answer envelope: a list is the rows, "nothing found" is none, any other text an error."""
    result = envelope.get("result")
    if isinstance(result, list):
        return result
    said = f"{envelope.get('message', '')} {result or ''}"
    if "No transactions found" in said or "No records found" in said:
        return []
    raise ValueError(said.strip())


def newest(opener: Opener, url: str, key: str, values: Iterable[str], size: int = 50) -> list[Record]:
    """The newest rows of each value, one after the other; a row of two values comes twice."""
    return [row for v in values for row in decoded(opener(url, {key: v, "offset": size, "page": 1, "sort": "desc"}))]


def as_text(value: Any) -> str | None:
    """None stays, booleans are true/false, lists and objects compact JSON, the rest its text."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list | dict):
        return json.dumps(value, separators=(",", ":"))
    return str(value)


def key_union(records: list[Record]) -> list[str]:
    """All keys in the order of first sight."""
    return list(dict.fromkeys(k for r in records for k in r))


def raw_frame(spark: SparkSession, records: list[Record], at: datetime | None = None) -> DataFrame:
    """The records as an all-string frame with ``_extracted_at``."""
    names = key_union(records)
    stamp = (at or datetime.now(UTC)).isoformat()
    rows = [(*[as_text(r.get(n)) for n in names], stamp) for r in records]
    return spark.createDataFrame(rows, StructType([StructField(n, StringType()) for n in [*names, "_extracted_at"]]))


def stringified(df: DataFrame) -> DataFrame:
    """A frame of any types as a raw one: nested columns become JSON, the rest strings."""
    nested = ("array", "struct", "map")
    return df.select(*[(F.to_json(quote(n)) if t.startswith(nested) else F.col(quote(n)).cast("string")).alias(n) for n, t in df.dtypes])


def united(parts: list[DataFrame]) -> DataFrame:
    """Rows of several raw frames; columns that one lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


RAW = "rows"


def write_raw(df: DataFrame, path: str) -> bool:
    """Replace the raw table at ``path`` in one step by a new version of it; an empty input keeps the old one. Whether it wrote.

    ``df`` may read the table itself.
    """
    if df.isEmpty():
        return False
    Versions(df.sparkSession, path).replace({RAW: df})
    return True


def read_raw(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The raw table at ``path``, or a version of it."""
    return Versions(spark, path).read(RAW, version)


def seed(spark: SparkSession, fetchers: dict[str, Callable[[], list[Record]]], folder: str, at: datetime | None = None) -> dict[str, Any]:
    """Fetch everything, then write: a source that fails leaves all tables as they were."""
    fetched = {name: fetch() for name, fetch in fetchers.items()}
    written = {name: len(rows) for name, rows in fetched.items() if rows and write_raw(raw_frame(spark, rows, at), f"{folder}/{name}")}
    return {"tables_synced": sorted(written), "rows": sum(written.values())}


def save_samples(fetchers: dict[str, Callable[[], list[Record]]], folder: str, sizes: dict[str, int]) -> dict[str, int]:
    """Fetch each source once and keep its first records as ``folder/<name>.json``, for tests without a network; how many of each.

    All are fetched before any is written.
    """
    kept = {name: fetch()[: sizes.get(name, 5)] for name, fetch in fetchers.items()}
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, rows in kept.items():
        Path(folder, f"{name}.json").write_text(json.dumps(rows, indent=2))
    return {name: len(rows) for name, rows in kept.items()}


def probe(frames: dict[str, DataFrame]) -> tuple[str, bool]:
    """A Markdown table of row counts and columns, and whether every table has rows."""
    lines, full = ["| table | rows | columns |", "|---|---|---|"], True
    for name, df in frames.items():
        n = df.count()
        full &= n > 0
        lines.append(f"| {name} | {n} | {', '.join(f'{c} {t}' for c, t in df.dtypes)} |")
    return "\n".join(lines), full


def dict_rows(df: DataFrame, limit: int) -> list[Record]:
    """At most ``limit`` rows as dictionaries, for small summaries."""
    return [r.asDict() for r in df.limit(limit).collect()]
