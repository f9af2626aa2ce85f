"""Extracts of many formats as text tables, their paths, separators and encodings; and the ways results are written.

A file's form (separator, encoding, title rows) is decided on the driver from its first 64 kilobytes; the rows
are read by Spark. Only what Spark cannot split or unpack (zip, xz, spreadsheets) is read on the driver, and a
file beyond ``MAX_DRIVER_BYTES`` is refused there.
"""

from __future__ import annotations

import bz2
import csv
import glob as globbing
import gzip
import io
import json
import lzma
import os
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITED = {".csv", ".tsv", ".tab", ".psv", ".txt", ".dat"}
SHEETS = {".xlsx", ".xlsm", ".xls"}
HEAD = 65_536
MAX_DRIVER_BYTES = 256 * 1024 * 1024


def bare_suffix(path: str) -> str:
    """The suffix of a file's format, a compression's aside."""
    p = Path(path)
    return (Path(p.stem).suffix if p.suffix.lower() in (".gz", ".bz2", ".zip", ".xz", ".zst") else p.suffix).lower()


def _open(path: str) -> io.BufferedIOBase:
    kind = Path(path).suffix.lower()
    if kind == ".gz":
        return gzip.open(path, "rb")
    if kind == ".bz2":
        return bz2.open(path, "rb")
    if kind == ".xz":
        return lzma.open(path, "rb")
    if kind == ".zst":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(open(path, "rb"))
    if kind == ".zip":
        z = zipfile.ZipFile(path)
        names = [n for n in z.namelist() if not n.endswith("/")]
        if len(names) != 1:
            raise ValueError(f"{path}: a zip must hold one file, this one holds {len(names)}")
        return z.open(names[0])
    return open(path, "rb")


def head_bytes(path: str) -> bytes:
    with _open(path) as f:
        return f.read(HEAD)


def sniff_encoding(head: bytes) -> str:
    """utf-8 where the bytes are, else cp1252; a character cut off at the end does not count."""
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8-sig")
            return "utf-8"
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4:
                break
    return "cp1252"


def sniff_delimiter(text: str, suffix: str = "") -> str:
    """The one of comma, semicolon, tab and bar that parts the first lines alike; else tab for .tsv and .tab, comma for the rest."""
    rows = [r for r in text.splitlines()[:50] if r.strip()]
    best, score = None, 0
    for sep in ",;\t|":
        counts = [len(r) for r in csv.reader(rows, delimiter=sep)]
        if counts and counts[0] > 1:
            agree = sum(c == counts[0] for c in counts) / len(counts) * counts[0]
            if agree > score:
                best, score = sep, agree
    return best or ("\t" if suffix in (".tsv", ".tab") else ",")


def expand_paths(paths: str | list[str]) -> list[str]:
    """Files, folders, patterns or a list of them, as a sorted list of files; hidden files and note sidecars are passed over."""
    out: set[str] = set()
    for p in [paths] if isinstance(paths, str) else paths:
        found = [str(x) for x in Path(p).rglob("*")] if os.path.isdir(p) else globbing.glob(p) if any(c in p for c in "*?[") else [p]
        if not found:
            raise FileNotFoundError(p)
        out.update(x for x in found if not os.path.isdir(x))
    kept = sorted(x for x in out if not Path(x).name.startswith(".") and not x.endswith(".NOTE.txt"))
    missing = [x for x in kept if not os.path.exists(x)]
    if missing or not kept:
        raise FileNotFoundError(", ".join(missing) or str(paths))
    return kept


def _text_frame(spark: SparkSession, header: list[str], rows: list[list[str]]) -> DataFrame:
    names = _unique(header)
    return spark.createDataFrame([tuple((r + [None] * len(names))[: len(names)]) for r in rows], ", ".join(f"`{n}` string" for n in names))


def _unique(header: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for k, h in enumerate(header):
        name = (h or "").replace("`", "'").strip() or f"column_{k + 1}"
        seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(name if seen[name.lower()] == 1 else f"{name}.{seen[name.lower()]}")
    return out


def read_extract(spark: SparkSession, path: str, *, sheet: str | int = 0, header_row: int = 0, delimiter: str | None = None, encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """One file as a table: delimited text and spreadsheets all as strings, Parquet and JSON with their own types.

    ``header_row`` title lines are passed over. Empty fields are null. Records may hold line breaks inside quotes; where
    none do, ``multi_line=False`` lets a large file be split. A suffix of no known format is an error.
    """
    kind = bare_suffix(path)
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if kind in (".json", ".jsonl", ".ndjson"):
        whole = head_bytes(path).lstrip(b"\xef\xbb\xbf \r\n\t")[:1] == b"["
        return spark.read.json(path, multiLine=whole, primitivesAsString=True)
    if kind in SHEETS:
        return _read_sheet(spark, path, sheet, header_row)
    if kind not in DELIMITED:
        raise ValueError(f"{path}: {kind or 'no suffix'} is no format that is read")
    head = head_bytes(path)
    encoding = encoding or sniff_encoding(head)
    lines = head.decode(encoding, errors="replace").lstrip("﻿").splitlines()[header_row:]
    sep = delimiter or sniff_delimiter("\n".join(lines), kind)
    splittable = Path(path).suffix.lower() not in (".zip", ".xz", ".zst") and encoding.lower().replace("-", "") in ("utf8", "ascii")
    if not splittable:
        return _read_on_driver(spark, path, sep, encoding, header_row)
    header = _unique(next(csv.reader(lines[:1], delimiter=sep), []))
    schema = ", ".join(f"`{h}` string" for h in header)
    how = {"schema": schema, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "enforceSchema": True, "encoding": "UTF-8"}
    if not header_row:
        return spark.read.csv(path, header=True, **how)
    # title rows and the header go by their place: a file of records with line breaks is one partition, numbered from its start
    title = head.decode("utf-8", errors="replace").lstrip("\ufeff").splitlines()[: header_row + 1]
    skipped = sum(1 for r in title if r.strip())  # the reader passes over blank lines
    rows = spark.read.csv(path, header=False, **how | {"multiLine": True})
    return rows.withColumn("place_", F.monotonically_increasing_id()).where(F.col("place_") >= skipped).drop("place_")


def _read_on_driver(spark: SparkSession, path: str, sep: str, encoding: str, header_row: int) -> DataFrame:
    with _open(path) as f:
        data = f.read(MAX_DRIVER_BYTES + 1)
    if len(data) > MAX_DRIVER_BYTES:
        raise ValueError(f"{path}: too large to unpack or recode on the driver; convert it to gzip or bzip2 in utf-8")
    rows = list(csv.reader(io.StringIO(data.decode(encoding).lstrip("﻿")), delimiter=sep))[header_row:]
    return _text_frame(spark, rows[0] if rows else [], [[c if c != "" else None for c in r] for r in rows[1:] if r])


def _read_sheet(spark: SparkSession, path: str, sheet: str | int, header_row: int) -> DataFrame:
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl, which is not installed") from e
    if os.path.getsize(path) > MAX_DRIVER_BYTES:
        raise ValueError(f"{path}: too large a workbook for the driver; export it as delimited text")
    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    ws = book.worksheets[sheet] if isinstance(sheet, int) else book[sheet]
    rows = [[None if c is None else str(c) for c in r] for r in ws.iter_rows(values_only=True)][header_row:]
    return _text_frame(spark, [c or "" for c in rows[0]] if rows else [], rows[1:])


def read_extracts(spark: SparkSession, paths: str | list[str], **how) -> DataFrame:
    """Files of one kind of extract stacked by column name, what a file lacks null, with ``source_file``."""
    out = None
    for p in expand_paths(paths):
        one = read_extract(spark, p, **how).withColumn("source_file", F.lit(Path(p).name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A hand-filled grid: rows with an answer, typed, and ``problem`` where it contradicts itself.

    A blank ``quoted`` is a cell not collected and gives no row.
    """
    from quoteloom.functions.scalars import day_first_date, to_bool, to_float

    raw = read_extract(spark, path)
    quoted, premium = to_bool(F.col("quoted")), to_float(F.col("premium"))
    stands = F.trim(F.coalesce("quoted", F.lit(""))) != ""
    problem = F.when(quoted.isNull(), "quoted is neither yes nor no").when(quoted & premium.isNull(), "quoted without a premium").when(~quoted & premium.isNotNull(), "declined with a premium").when(day_first_date(F.col("collected_on")).isNull(), "no date")
    return raw.where(stands).select("risk_id", "brand", "channel", day_first_date(F.col("collected_on")).alias("collected_on"), quoted.alias("quoted"), premium.alias("premium"), problem.alias("problem"))


def write_table(df: DataFrame, path: str, *, by_month: str | None = None) -> None:
    """Parquet, one folder a month of a date column if wanted, so that later reads prune."""
    w = df if by_month is None else df.withColumn("month", F.date_trunc("month", by_month).cast("date"))
    (w.write.mode("overwrite") if by_month is None else w.write.mode("overwrite").partitionBy("month")).parquet(path)


def write_report(df: DataFrame, path: str, *, most_rows: int = 100_000) -> None:
    """A small result as one CSV file; more than ``most_rows`` rows is an error, not a cut."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError("too many rows for a report; write a table")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_manifest(path: str, **facts) -> None:
    Path(path).write_text(json.dumps(facts, indent=2, default=str))
