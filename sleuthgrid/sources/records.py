"""Records written as they come: page views, payloads by their content, snapshots of what is readable; kinds of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import recordable

# How files of a kind begin, in the order in which they are tried.
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "tiff": b"II*\x00", "zip": b"PK\x03\x04", "gzip": b"\x1f\x8b", "sqlite": b"SQLite format 3\x00"}
# Kinds by the end of the name, where the content tells nothing.
ENDINGS = {"eml": "email", "csv": "csv", "json": "json", "ndjson": "json", "md": "text", "txt": "text", "log": "text"}


def page_views(rows: DataFrame, exact: list[str], prefixes: list[str], salt: str) -> DataFrame:
    """Views that count, shortened: path (300), referrer (300), country, and a visitor's hash of 16 digits that changes with the day. rows: at, method, path, referrer, ip, user_agent."""
    day = F.date_format("at", "yyyy-MM-dd")
    visitor = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), day, F.lit("|"), F.trim(F.coalesce("ip", F.lit(""))), F.lit("|"), F.substring(F.coalesce("user_agent", F.lit("")), 1, 200)), 256), 1, 16)
    kept = rows.where(recordable(F.col("path"), F.col("method"), exact, prefixes))
    return kept.select("at", F.upper("method").alias("method"), F.substring("path", 1, 300).alias("path"), F.substring("referrer", 1, 300).alias("referrer"), visitor.alias("visitor"))


def store_payloads(rows: DataFrame, path: str) -> None:
    """Write payloads (case_id, run_id, collector, payload) in folders of case and run, each once, named by the hash of its content; null payloads are none."""
    named = rows.where("payload is not null").withColumns({"run_id": F.coalesce("run_id", F.lit("norun")), "sha256": F.sha2("payload", 256)})
    named.dropDuplicates(["case_id", "run_id", "collector", "sha256"]).write.mode("append").partitionBy("case_id", "run_id").json(path)


def append_snapshot(readings: DataFrame, path: str) -> int:
    """Append a row (lake, rows, at) for each lake that could be read; one that couldn't is left out, as unknown isn't zero. Returns how many were written."""
    readable = readings.where("rows is not null").select("lake", "rows", "at")
    n = readable.count()
    if n:
        readable.write.mode("append").parquet(path)
    return n


def file_kind(name: Column, content: Column) -> Column:
    """The kind of a file: by its first bytes, else by what its text looks like (mail headers, JSON, CSV), else by its name's end; binary or text else."""
    out = F.lit(None).cast("string")
    head = F.substring(content, 1, 4096)
    text = F.make_valid_utf8(head.cast("string"))
    mail = text.rlike(r"(?is)^(?:[A-Za-z-]+:[^\n]*\n(?:[ \t][^\n]*\n)*){2,}") & text.rlike(r"(?im)^(received|from|subject|message-id):")
    table = text.rlike(r"^[^\n,{\[]+(,[^\n,]*)+\r?\n[^\n]*,")
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))[ending]
    binary = F.instr(F.hex(head), "00") > 0
    for kind, first in reversed(MAGIC.items()):
        out = F.when(F.substring(content, 1, len(first)) == F.lit(first), F.lit(kind)).otherwise(out)
    shaped = F.when(mail, "email").when(text.rlike(r"^\s*[\[{]"), "json").when(table, "csv")
    return F.coalesce(out, F.when(~binary, shaped), named, F.when(binary, "binary").otherwise("text"))


def cell_values(rows: DataFrame, pattern: str) -> DataFrame:
    """The distinct values of all cells of a table in which the pattern is found."""
    cells = rows.select(F.explode(F.array(*(F.trim(F.col(f"`{c}`").cast("string")) for c in rows.columns))).alias("value"))
    return cells.where(F.col("value").rlike(pattern)).distinct()
