"""Queries of file metadata: files are written around the given tables by built-in functions, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.metadata import file_metadata
from ..tables import dealt, read
from .catalog import Catalog

catalog = Catalog()


def _chunk(kind: str, body: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), F.encode(F.lit(kind), "UTF-8"), body, F.unhex(F.lit("00000000")))


def _u32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


@catalog.query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'tiff' WHEN 2 THEN 'pdf' ELSE 'other' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN ['Author=' || p_brand, 'Software=' || p_name] WHEN 1 THEN ['Make=' || p_type, 'Model=' || p_name] WHEN 2 THEN ['Author=' || p_brand || ' (maker)', 'Title=' || p_name] ELSE [] END AS fields FROM part
""")
def file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.encode(c, "UTF-8")
    pair = lambda key, value: _chunk("tEXt", F.concat(text(F.lit(key)), F.unhex(F.lit("00")), text(value)))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), _chunk("IHDR", F.unhex(F.lit("00" * 13))), pair("Author", F.col("p_brand")), pair("Software", F.col("p_name")), _chunk("IDAT", F.unhex(F.lit("00"))))
    make, model = F.concat(text(F.concat("p_type", F.lit("        "))), F.unhex(F.lit("00"))), F.concat(text(F.concat("p_name", F.lit("        "))), F.unhex(F.lit("00")))
    entry = lambda tag, size, at: F.concat(F.unhex(F.lit(tag + "0002")), _u32(size), _u32(at))
    tiff = F.concat(F.unhex(F.lit("4D4D002A000000080002")), entry("010F", F.octet_length(make), F.lit(38)), entry("0110", F.octet_length(model), F.lit(38) + F.octet_length(make)), _u32(F.lit(0)), make, model)
    pdf = text(F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Title <"), F.concat(F.lit("FEFF"), F.hex(F.encode("p_name", "UTF-16BE"))), F.lit("> /Author ("), "p_brand", F.lit(" \\(maker\\)) >>\nendobj\n")))
    form = F.col("p_partkey") % 4
    content = F.when(form == 0, png).when(form == 1, tiff).when(form == 2, pdf).otherwise(text(F.col("p_name")))
    found = file_metadata(dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")).select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")))
    fields = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.trim(e["value"]))))
    return found.select("path", "kind", fields.alias("fields"))
