"""Lines of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a body that stand in one row while code is cut out.
LINES = 256


def code_of(spans: DataFrame, files: DataFrame) -> DataFrame:
    """id, code: lines ``line_start`` to ``line_end`` of a file. ``spans``: id, file_id, line_start, line_end; ``files``: file_id, body (one row a file).

    Either line end counts; spans are clipped to the file, and those that are null, reversed or behind its end have no row. Each body is
    split once, into rows of LINES lines; a span meets only the rows that it covers, and only its
    own lines are moved. A file with most of the spans is spread by its rows.
    """
    lines = F.split("body", r"\r?\n")
    last = F.floor((F.size("lines") - 1) / LINES).cast("int")
    rows = files.where(F.col("body").isNotNull()).select("file_id", lines.alias("lines")).select("file_id", "lines", F.explode(F.sequence(F.lit(0), last)).alias("row"))
    rows = rows.select("file_id", "row", F.slice("lines", F.col("row") * LINES + 1, F.lit(LINES)).alias("part"))
    first, end = F.greatest(F.col("line_start"), F.lit(1)) - 1, F.col("line_end") - 1
    want = spans.where(F.col("line_start").isNotNull() & (F.col("line_end") >= F.greatest(F.col("line_start"), F.lit(1)))).select("id", "file_id", first.alias("first"), end.alias("end"))
    want = want.join(files.select("file_id", (F.length("body") + 1).alias("most")), "file_id").withColumn("end", F.least("end", "most"))  # no file has more lines than characters
    want = want.where(F.col("end") >= F.col("first")).withColumn("row", F.explode(F.sequence(F.floor(F.col("first") / LINES).cast("int"), F.floor(F.col("end") / LINES).cast("int"))))
    begin = F.greatest(F.lit(0), F.col("first") - F.col("row") * LINES)
    stop = F.least(F.lit(LINES - 1), F.col("end") - F.col("row") * LINES)
    text = F.array_join(F.slice("part", begin.cast("int") + 1, F.greatest(F.lit(0), stop - begin + 1).cast("int")), "\n")
    met = want.join(rows, ["file_id", "row"]).select("id", "row", text.alias("text"), F.size("part").alias("n"), begin.alias("begin")).where(F.col("begin") < F.col("n"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n")
    return met.groupBy("id").agg(code.alias("code"))
