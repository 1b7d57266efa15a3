"""Sources read at scale: every body is tokenised once, where it is; symbols, imports, calls and triggers follow from that one reading."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import spread

_SCHEMA = (
    "file_id bigint, language string, doc string, symbols array<struct<kind:string,name:string,qualname:string,line_start:int,line_end:int,doc:string>>, "
    "imports array<struct<module:string,line:int>>, calls array<struct<name:string,line:int>>, triggers array<struct<kind:string,trigger:string,by:string,line:int>>"
)


def _arrow() -> pa.Schema:
    text, n = pa.string(), pa.int32()
    many = lambda **f: pa.list_(pa.struct([pa.field(k, t) for k, t in f.items()]))
    return pa.schema({
        "file_id": pa.int64(), "language": text, "doc": text, "symbols": many(kind=text, name=text, qualname=text, line_start=n, line_end=n, doc=text),
        "imports": many(module=text, line=n), "calls": many(name=text, line=n), "triggers": many(kind=text, trigger=text, by=text, line=n),
    })


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from lodespark.sources.outline import outline

    schema = _arrow()
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            rows = []
            for r in whole.slice(at, 200).to_pylist():
                try:
                    o = outline(r["language"], r["body"])
                except RecursionError:  # nested beyond any sense; such a file declares nothing
                    o = outline(None, None)
                rows.append({
                    "file_id": r["file_id"], "language": r["language"], "doc": o.doc, "symbols": [vars(x) for x in o.symbols],
                    "imports": [{"module": m, "line": i} for m, i in o.imports], "calls": [{"name": m, "line": i} for m, i in o.calls],
                    "triggers": [{"kind": k, "trigger": t, "by": b, "line": i} for k, t, b, i in o.triggers],
                })
            yield pa.RecordBatch.from_pylist(rows, schema)


def read(files: DataFrame) -> DataFrame:
    """file_id, language, doc, symbols, imports, calls, triggers of every file. ``files``: file_id, language, body.

    Deliveries of the same file and body count once. Null and empty bodies and unknown languages give empty lists; null ids are dropped.
    """
    from lodespark.operators.lexical import once

    known = files.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), "language", F.coalesce("body", F.lit("")).alias("body"))
    rows = once(known.select(F.struct("file_id", "language").alias("k"), "body"), "k", "body").select("k.file_id", "k.language", "body")
    return spread(rows, "file_id").mapInArrow(_read, _SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    """file_id, kind, name, qualname, line_start, line_end, doc, one row a declaration."""
    return parsed.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*").distinct()


def imports(parsed: DataFrame) -> DataFrame:
    """file_id, line, module."""
    return parsed.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.line", "i.module").distinct()


def calls(parsed: DataFrame) -> DataFrame:
    """file_id, line, name, n: calls of a name on a line."""
    return parsed.select("file_id", F.explode("calls").alias("c")).groupBy("file_id", "c.line", "c.name").agg(F.count(F.lit(1)).alias("n"))


def triggers(parsed: DataFrame) -> DataFrame:
    """file_id, kind (route, cli, env, decorator), trigger, by, line: what binds a name from outside to code."""
    return parsed.select("file_id", F.explode("triggers").alias("t")).select("file_id", "t.*").distinct()
