"""Table functions for SQL: ``chunk_document`` over a table argument and ``flatten_changes`` for LATERAL calls."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidewater.operators.documents import chunk_rows

BLOCK = ("block_no", "md", "level", "is_table", "path")
MODES = ("none", "heading", "fixed")
_TEXT = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


@udtf
class ChunkDocument:
    """Chunks of documents from a table of blocks: ``select * from chunk_document(table(blocks), 'heading', 800, 0)``.

    The table has the columns of ``pathed_blocks`` (block_no, md, level, is_table, path); all others are the
    document's key and come back with chunk_no, md and path. The function asks for its rows by document, in order.
    """

    @staticmethod
    def analyze(blocks: AnalyzeArgument, mode: AnalyzeArgument = None, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        if not blocks.isTable or not set(BLOCK) <= set(blocks.dataType.names):
            raise ValueError(f"chunk_document needs a table with the columns {', '.join(BLOCK)}")
        if mode is not None and mode.value not in MODES:
            raise ValueError(f"unknown mode {mode.value}")
        keys = [f for f in blocks.dataType.fields if f.name not in BLOCK]
        made = [T.StructField("chunk_no", T.IntegerType()), T.StructField("md", T.StringType()), T.StructField("path", T.StringType())]
        return AnalyzeResult(schema=T.StructType([*keys, *made]), partitionBy=[PartitioningColumn(f.name) for f in keys], orderBy=[OrderingColumn("block_no")])

    def __init__(self):
        self.key, self.blocks, self.options = (), [], ("fixed", 800, 0)

    def eval(self, row: Row, mode: str = "fixed", size: int = 800, overlap: int = 0) -> None:
        self.key = tuple(row[n] for n in row.__fields__ if n not in BLOCK)
        self.options = (mode, size, overlap)
        self.blocks.append((row["md"], int(row["level"] or 0), bool(row["is_table"]), row["path"]))

    def terminate(self) -> Iterator[tuple]:
        for i, (md, path) in enumerate(chunk_rows(self.blocks, *self.options)):
            yield (*self.key, i + 1, md, path)


@udtf(returnType="field string, before string, after string, total int")
class FlattenChanges:
    """What differs between two JSON texts, a row a field: ``from changes, lateral flatten_changes(before, after, 20)``.

    The rules are those of ``variants.nested_changes``: objects on both sides field by field, four levels deep, absent
    equal to null, ``total`` counting also what ``most`` leaves out. A malformed or null text is null.
    """

    def eval(self, before: str, after: str, most: int = 20) -> Iterator[tuple]:
        shown = lambda v: v if v is None or isinstance(v, str) else _TEXT(v)
        same = lambda a, b: a == b if type(a) is type(b) and type(a) in (str, int) else _TEXT(a) == _TEXT(b)

        def read(value: str | None) -> object:
            try:
                return None if value is None else json.loads(value)
            except ValueError:
                return None

        def walk(a: object, b: object, path: str, left: int) -> Iterator[tuple]:
            if left and isinstance(a, dict) and isinstance(b, dict):
                for k in sorted(a.keys() | b.keys(), key=lambda x: x.encode()):
                    yield from walk(a.get(k), b.get(k), f"{path}.{k}" if path else k, left - 1)
            elif not same(a, b):
                yield path or "(item)", shown(a), shown(b)

        found = list(walk(read(before), read(after), "", 4))
        for field in found[:most]:
            yield (*field, len(found))


def register(spark: SparkSession) -> None:
    """Makes both known to SQL of the session."""
    spark.udtf.register("chunk_document", ChunkDocument)
    spark.udtf.register("flatten_changes", FlattenChanges)
