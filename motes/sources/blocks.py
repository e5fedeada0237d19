"""Block-structured table files: named blocks that hold a loop (a table) or key/value pairs.

``BlockFiles`` indexes the files once; each block is then read from its own bytes alone. The index is
a few numbers per byte range and block, as many as Spark's own list of file splits, and the only
thing that reaches the driver.
"""

from __future__ import annotations

import json
import re
import weakref
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.functions.cells import cell_text, typed
from motes.sources.block_files import FORMAT, Block, BlockSource, Section, blocks_of

_registered: weakref.WeakSet = weakref.WeakSet()


def _source(spark: SparkSession) -> None:
    if spark not in _registered:
        spark.dataSource.register(BlockSource)
        _registered.add(spark)


def _bytes(size: str) -> int:
    """A size such as ``128m`` or ``134217728b``."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


class BlockFiles:
    """The blocks of all matching files; one pass over the text finds where they lie."""

    def __init__(self, spark: SparkSession, path: str | Sequence[str]):
        _source(spark)
        self.spark = spark
        paths = [path] if isinstance(path, str) else list(path)
        self.path = path
        found = self._read("index", paths=json.dumps(paths)).collect()
        ranges = [(r["file"], [Section(*s) for s in json.loads(r["sections"])]) for r in sorted(found, key=lambda r: (r["number"], r["start"]))]
        self.blocks = blocks_of(ranges)

    def _read(self, kind: str, **options: str) -> DataFrame:
        most = _bytes(self.spark.conf.get("spark.sql.files.maxPartitionBytes"))
        slots = self.spark.sparkContext.defaultParallelism
        return self.spark.read.format(FORMAT).options(kind=kind, most=most, slots=slots, **options).load()

    def _named(self, block: str | None, loop: bool) -> Iterator[Block]:
        return (b for b in self.blocks if b.loop == loop and block in (None, b.name))

    def catalog(self) -> DataFrame:
        """One row per block: kind, columns, rows (or pairs), and the file's layout version.

        Version 3.1 files keep an ``optics`` block next to the particles, 3.0 files a single
        loop.
        """
        fields = "file string, block_no int, block string, kind string, n_cols int, n_rows bigint, labels array<string>"
        rows = [(b.file, b.number, b.name, "loop" if b.loop else "pairs", len(b.labels), b.rows, list(b.labels)) for b in self.blocks]
        out = self.spark.createDataFrame(rows, fields)
        per_file = out.groupBy("file").agg(
            F.count(F.lit(1)).alias("_blocks"), F.count_if(F.col("kind") == "loop").alias("_loops"), F.max(F.col("block") == "optics").alias("_optics")
        )
        version = F.when(F.col("_optics"), F.lit("3.1")).when((F.col("_loops") == 1) & (F.col("_blocks") == 1), F.lit("3.0")).otherwise(F.lit("other"))
        return out.join(per_file.select("file", version.alias("version")), "file")

    def loop(self, block: str = "particles", columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
        """Rows of a loop block in all files, with ``_row`` and ``_file``; see ``read_loop``."""
        wanted = list(self._named(block, True))
        if columns is None:
            at: dict[str, int] = {}
            for b in wanted:
                for i, label in enumerate(b.labels):
                    at[label] = min(i, at.get(label, i))
            columns = sorted(at, key=lambda c: (at[c], c))
            if not columns:
                raise ValueError(f"no loop block {block} in {self.path}")
        plan, row = [], 0
        for b in wanted:
            places = [b.labels.index(c) if c in b.labels else -1 for c in columns]
            for start, end, n in b.spans:
                if n:
                    plan.append((b.file, start, end, row, places))
                row += n
        df = self._read("rows", plan=json.dumps(plan), columns=json.dumps(list(columns)))
        as_asked = [typed(F.col(f"`{c}`"), types[c]).alias(c) if types and c in types else F.col(f"`{c}`") for c in columns]
        return df.select("_file", "_row", *as_asked)

    def pairs(self, block: str | None = None) -> DataFrame:
        """Key/value blocks as ``(file, block, key, value)``; the last value of a key wins."""
        plan = [(b.file, start, end, b.name) for b in self._named(block, False) for start, end, n in b.spans if n]
        return self._read("pairs", plan=json.dumps(plan)).groupBy("file", "block", "key").agg(F.max_by("value", "at").alias("value"))


def block_catalog(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per block of all matching files; see ``BlockFiles.catalog``."""
    return BlockFiles(spark, path).catalog()


def read_loop(
    spark: SparkSession,
    path: str | Sequence[str],
    block: str = "particles",
    columns: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of a loop block in all matching files, with ``_row`` and ``_file``.

    ``_row`` counts through all files in the order of their names, so a table written in
    parts comes back in its order, and no number is used twice.

    Columns are found by label, so files may order them differently; a column that a file
    lacks is NULL. Cells are text unless ``types`` names a type; ``?`` and unreadable cells
    become NULL there. Only the listed columns are cut out.
    """
    return BlockFiles(spark, path).loop(block, columns, types)


def read_pairs(spark: SparkSession, path: str | Sequence[str], block: str | None = None) -> DataFrame:
    """Key/value blocks as ``(file, block, key, value)``; the last value of a key wins."""
    return BlockFiles(spark, path).pairs(block)


def write_loop(df: DataFrame, path: str, block: str = "particles", columns: Sequence[str] | None = None, order: str = "_row", missing: str = "?") -> None:
    """Write a loop block as text in row order, every part file a complete table.

    Rows are range-partitioned by ``order``. A task that fails removes its file; the parts appear when
    all are complete, together with a manifest that keeps their order. An empty table is one header.
    """
    names = [c for c in (columns or df.columns) if c != order and not c == "_file"]
    unlabelled = [c for c in names if not c.startswith("_")]
    if unlabelled:
        raise ValueError(f"labels start with an underscore, unlike {unlabelled}")
    kinds = {f.name: f.dataType for f in df.schema}
    line = F.concat_ws("  ", *[cell_text(F.col(c), kinds[c], missing) for c in names])
    header = "\n".join([f"data_{block}", "", "loop_", *[f"{c} #{i}" for i, c in enumerate(names, 1)], ""])
    _source(df.sparkSession)
    ordered = df.repartitionByRange(order).sortWithinPartitions(order).select(line.alias("line"))
    ordered.write.format(FORMAT).option("header", header).mode("append").save(path)
