"""Block-structured text files as a Python data source.

A file is read in byte ranges; a line belongs to the range in which it begins. ``kind=index`` scans
each range once and gives, for each ``data_`` and ``loop_`` line in it, where its content lies and
how many lines it has. From these few rows a range ``plan`` says which bytes hold a block and which
number its first row has, so ``kind=rows`` and ``kind=pairs`` open only those bytes, cut out
only the asked columns, and number rows without a shuffle.

Writing makes every part a complete file in a hidden folder; the commit moves the parts and names them
in a manifest, in the order of their rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "motes_blocks"
MANIFEST = "_manifest.json"
# Bytes of text that a task holds at once; as lines, cells and batches they take many times as much.
CHUNK = 1 << 20
# As for Spark's own files: a range is no smaller than this unless the caller's bound is.
SMALLEST = 4 << 20

_BLANK = rb"[ \t\x0b\x0c]*"
_MARKER = re.compile(rb"(?m)^" + _BLANK + rb"(?:(data_[^\n]*)|loop_" + _BLANK + rb"$)")
_LINE = re.compile(rb"(?m)^" + _BLANK + rb"[^\s#]")
_KEY = re.compile(rb"(?m)^" + _BLANK + rb"_")


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _glob(pattern: str) -> re.Pattern:
    """A path pattern: ``*``, ``?`` and ``[]`` within a name, and ``{a,b}``."""
    out = ""
    for token in re.findall(r"\[[^\]]*\]|\{[^}]*\}|.", pattern):
        if token in ("*", "?"):
            out += "[^/]*" if token == "*" else "[^/]"
        elif token[0] == "[" and len(token) > 1:
            out += token.replace("[!", "[^", 1)
        elif token[0] == "{" and len(token) > 1:
            out += "(?:" + "|".join(_glob(t).pattern for t in token[1:-1].split(",")) + ")"
        else:
            out += re.escape(token)
    return re.compile(out)


def list_paths(paths: Sequence[str]) -> list[tuple[str, int]]:
    """Files below the paths with their sizes, hidden ones left out, in the order of their names.

    Of a folder with a manifest, the files that it names, in its order.
    """
    found: dict[str, tuple] = {}
    for path in paths:
        system, inner = open_path(path)
        prefix = path[: path.index("://") + 3] if "://" in path else "file://"
        inner = inner.rstrip("/") or "/"
        parts = inner.split("/")
        fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[{")), len(parts))
        base = "/".join(parts[:fixed]) or "/"
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        entries = [info] if info.is_file else [e for e in system.get_file_info(fs.FileSelector(base, recursive=True)) if e.is_file]
        match = _glob("/".join(parts[fixed:]))
        manifests: dict[str, list[str]] = {}
        for e in entries:
            if e.base_name == MANIFEST:
                with system.open_input_stream(e.path) as f:
                    manifests[e.path.rsplit("/", 1)[0]] = json.loads(f.read())["parts"]
        for e in entries:
            below = e.path[len(base) :].strip("/").split("/") if e.path != base else []
            if any(_hidden(p) for p in below[len(parts) - fixed :]):
                continue
            if fixed < len(parts) and not match.fullmatch("/".join(below[: len(parts) - fixed])):
                continue
            folder, _, name = e.path.rpartition("/")
            named = manifests.get(folder)
            if not _hidden(name) and (named is None or name in named):
                shown = prefix + e.path if prefix == "file://" or not e.path.startswith("/") else prefix.rstrip("/") + e.path
                found[shown] = (folder, named.index(name) if named else 0, name, e.size)
    return [(path, key[3]) for path, key in sorted(found.items(), key=lambda x: x[1][:3])]


def whole_lines(path: str, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in [start, end), a few megabytes at a time, each with its place in the file."""
    system, inner = open_path(path)
    with system.open_input_file(inner) as f:
        at = start
        if start:
            # what byte start - 1 belongs to began in the range before
            f.seek(start - 1)
            at = start - 1
            while True:
                data = f.read(1 << 16).replace(b"\r", b"\n")
                if not data:
                    return
                cut = data.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(data)
        if at >= end:
            return
        f.seek(at)
        held = b""
        while True:
            data = f.read(chunk).replace(b"\r", b"\n")
            held += data
            if not data:
                if held:
                    yield at, held
                return
            if at + len(held) >= end:
                cut = held.find(b"\n", max(0, end - 1 - at))
                if cut >= 0:
                    yield at, held[: cut + 1]
                    return
            else:
                cut = held.rfind(b"\n") + 1
                if cut:
                    yield at, held[:cut]
                    at, held = at + cut, held[cut:]


@dataclass
class Section:
    """What follows a marker within one range: leading ``_`` lines, then the rest.

    ``kind`` is ``data`` or ``loop``, or ``cont`` for what goes on from the range before.
    """

    kind: str
    at: int
    name: str = ""
    body: int = 0  # where the content begins
    end: int = 0
    lead: int = 0  # leading lines that begin with an underscore
    rest: int = -1  # where the first other line begins
    lines: int = 0  # from there on
    keys: int = 0  # of these, the ones that begin with an underscore
    labels: tuple[str, ...] = ()  # of a loop: first words of the leading lines


def scan(path: str, start: int, end: int, chunk: int = CHUNK) -> list[Section]:
    """The sections of a range; sizes and places only, apart from the labels of loops."""
    sections = [Section("cont", start, body=start)]

    def add(at: int, data: bytes) -> None:
        section = sections[-1]
        where = 0
        while section.rest < 0 and where < len(data):
            stop = data.find(b"\n", where)
            stop = len(data) if stop < 0 else stop
            line = data[where:stop].strip()
            if line[:1] == b"_":
                section.lead += 1
                if section.kind == "loop":
                    section.labels += (line.split()[0].decode("utf-8", "replace"),)
            elif line and line[:1] != b"#":
                section.rest = at + where
                break
            where = stop + 1
        if section.rest >= 0:
            rest = data[where:]
            section.lines += sum(1 for _ in _LINE.finditer(rest))
            section.keys += sum(1 for _ in _KEY.finditer(rest))

    for at, data in whole_lines(path, start, end, chunk):
        done = 0
        for m in _MARKER.finditer(data):
            add(at + done, data[done : m.start()])
            sections[-1].end = at + m.start()
            done = min(m.end() + 1, len(data))
            name = b" ".join(m.group(1)[5:].split()).decode("utf-8", "replace") if m.group(1) else ""
            sections.append(Section("data" if m.group(1) else "loop", at + m.start(), name, at + done))
        add(at + done, data[done:])
    sections[-1].end = end
    return sections


@dataclass
class Block:
    """One block of a file; ``spans`` are the bytes of its rows (or pairs) with the number of rows."""

    file: str
    number: int
    name: str
    loop: bool = False
    labels: tuple[str, ...] = ()
    spans: list[tuple[int, int, int]] = None
    header: bool = False  # still among the labels

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.spans)


def _labels(path: str, start: int, end: int) -> tuple[str, ...]:
    """Labels that go on behind the edge of a range."""
    lines = [line.strip() for _, data in whole_lines(path, start, end) for line in data.split(b"\n")]
    return tuple(line.split()[0].decode("utf-8", "replace") for line in lines if line[:1] == b"_")


def blocks_of(ranges: Sequence[tuple[str, list[Section]]]) -> list[Block]:
    """The blocks of all files from the sections of their ranges, both in order.

    Of several loops in a block the last counts. Its rows begin with the first line that has no
    underscore; from there to the block's end each line is a row. Lines before the first block are ignored.
    """
    blocks: list[Block] = []
    file = None
    for path, sections in ranges:
        if path != file:
            file, number, block = path, 0, None
        for s in sections:
            if s.kind == "data":
                number += 1
                block = Block(path, number, s.name, spans=[(s.body, s.end, s.lead + s.keys)])
                blocks.append(block)
            elif block is None:
                continue
            elif s.kind == "loop":
                block.loop, block.labels, block.header, block.spans = True, s.labels, True, []
            elif block.loop and block.header and s.lead:
                block.labels += _labels(path, s.body, s.rest if s.rest >= 0 else s.end)
            if s.kind == "data":
                continue
            if not block.loop:
                block.spans.append((s.body, s.end, s.lead + s.keys))
            elif not block.header:
                block.spans.append((s.body, s.end, s.lead + s.lines))
            elif s.rest >= 0:
                block.header = False
                block.spans.append((s.rest, s.end, s.lines))
    return blocks


def _cells(lines: list[bytes], places: Sequence[int]) -> list[pa.Array]:
    """The cells at the given places (from 0; below 0 is a missing column), null where a line is shorter."""
    if not lines:
        return [pa.nulls(0, pa.string()) for _ in places]
    try:
        text = pa.array(lines, pa.string())
    except (pa.ArrowInvalid, UnicodeDecodeError):
        text = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    begin, end = cut.offsets.to_numpy()[:-1], cut.offsets.to_numpy()[1:]
    out = []
    for place in places:
        at = begin + max(place, 0)
        out.append(cut.values.take(pa.array(at, mask=(at >= end) | (place < 0))))
    return out


class Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.kind = options.get("kind", "index")

    def partitions(self) -> list[InputPartition]:
        slots, most = int(self.options.get("slots", 8)), int(self.options.get("most", 128 << 20))
        if self.kind == "index":
            files = list_paths(json.loads(self.options["paths"]))
            total = sum(size for _, size in files)
            size = min(most, max(SMALLEST, -(-total // slots)))
            work = [(path, a, min(a + size, length), i) for i, (path, length) in enumerate(files) for a in range(0, length, size)]
        else:
            work = json.loads(self.options["plan"])
            total = sum(w[2] - w[1] for w in work)
            size = min(most, max(SMALLEST, -(-total // slots)))
        # small ranges share a task
        shares, filled = [[]], 0
        for w in work:
            if shares[-1] and filled + w[2] - w[1] > size:
                shares.append([])
                filled = 0
            shares[-1].append(w)
            filled += w[2] - w[1]
        return [InputPartition(s) for s in shares]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for w in partition.value:
            yield from getattr(self, self.kind)(*w)

    def index(self, path: str, start: int, end: int, number: int) -> Iterator[pa.RecordBatch]:
        sections = json.dumps([list(vars(s).values()) for s in scan(path, start, end)])
        yield pa.RecordBatch.from_pydict({"file": [path], "number": pa.array([number], pa.int64()), "start": pa.array([start], pa.int64()), "sections": [sections]})

    def rows(self, path: str, start: int, end: int, row: int, places: list[int]) -> Iterator[pa.RecordBatch]:
        names = json.loads(self.options["columns"])
        for _, data in whole_lines(path, start, end):
            lines = [line for line in data.split(b"\n") if (s := line.lstrip()) and s[0] != 35]
            columns = [pa.array([path] * len(lines), pa.string()), pa.array(np.arange(row, row + len(lines))), *_cells(lines, places)]
            row += len(lines)
            yield pa.RecordBatch.from_arrays(columns, names=["_file", "_row", *names])

    def pairs(self, path: str, start: int, end: int, block: str) -> Iterator[pa.RecordBatch]:
        for at, data in whole_lines(path, start, end):
            lines = [line.split() for line in data.decode("utf-8", "replace").split("\n")]
            keyed = [(i, w) for i, w in enumerate(lines) if w and w[0].startswith("_")]
            n = len(keyed)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([path] * n, pa.string()),
                    "block": pa.array([block] * n, pa.string()),
                    "key": pa.array([w[0] for _, w in keyed], pa.string()),
                    "value": pa.array([" ".join(w[1:]) for _, w in keyed], pa.string()),
                    "at": pa.array([at + i for i, _ in keyed], pa.int64()),
                }
            )


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None
    rows: int


class Writer(DataSourceArrowWriter):
    """Parts go to a hidden folder; the commit moves them and writes the manifest."""

    def __init__(self, options):
        self.path, self.header, self.job = options["path"], options["header"], uuid.uuid4().hex
        system, folder = open_path(self.path)
        self.folder, self.hidden = folder, f"{folder}/_temporary-{self.job}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        system, _ = open_path(self.path)
        name = f"{self.hidden}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        rows, out = 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(self.hidden, recursive=True)
                    out = system.open_output_stream(name)
                    out.write(self.header.encode())
                out.write(("\n".join(batch.column(0).to_pylist()) + "\n").encode())
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(name)
            raise
        if out is not None:
            out.close()
        return Written(context.partitionId(), name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = open_path(self.path)
        written = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)
        system.create_dir(self.folder, recursive=True)
        parts = [f"part-{i:06d}.star" for i in range(max(1, len(written)))]
        for m, part in zip(written, parts, strict=False):
            system.move(m.name, f"{self.folder}/{part}")
        if not written:
            with system.open_output_stream(f"{self.folder}/{parts[0]}") as f:
                f.write(self.header.encode())
        with system.open_output_stream(f"{self.folder}/{MANIFEST}") as f:
            f.write(json.dumps({"parts": parts, "rows": [m.rows for m in written] or [0]}).encode())
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(open_path(self.path)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        """Attempts that failed with their executor may have left files there."""
        if system.get_file_info(self.hidden).type != fs.FileType.NotFound:
            system.delete_dir(self.hidden)


class BlockSource(DataSource):
    """``kind``: ``index`` (of ``paths``, a JSON list), ``rows`` or ``pairs`` (of ``plan``, JSON spans)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = self.options.get("kind", "index")
        if kind == "rows":
            return ", ".join(["_file string, _row bigint", *[f"`{c}` string" for c in json.loads(self.options["columns"])]])
        if kind == "pairs":
            return "file string, block string, key string, value string, at bigint"
        return "file string, number bigint, start bigint, sections string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)
