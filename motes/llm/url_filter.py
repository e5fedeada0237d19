"""URL filter: a sorted array of 64-bit digests, memory-mapped by every Python worker.

A rule is a host and the beginning of a path. The index file holds the sorted xxhash
digests of ``host + path`` of all rules, their offsets, and the strings themselves. For a
batch of URLs all pairs of a host suffix and a path beginning, of those lengths that rules
have, and no longer than a rule's, are digested and probed with one vectorised binary search; a hit counts only if
the stored string is equal, so collisions can't mislead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.session import shared_folder

# Rules per index file; more rules make more files, each probed in turn.
RULES_PER_FILE = 5_000_000

_HEAD = 3  # uint64 words: number of rules, number of path lengths, length of the longest host


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """The index file: head, path lengths, digests, string offsets, verdicts, strings.

    Of rules with equal host and path, ``block`` stays.
    """
    best: dict[bytes, int] = {}
    lengths, widest = set(), 0
    for host, path, verdict in rules:
        if host:
            name = (host + path).encode()
            best[name] = max(best.get(name, 0), int(verdict == "block"))
            lengths.add(len(path))
            widest = max(widest, len(host))
    rows = sorted((xxhash.xxh64_intdigest(name), name, block) for name, block in best.items())
    ends = np.cumsum([0, *[len(name) for _, name, _ in rows]]).astype("<u8")
    parts = [
        np.array([len(rows), len(lengths), widest], "<u8"),
        np.array(sorted(lengths), "<u8"),
        np.array([digest for digest, _, _ in rows], "<u8"),
        ends,
        np.array([block for _, _, block in rows], "u1"),
    ]
    return b"".join(p.tobytes() for p in parts) + b"".join(name for _, name, _ in rows)


class Index:
    """A mapped index file; only the pages that probes touch are read."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        n, m, self.widest = (int(x) for x in raw[: 8 * _HEAD].view("<u8"))
        at = 8 * _HEAD
        self.lengths = [int(x) for x in raw[at : at + 8 * m].view("<u8")]
        at += 8 * m
        self.digests = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.blocks = raw[at : at + n]
        self.names = raw[at + n :]

    def longest(self, hosts, paths) -> list[tuple[str, str] | None]:
        """The longest fitting rule and its verdict of each URL."""
        probes: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        owners: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            # no rule fits a suffix that is longer than every rule's host
            suffix = host
            if len(host) > self.widest:
                dot = host.find(".", len(host) - self.widest - 1)
                suffix = host[dot + 1 :] if dot >= 0 else ""
            while suffix:
                for length in self.lengths:
                    if length <= len(path):
                        probes.append((suffix + path[:length]).encode())
                        sizes.append((len(suffix) + length, len(suffix)))
                        owners.append(i)
                suffix = suffix.partition(".")[2]
        found: list[tuple[str, str] | None] = [None] * len(hosts)
        if not probes or not len(self.digests):
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), "<u8", len(probes))
        first = np.searchsorted(self.digests, digests, "left")
        hit = first < len(self.digests)
        hit[hit] = self.digests[first[hit]] == digests[hit]
        best: dict[int, tuple[int, int]] = {}
        for j in np.flatnonzero(hit):
            at = int(first[j])
            while at < len(self.digests) and self.digests[at] == digests[j]:
                if self.names[int(self.ends[at]) : int(self.ends[at + 1])].tobytes() == probes[j]:
                    if sizes[j] > best.get(owners[j], (-1, -1)):
                        best[owners[j]] = sizes[j]
                        found[owners[j]] = (probes[j].decode(), "block" if self.blocks[at] else "allow")
                    break
                at += 1
        return found


_OPEN: dict[str, Index] = {}


def _opened(name: str) -> Index:
    if name not in _OPEN:
        _OPEN[name] = Index(SparkFiles.get(name))
    return _OPEN[name]


def _prober(name: str):
    @F.pandas_udf("rule string, verdict string")
    def probe(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = _opened(name).longest(host.tolist(), path.tolist())
        return pd.DataFrame({"rule": [f and f[0] for f in found], "verdict": [f and f[1] for f in found]}, dtype=object)

    return probe


def _ship(spark, data: bytes) -> str:
    """Put an index file into the shared folder and hand it to all executors, now and later."""
    name = f"motes-urls-{hashlib.sha256(data).hexdigest()[:32]}.idx"
    path = f"{shared_folder(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
        out = files.create(part, True)
        out.write(bytearray(data))
        out.close()
        files.rename(part, target)
    spark.sparkContext.addFile(files.makeQualified(target).toString())
    return name


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", per_file: int = RULES_PER_FILE) -> DataFrame:
    """``row`` with host, path, the longest fitting ``rule`` and the ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). Without a rule a
    page is allowed, unless it has no host (null, empty or malformed URL): then blocked.
    Repeated rows are judged alike; no page is moved, so a host with a third of all pages
    is no burden. Of a host only the suffixes no longer than the longest host of a rule are looked up, so a very long one
    costs no more. An empty table gives an empty one; the caller's columns are inside ``row`` and may have any names.
    Rules are collected file by file, at most ``per_file`` of them at once.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict").na.drop().distinct()
    files = max(1, -(-rules.count() // per_file))
    named = pages.select(F.struct("*").alias("row")).select(
        "row", host_of(F.col(f"row.{url}")).alias("host"), path_of(F.col(f"row.{url}")).alias("path")
    )
    hits = []
    for i in range(files):
        part = rules.filter(F.pmod(F.xxhash64("host", "path"), F.lit(files)) == i).collect()
        hits.append(_prober(_ship(spark, pack([tuple(r) for r in part])))("host", "path"))
    probed = named.withColumn("hits", F.array(*hits))
    best = F.array_max(
        F.transform("hits", lambda h: F.struct(F.length(h["rule"]).alias("n"), F.position(F.lit("/"), h["rule"]).alias("at"), h["rule"].alias("rule"), h["verdict"].alias("verdict")))
    )
    own = F.when(F.col("host") == "", "block").otherwise("allow")
    return (
        probed.withColumn("best", best)
        .select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"))
    )
