"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

The rule list, which the driver holds while it compiles it, is compiled once into two files: the sorted XXH64 keys of the rules (`host` + `path`) and the
rules' full strings in the same order. SparkContext.addFile ships both to every executor (a replacement executor
fetches them again), where the key file is memory-mapped. A url yields its candidate keys: each suffix of its host
at a label boundary, joined with each prefix of its path that has the length of some rule's path. All candidates of
a batch are probed by one vectorised binary search; each hit is confirmed against the stored full string, and equal
keys of different rules lie side by side, so a collision costs a comparison, never a wrong verdict.

Defined results: null url, or one without `://`: host and path empty, no rule. Rows repeat as they come; an empty
table gives an empty result; columns beyond page_id and url are ignored. A rule's host fits itself and subdomains; the longest
rule wins, and of two as long the one with the longer host (rules `x.net` + `` and `net` + `/a` both fit x.net/a). Where no rule fits, the list is
silent and the verdict is `allow`.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import slices

def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as columns; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


_SHIPPED: set[tuple[str, str]] = set()


def compile_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the digest array of (verdict, host, path) rules and ship it; returns its name on the executors, made from its contents."""
    rows = sorted((xxhash.xxh64_intdigest(host + path), host + path, len(host), verdict) for verdict, host, path in rules)
    name = f"url_rules_{xxhash.xxh64_hexdigest(repr(rows))}"
    if (spark.sparkContext.applicationId, name) in _SHIPPED:
        return name
    folder = tempfile.mkdtemp(prefix="urlrules")  # on the driver only; addFile copies from here
    np.array([r[0] for r in rows], dtype=np.uint64).tofile(keys := os.path.join(folder, f"{name}.keys"))
    strings = pa.table({"rule": pa.array([r[1] for r in rows], pa.string()), "host_len": pa.array([r[2] for r in rows], pa.int32()), "verdict": pa.array([r[3] for r in rows], pa.string())})
    with pa.OSFile(full := os.path.join(folder, f"{name}.arrow"), "wb") as sink, pa.ipc.new_file(sink, strings.schema) as writer:
        writer.write_table(strings)
    for path in (keys, full):
        spark.sparkContext.addFile(path)
    _SHIPPED.add((spark.sparkContext.applicationId, name))
    return name


class DigestArray:
    """The shipped files, memory-mapped."""

    def __init__(self, keys: str, full: str):
        self.keys = np.memmap(keys, dtype=np.uint64, mode="r") if os.path.getsize(keys) else np.empty(0, np.uint64)
        strings = pa.ipc.open_file(pa.memory_map(full)).read_all()
        self.rule, self.verdict = strings["rule"].combine_chunks(), strings["verdict"].combine_chunks()
        host_len = strings["host_len"].to_numpy()
        lengths = np.asarray(pa.compute.utf8_length(self.rule).to_numpy(zero_copy_only=False)) if len(self.keys) else np.empty(0, int)
        self.longest_host = int(host_len.max()) if len(host_len) else -1
        self.path_lengths = sorted({int(x) for x in lengths - host_len}, reverse=True)

    def within(self, host: str) -> str:
        """The longest suffix of host, at a label boundary, that a rule's host can fill: what is longer fits none, so a host's length doesn't count."""
        return host if len(host) <= self.longest_host else host[-self.longest_host - 1 :].partition(".")[2]

    def match(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The index of the longest fitting rule of each url, or -1."""
        best, length = np.full(len(hosts), -1, np.int64), [(-1, -1)] * len(hosts)
        candidate: dict[tuple[str, str], int] = {}
        owner, which = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            host = self.within(host)
            while host:
                for n in self.path_lengths:
                    if n <= len(path):
                        owner.append(i)
                        which.append(candidate.setdefault((host, path[:n]), len(candidate)))
                host = host.partition(".")[2]
        if not candidate or not len(self.keys):
            return best
        wanted = [host + path for host, path in candidate]
        digests = np.fromiter((xxhash.xxh64_intdigest(x) for x in wanted), np.uint64, len(wanted))
        at, found = np.searchsorted(self.keys, digests), np.full(len(wanted), -1, np.int64)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            j = int(at[k])
            while j < len(self.keys) and self.keys[j] == digests[k]:  # equal digests lie side by side
                if self.rule[j].as_py() == wanted[k]:
                    found[k] = j
                    break
                j += 1
        lengths = [(len(host) + len(path), len(host)) for host, path in candidate]
        for i, k in zip(owner, which, strict=True):
            if found[k] >= 0 and lengths[k] > length[i]:
                best[i], length[i] = found[k], lengths[k]
        return best


_OPEN: dict[str, DigestArray] = {}


def _opened(name: str) -> DigestArray:
    if name not in _OPEN:
        _OPEN[name] = DigestArray(SparkFiles.get(f"{name}.keys"), SparkFiles.get(f"{name}.arrow"))
    return _OPEN[name]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url), without a shuffle."""
    shipped = compile_rules(pages.sparkSession, rules)
    host, path = split_url(F.col("url"))

    def kernel(batches):
        array = _opened(shipped)
        for batch in slices(batches, 8192):
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            best = array.match(hosts, paths)
            picked = pa.array(best, mask=best < 0)
            verdict = pa.compute.fill_null(array.verdict.take(picked), default)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], array.rule.take(picked), verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(kernel, "page_id long, host string, path string, rule string, verdict string")
