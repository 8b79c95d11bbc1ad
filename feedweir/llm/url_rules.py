"""URL filter by sorted digest arrays.

Rules (``host/path``, allow or block) are hashed with 64-bit xxhash. Shards of them are written to the shared folder, each as a sorted
array of digests beside the rules' full strings. Tasks memory-map the arrays and probe them by vectorised binary search
with every (host suffix, path prefix) of their URLs that could be a rule; a hit counts only if the stored string is the same.
No URL is shuffled, and the rules never meet in one process.

The longest fitting rule decides; without one the verdict is ``DEFAULT``: the list names what is not wanted.

Edge cases: null, empty and relative URLs have an empty host and path and fit no rule; an empty rule table allows all; of repeated
rules that disagree ``block`` wins; null rules are ignored; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.llm.scratch import Scratch

DEFAULT = "allow"
#: Rules in one shard.
SHARD_RULES = 1 << 20
_JUDGED = "page_id long, host string, path string, rule string, verdict string"


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` with A-Z in lower case, path up to ``?`` or ``#``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host = min(ends, default=len(rest))
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return rest[:host].encode().lower().decode(), rest[host:stop] if host < stop else ""


def digests(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


def _filesystem(folder: str):
    """(open for reading and mapping locally?, path or pyarrow file system and path)."""
    scheme = urlparse(folder).scheme
    if scheme in ("", "file"):
        return None, urlparse(folder).path
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, data: bytes) -> None:
    store, path = _filesystem(folder)
    if store is None:
        os.makedirs(path, exist_ok=True)
        half = f"{path}/{name}.{uuid.uuid4().hex}"
        with open(half, "wb") as f:
            f.write(data)
        os.replace(half, f"{path}/{name}")  # a repeated task replaces the file with the same bytes
    else:
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(data)


def _read(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of the shared folder: memory-mapped where it is mounted, else fetched."""
    store, path = _filesystem(folder)
    if store is None:
        return np.memmap(f"{path}/{name}", kind, "r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, kind)
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def _digested(shards: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            key = digests(frame["rule"].tolist())
            yield frame.assign(shard=(key % np.uint64(shards)).astype(np.int32))

    return run


def _store(folder: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard, key = int(frame["shard"].iloc[0]), digests(frame["rule"].tolist())
        order = np.lexsort((frame["rule"].to_numpy(), key))
        rules = [frame["rule"].iloc[i].encode() for i in order]
        ends = np.cumsum([0, *map(len, rules)]).astype("<i8")
        _write(folder, f"{shard}.keys", key[order].astype("<u8").tobytes())
        _write(folder, f"{shard}.ends", ends.tobytes())
        _write(folder, f"{shard}.text", b"".join(rules))
        _write(folder, f"{shard}.block", frame["block"].to_numpy()[order].astype(np.uint8).tobytes())
        return pd.DataFrame({"shard": [shard], "rules": [len(rules)]})

    return run


class Rules:
    """Mapped digest arrays of all shards."""

    def __init__(self, folder: str, shards: list[int], of: int):
        self.of = of
        self.shards = {s: [_read(folder, f"{s}.{x}", k) for x, k in (("keys", "<u8"), ("ends", "<i8"), ("text", "u1"), ("block", "u1"))] for s in shards}

    def find(self, asked: list[str]) -> list[bool | None]:
        """Whether each string is a rule that blocks (True), one that allows (False) or no rule (None)."""
        found: list[bool | None] = [None] * len(asked)
        key = digests(asked)
        shard = (key % np.uint64(self.of)).astype(np.int64)
        for s, (keys, ends, text, block) in self.shards.items():
            mine = np.flatnonzero(shard == s)
            at = np.searchsorted(keys, key[mine])
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == key[mine[hit]]
            for i, k in zip(mine[hit].tolist(), at[hit].tolist(), strict=True):
                while k < len(keys) and keys[k] == key[i]:
                    if text[ends[k] : ends[k + 1]].tobytes() == asked[i].encode():
                        found[i] = bool(block[k])
                        break
                    k += 1
        return found


def _judge(folder: str, shards: list[int], of: int, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(folder, shards, of)
        for batch in batches:
            where = [parts(u) for u in batch.column("url").to_pylist()]
            asked, owner = [], []
            for i, (host, path) in enumerate(where):
                if not host:
                    continue
                tails, at = [host], host.find(".")
                while at >= 0:
                    tails.append(host[at + 1 :])
                    at = host.find(".", at + 1)
                for n in lengths:
                    if n <= len(path):
                        asked += [t + path[:n] for t in tails]
                        owner += [i] * len(tails)
            best: list[str | None] = [None] * len(where)
            verdict = [DEFAULT] * len(where)
            for i, rule, block in zip(owner, asked, rules.find(asked), strict=True):
                if block is not None and (best[i] is None or len(rule) > len(best[i])):
                    best[i], verdict[i] = rule, "block" if block else "allow"
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()),
                    pa.array(best, pa.string()), pa.array(verdict, pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, rules: DataFrame, shard_rules: int = SHARD_RULES) -> DataFrame:
    """→ page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); ``rules``: rule, verdict."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-rules")
    clean = scratch.put(
        rules.where("rule is not null and rule <> ''").groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("block")), "rules"
    )
    shards = max(1, -(-clean.count() // shard_rules))
    path_size = F.char_length("rule") - F.when(F.instr("rule", "/") > 0, F.instr("rule", "/") - 1).otherwise(F.char_length("rule"))
    lengths = sorted(r[0] for r in clean.select(path_size.alias("n")).distinct().collect())  # as many as path lengths
    folder = scratch.path("digests")
    stored = clean.mapInPandas(_digested(shards), "rule string, block boolean, shard int").groupBy("shard")
    made = [r["shard"] for r in stored.applyInPandas(_store(folder), "shard int, rules long").collect()]  # one row per shard
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return rows.mapInArrow(_judge(folder, made, shards, lengths), _JUDGED)
