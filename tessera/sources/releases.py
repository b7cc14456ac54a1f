"""Releases that readers see whole or not at all.

A release is a folder of assets that is never changed once written. Its manifest (rows and an order-free
fingerprint of every asset) is written after all assets, and the last step is a pointer: one small file with the next
number in a channel's folder, created only if nobody else has created it. Readers follow the readable pointer with the largest
number. So a writer that fails at any point leaves the old release in place, of two writers who start from the same pointer one is
refused, and a rollback is a pointer to an older folder, nothing is copied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Somebody else has moved the pointer."""


class Pointer(NamedTuple):
    """A channel's release: number of the pointer, release, its folder, its parent, and what moved the pointer."""

    number: int
    release_id: str
    folder: str
    parent: str | None
    reason: str


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; one that is there is a conflict."""
    fs, jpath = _fs(spark, path)
    try:
        stream = fs.create(jpath, False)
    except Exception as e:
        if fs.exists(jpath):
            raise Conflict(path) from e
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def claim(spark: SparkSession, path: str) -> None:
    """Create a file that nobody else has; a :class:`Conflict` where somebody has."""
    _create(spark, path, "{}")


def history(spark: SparkSession, root: str, channel: str) -> list[Pointer]:
    """All pointers of a channel, oldest first. A file that a writer left unfinished is no pointer."""
    fs, folder = _fs(spark, f"{root}/channels/{channel}")
    if not fs.exists(folder):
        return []
    out = []
    for name in sorted(s.getPath().getName() for s in fs.listStatus(folder)):
        if name.endswith(".json") and not name.startswith((".", "_")):
            try:
                out.append(Pointer(**json.loads(_read_text(spark, f"{root}/channels/{channel}/{name}"))))
            except (ValueError, TypeError):
                continue
    return out


def current(spark: SparkSession, root: str, channel: str) -> Pointer | None:
    found = history(spark, root, channel)
    return found[-1] if found else None


def _move(spark: SparkSession, root: str, channel: str, seen: int, release_id: str, folder: str, parent: str | None, reason: str) -> Pointer:
    """The pointer after ``seen``. Numbers of unfinished files are passed over, but not those of somebody's pointer."""
    fs, jfolder = _fs(spark, f"{root}/channels/{channel}")
    taken = [int(s.getPath().getName().removesuffix(".json")) for s in (fs.listStatus(jfolder) if fs.exists(jfolder) else []) if s.getPath().getName().removesuffix(".json").isdigit()]
    latest = current(spark, root, channel)
    if (latest.number if latest else 0) != seen:
        raise Conflict(f"{channel} is at {latest.number if latest else 0}, not at {seen}")
    pointer = Pointer(max([seen, *taken]) + 1, release_id, folder, parent, reason)
    _create(spark, f"{root}/channels/{channel}/{pointer.number:012d}.json", json.dumps(pointer._asdict()))
    return pointer


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): the fingerprint is a sum over rows, so it does not depend on their order."""
    whole = F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(whole), F.lit(0)).cast("string").alias("fingerprint"))


def publish(spark: SparkSession, root: str, channel: str, release_id: str, assets: dict[str, DataFrame], guard: Callable[[dict], None] | None = None, reason: str = "publish") -> Pointer:
    """Write the assets of a release to a folder of its own, then its manifest, then the pointer. ``guard`` sees the manifest and may refuse
    the release by raising."""
    before = current(spark, root, channel)
    folder = f"{root}/data/{release_id}-{uuid.uuid4().hex}"
    manifest = {"release_id": release_id, "assets": {}}
    for name, df in assets.items():
        df.write.mode("error").parquet(f"{folder}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        manifest["assets"][name] = fingerprint(written).first().asDict() | {"schema": written.schema.simpleString()}
    if guard is not None:
        guard(manifest)
    _create(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return _move(spark, root, channel, before.number if before else 0, release_id, folder, before.release_id if before else None, reason)


def rollback(spark: SparkSession, root: str, channel: str, release_id: str | None = None, reason: str = "rollback") -> Pointer:
    """The pointer back to an earlier release of the channel, the parent where none is named."""
    found = history(spark, root, channel)
    if not found:
        raise ValueError(f"{channel} has no release")
    wanted = release_id or found[-1].parent
    older = [p for p in found if p.release_id == wanted]
    if not older:
        raise ValueError(f"no release to go back to: {wanted}")
    return _move(spark, root, channel, found[-1].number, older[-1].release_id, older[-1].folder, older[-1].parent, reason)


def read_manifest(spark: SparkSession, pointer: Pointer) -> dict:
    return json.loads(_read_text(spark, f"{pointer.folder}/manifest.json"))


def read_asset(spark: SparkSession, root: str, channel: str, name: str) -> DataFrame:
    """An asset of the release that the channel points to now; a reader keeps that release however the pointer moves."""
    pointer = current(spark, root, channel)
    if pointer is None:
        raise ValueError(f"{channel} has no release")
    return spark.read.parquet(f"{pointer.folder}/{name}")


def damaged(spark: SparkSession, pointer: Pointer) -> list[str]:
    """Assets whose rows are no longer what the manifest says."""
    out = []
    for name, said in read_manifest(spark, pointer)["assets"].items():
        now = fingerprint(spark.read.parquet(f"{pointer.folder}/{name}")).first()
        if (now["rows"], now["fingerprint"]) != (said["rows"], said["fingerprint"]):
            out.append(name)
    return out


def abandoned(spark: SparkSession, root: str, channels: list[str]) -> list[str]:
    """Folders that no pointer of the channels names: what failed writers left behind."""
    fs, data = _fs(spark, f"{root}/data")
    named = {p.folder.rsplit("/", 1)[1] for c in channels for p in history(spark, root, c)}
    return sorted(s.getPath().getName() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in named)


def same_package(packages: set[str]) -> Callable[[dict], None]:
    """A guard: a release scoped to packages may hold assets of these only (assets are named package/kind)."""

    def check(manifest: dict) -> None:
        strange = {n.split("/")[0] for n in manifest["assets"]} - packages
        if strange:
            raise ValueError(f"outside the packages of this release: {sorted(strange)}")

    return check


def verify_or_rollback(spark: SparkSession, root: str, channel: str, hit_rate: float, least: float) -> dict:
    """After publishing: a release whose retrieval is worse than ``least`` gives way to its parent. The outcome as an event."""
    now = current(spark, root, channel)
    event = {"release_id": now.release_id, "rolled_back_to": None, "event_type": "release.verified", "hit_rate": hit_rate, "least": least}
    if hit_rate + 1e-9 >= least:
        return event
    if now.parent is None:
        return event | {"event_type": "release.regressed_without_parent"}
    back = rollback(spark, root, channel, now.parent, "retrieval_eval_regression")
    return event | {"event_type": "release.auto_rolled_back", "rolled_back_to": back.release_id}
