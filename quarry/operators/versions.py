"""Versions of derived tables: what is built becomes visible at once, and is built again only if what it is made of has changed.

A store is a folder.  Each build writes its tables into new folders and then one new manifest, a numbered JSON file that is created
once and never changed; the highest number is the current version.  Readers that hold a version keep reading its tables.  A build
that fails leaves no manifest.  Two builds from the same version can't both publish: the second finds its number taken (as surely
as the file system's rename refuses a name that exists).
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.shared import shared_dir

MANIFESTS = "_versions"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def stamp(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files below the paths; a missing path counts as empty."""
    found = []
    for path in paths:
        fs, at = _files(spark, path)
        if not fs.exists(at):
            found.append(f"{path} -")
            continue
        each = fs.listFiles(at, True)
        while each.hasNext():
            f = each.next()
            found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


class Conflict(RuntimeError):
    """Another build published first."""


@dataclass(frozen=True)
class Version:
    number: int
    #: Of each target: the folder of its table, what it was made of, and anything that its maker noted.
    targets: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Target:
    """What to build: ``make(path, targets)`` writes below a new folder and may return notes; ``inputs`` are paths, ``after`` other
    targets, whose entries it is given, beside its own last entry (None at first)."""

    make: Callable[[str, dict[str, dict]], dict | None]
    inputs: Sequence[str] = ()
    after: Sequence[str] = ()
    #: A target is built again if this changes: its definition's version or parameters.
    recipe: str = ""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> Version:
        """The newest version; number 0 without targets if nothing has been published."""
        fs, at = _files(self.spark, f"{self.folder}/{MANIFESTS}")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        return self.version(max(numbers)) if numbers else Version(0)

    def version(self, number: int) -> Version:
        fs, at = _files(self.spark, f"{self.folder}/{MANIFESTS}/{number:012d}.json")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, json.loads(text))

    def publish(self, targets: dict[str, dict], based_on: Version) -> Version:
        """The next version; an error if there is one already."""
        new = Version(based_on.number + 1, targets)
        fs, at = _files(self.spark, f"{self.folder}/{MANIFESTS}/{new.number:012d}.json")
        _, whole = _files(self.spark, f"{self.folder}/{MANIFESTS}/{uuid.uuid4().hex}.tmp")
        stream = fs.create(whole, True)
        stream.write(bytearray(json.dumps(targets, sort_keys=True).encode()))
        stream.close()
        if fs.exists(at) or not fs.rename(whole, at):  # a name that is taken is never replaced
            fs.delete(whole, False)
            raise Conflict(f"version {new.number} of {self.folder} exists")
        return new

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        return self.spark.read.parquet((version or self.current()).targets[name]["path"])

    def build(self, targets: Mapping[str, Target], log: Callable[[dict], None] = lambda row: None) -> Version:
        """Build what is stale, in the order of the targets' dependencies, and publish all of it as one version.

        A target is stale if it was never built, if its recipe or the files of its inputs have changed, or if a target it comes after is
        built again.  Each target's outcome (``built``, ``current``, ``failed``) goes to ``log``; a failure publishes nothing.
        """
        before = self.current()
        after, done = dict(before.targets), set()
        for name in ordered(targets):
            t = targets[name]
            made_of = {"files": stamp(self.spark, *t.inputs), "recipe": t.recipe, "after": {a: after[a]["path"] for a in t.after}}
            began = time.time()
            if name in before.targets and before.targets[name]["of"] == made_of and not done & set(t.after):
                log({"target": name, "state": "current", "seconds": 0.0})
                continue
            path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            try:
                notes = t.make(path, {name: before.targets.get(name), **{a: after[a] for a in t.after}})
            except Exception as e:
                log({"target": name, "state": "failed", "seconds": round(time.time() - began, 3), "error": f"{type(e).__name__}: {e}"[:500]})
                raise
            after[name] = {"path": path, "of": made_of, "notes": notes or {}}
            done.add(name)
            log({"target": name, "state": "built", "seconds": round(time.time() - began, 3)})
        return self.publish(after, before) if done else before


def ordered(targets: Mapping[str, Target]) -> list[str]:
    """Every target behind those it comes after; an error if that can't be."""
    out: list[str] = []
    while len(out) < len(targets):
        ready = [n for n, t in targets.items() if n not in out and set(t.after) <= set(out)]
        if not ready:
            raise ValueError(f"these targets wait for each other or for unknown ones: {sorted(set(targets) - set(out))}")
        out += ready
    return out


def derived(spark: SparkSession, name: str, inputs: Sequence[str], make: Callable[[str, dict], dict | None], recipe: str = "") -> dict:
    """A table that is made of input files, as it was last built from just these files; else it is built now.

    It lies in the shared folder.  Returns its path and notes."""
    store = Store(spark, f"{shared_dir(spark)}/quarry/derived/{name}-{hashlib.sha256(chr(10).join(inputs).encode()).hexdigest()[:16]}")
    target = Target(make, inputs, recipe=recipe)
    try:
        version = store.build({"table": target})
    except Conflict:
        version = store.build({"table": target})
    return version.targets["table"]
