"""Tables that are replaced as a whole: versions in folders of their own, and a manifest for each that is published at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import delete, exists, hadoop_path
from .shared import written


class Versions:
    """The parts of a state (such as seen, status and yields) under a path. A version is numbered by its writer, for example by its day.

    Parts are written first, each to a new folder; then one manifest that names them all is put in place by a rename. Readers go by the newest
    manifest, so they see all parts of one version or of the one before, and a part may be written from what it replaces. A version that is
    there already isn't written again, so a run that is repeated changes nothing. What a lost writer left is in no manifest.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self) -> dict[int, str]:
        if not exists(self.spark, f"{self.path}/manifests"):
            return {}
        p, fs = hadoop_path(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {int(n[:-5]): n for n in names if n.endswith(".json") and n[:-5].isdigit()}

    def numbers(self) -> list[int]:
        return sorted(self._manifests())

    def manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number:020d}.json", wholetext=True).first()[0])

    def read(self, part: str, number: int | None = None) -> DataFrame | None:
        """A part of the newest version, or of one; null if there is none yet or the version doesn't have it."""
        held = self.numbers()
        if not held:
            return None
        entry = self.manifest(held[-1] if number is None else number)["parts"].get(part)
        if entry is None:
            return None
        reader = self.spark.read.schema(entry["schema"])
        return getattr(reader, entry["format"])(f"{self.path}/{entry['folder']}")

    def commit(self, number: int, parts: dict[str, DataFrame], form: str = "parquet") -> bool:
        """Publish a version; false if it was there. Parts that aren't given stay as they are in the newest version."""
        held = self.numbers()
        if number in held:
            return False
        if held and number < held[-1]:
            raise ValueError(f"version {number} would come before {held[-1]}")
        named = dict(self.manifest(held[-1])["parts"]) if held else {}
        for name, df in parts.items():
            folder = f"data/{name}/{number:020d}-{uuid.uuid4().hex}"
            getattr(df.write, form)(f"{self.path}/{folder}")
            named[name] = {"folder": folder, "schema": ", ".join(f"`{c}` {t}" for c, t in df.dtypes), "format": form}
        return self._publish(number, {"version": number, "parts": named})

    def _publish(self, number: int, what: dict) -> bool:
        draft, fs = hadoop_path(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        final, _ = hadoop_path(self.spark, f"{self.path}/manifests/{number:020d}.json")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(what), "utf-8"))
        out.close()
        done = not fs.exists(final) and fs.rename(draft, final)
        if not done:
            fs.delete(draft, False)
        return bool(done)

    def clean(self, keep: int = 2) -> list[str]:
        """Remove all but the newest versions, and folders of no manifest; returns what went. Not while another writer is at work."""
        held = self.numbers()
        for n in held[:-keep]:
            delete(self.spark, f"{self.path}/manifests/{n:020d}.json")
        used = {e["folder"] for n in held[-keep:] for e in self.manifest(n)["parts"].values()}
        gone = []
        if exists(self.spark, f"{self.path}/data"):
            top, fs = hadoop_path(self.spark, f"{self.path}/data")
            for part in fs.listStatus(top):
                for s in fs.listStatus(part.getPath()):
                    folder = f"data/{part.getPath().getName()}/{s.getPath().getName()}"
                    if folder not in used:
                        delete(self.spark, f"{self.path}/{folder}")
                        gone.append(folder)
        return gone


def write_run(spark: SparkSession, path: str, number: int, raw: DataFrame, parts: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> bool:
    """A run's output as JSON lines, published at once: all items as _raw, and, unless it is a dry run (no parts), what parts makes of them, such as
    shortlist, rejected, stats, per_source, errors and queries, as _pending/name. False if this run was there already.

    Items are computed once: parts are made of the rows as they were written.
    """
    store = Versions(spark, path)
    if number in store.numbers():
        return False
    rows = written(raw)
    named = {f"_pending/{n}": df for n, df in parts(rows).items()} if parts else {}
    return store.commit(number, {"_raw": rows, **named}, "json")
