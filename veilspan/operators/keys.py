"""The key service: versions, rotation, pinning, retirement. It lives on the driver and in its own file."""

from __future__ import annotations

import base64
import json
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from veilspan.config import Rotation
from veilspan.operators import crypto


class KeyService:
    def __init__(self, path: str | None = None, policy: Rotation | None = None, clock: Callable[[], float] = time.time):
        self.path, self.policy, self.clock = Path(path) if path else None, policy or Rotation(), clock
        self.pinned: int | None = None
        self.frozen = False
        self.operations = 0
        if self.path and self.path.exists():
            data = json.loads(self.path.read_text())
            self.master = base64.b64decode(data["master"])
            self.versions = {int(v): t for v, t in data["versions"].items()}
        else:
            self.master, self.versions = crypto.new_master(), {1: self.clock()}
            self.persist()

    @property
    def current(self) -> int:
        return self.pinned if self.pinned is not None else max(self.versions)

    def key(self, version: int) -> bytes:
        if version not in self.versions:
            raise KeyError(f"no key of version {version}")
        return crypto.derive_key(self.master, version)

    def table(self, spark: SparkSession) -> DataFrame:
        return crypto.key_table(spark, {v: self.key(v) for v in self.versions})

    def count(self, n: int) -> None:
        """Adds to the encryptions made with the current key, by which the policy may ask for a new one."""
        self.operations += n

    def rotate(self) -> int:
        version = max(self.versions) + 1
        self.versions[version] = self.clock()
        self.operations = 0
        self.persist()
        return version

    def rotate_if_needed(self) -> bool:
        if self.pinned is not None or self.frozen:
            return False
        age = (self.clock() - self.versions[max(self.versions)]) * 1000
        if self.operations >= self.policy.max_operations or age >= self.policy.max_age_ms:
            self.rotate()
            return True
        return False

    def pin(self, version: int) -> None:
        self.key(version)
        self.pinned = version

    def unpin(self) -> None:
        self.pinned = None

    def retire(self, used: set[int]) -> list[int]:
        """Deletes keys below max(1, current - 1) that no record uses; the current and previous key stay."""
        gone = [v for v in sorted(self.versions) if v < max(1, self.current - 1) and v not in used]
        for v in gone:
            del self.versions[v]
        self.persist()
        return gone

    def prune(self, used: set[int]) -> list[int]:
        """Keeps the newest versions of the policy and those in use."""
        gone = [v for v in sorted(self.versions)[: -self.policy.keep] if v not in used and v != self.current]
        for v in gone:
            del self.versions[v]
        self.persist()
        return gone

    def persist(self) -> None:
        """One atomic rename."""
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            part = self.path.with_suffix(".part")
            part.write_text(json.dumps({"master": base64.b64encode(self.master).decode(), "versions": self.versions}))
            os.chmod(part, 0o600)
            part.replace(self.path)


def wipe(key: bytearray) -> None:
    """Overwrites this copy of a key; other copies, which Python and the JVM may hold, stay."""
    key[:] = bytes(len(key))


def safe_to_delete(usage: DataFrame, version: int) -> bool:
    """Whether no record is on a version; usage: key_version, n."""
    return usage.where((usage["key_version"] == version) & (usage["n"] > 0)).isEmpty()
