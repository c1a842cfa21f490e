"""Several journals merged into one set of tables: batches appended as deltas, and a pointer written last that says what counts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hslake.sources.shared import exists, read_text, write_text


class SourceRolledBack(ValueError):
    """A source's last revision is before its cursor: it was replaced or restored."""


@dataclass
class Replica:
    """Tables merged by natural key below ``folder``.

    A batch of a source carries its rows with their ``change_revision``. It is taken in one step: rows beyond the source's cursor go to a new delta of each table under the next target
    revision, then the pointer (target revision, base revision, cursors) is replaced. A batch that was already taken has nothing beyond the cursor and changes
    nothing; a delta whose pointer was never written isn't read, and the next batch overwrites it. Batch numbers play no part, so skipped ones don't matter.
    Only deltas are written; every ``compact_every`` revisions the merged tables become the new base. One writer at a time.
    """

    spark: SparkSession
    folder: str
    keys: dict[str, list[str]]
    schemas: dict[str, str] = field(default_factory=dict)
    compact_every: int = 16

    def state(self) -> dict:
        text = read_text(self.spark, f"{self.folder}/state.json")
        return json.loads(text) if text else {"revision": 0, "base": 0, "cursors": {}}

    def cursor(self, source: str) -> int:
        return self.state()["cursors"].get(source, 0)

    def apply(self, source: str, tables: dict[str, DataFrame], *, available: int | None = None, before_pointer: Callable[[], None] | None = None) -> dict:
        """Takes one batch; ``available`` is the source's last revision. ``before_pointer`` runs between data and pointer (tests)."""
        state = self.state()
        cursor = state["cursors"].get(source, 0)
        if available is not None and available < cursor:
            raise SourceRolledBack(f"{source} is at revision {available}, before its cursor {cursor}")
        fresh = {n: df.where(F.col("change_revision") > cursor) for n, df in tables.items()}
        upper = max([r for df in fresh.values() if (r := df.agg(F.max("change_revision")).first()[0]) is not None], default=None)
        if upper is None:
            return state
        revision = state["revision"] + 1
        for name, df in fresh.items():
            df.withColumns({"source": F.lit(source), "target_revision": F.lit(revision).cast("long")}).write.mode("overwrite").parquet(f"{self.folder}/{name}/delta={revision}")
        if before_pointer:
            before_pointer()
        state = {"revision": revision, "base": state["base"], "cursors": state["cursors"] | {source: upper}}
        if revision - state["base"] >= self.compact_every:
            for name in self.keys:
                merged = self._merged(name, state)
                if merged is not None:
                    merged.write.mode("overwrite").parquet(f"{self.folder}/{name}/base={revision}")
            state["base"] = revision
        write_text(self.spark, f"{self.folder}/state.json", json.dumps(state, sort_keys=True))
        return state

    def _merged(self, name: str, state: dict) -> DataFrame | None:
        paths = [f"{self.folder}/{name}/base={state['base']}", *(f"{self.folder}/{name}/delta={r}" for r in range(state["base"] + 1, state["revision"] + 1))]
        paths = [p for p in paths if exists(self.spark, f"{p}/_SUCCESS")]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        key = ["source", *self.keys[name]]
        rest = [c for c in rows.columns if c not in key]
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("change_revision", "target_revision")).alias("r"))
        return latest.select(*key, "r.*")

    def table(self, name: str) -> DataFrame | None:
        """The merged rows that the pointer vouches for: the newest of each source's key, with the target revision that brought it."""
        return self._merged(name, self.state())

    def sink(self, source: str, name: str) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that takes a source's stream of rows of one table."""

        def take(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                self.apply(source, {name: batch})
            finally:
                batch.unpersist()

        return take
