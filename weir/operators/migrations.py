"""Named migrations, each applied once and in order; what has been applied is itself a small table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .schema import Catalog, SchemaError, TableMeta

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    run: Callable[..., Tables]
    merging: frozenset[str] = frozenset()


class Migrator:
    """check: keys of the tables; with them, every step must leave no row whose foreign key misses its parent."""

    def __init__(self, check: dict[str, TableMeta] | None = None) -> None:
        self.steps: dict[str, Step] = {}
        self.check = check

    def register(self, name: str, step: Callable[..., Tables], merging: tuple[str, ...] = ()) -> None:
        """merging: names of older migrations that this one takes the place of. Such a step also gets the names of those among them that were applied."""
        if name in self.steps:
            raise ValueError(f"two migrations named {name}")
        self.steps[name] = Step(step, frozenset(merging))

    def migrate(self, tables: Tables, applied: list[str], up_to: str | None = None) -> tuple[Tables, list[str]]:
        """The tables after the steps not yet applied, and the names of all that are."""
        if up_to is not None and up_to not in self.steps:
            raise ValueError(f"no migration named {up_to}")
        if self.superseded(applied):
            raise ValueError("the tables were migrated by a later version")
        applied = list(applied)
        for name, step in self.steps.items():
            if name not in applied:
                if step.merging:
                    done = step.merging & set(applied)
                    if done != step.merging:
                        tables = step.run(dict(tables), done)
                    applied = [a for a in applied if a not in step.merging]
                else:
                    tables = step.run(dict(tables))
                self._checked(tables, name)
                applied.append(name)
            if name == up_to:
                break
        return tables, applied

    def _checked(self, tables: Tables, name: str) -> None:
        if not self.check or not tables:
            return
        metas = {t: m for t, m in self.check.items() if t in tables}
        db = Catalog(next(iter(tables.values())).sparkSession, tables=tables, metas=metas)
        for t, m in metas.items():
            if m.fks and not db.violations(t).isEmpty():
                raise SchemaError(f"migration {name} leaves rows of {t} without their parents")

    def has_changed(self, tables: Tables, applied: list[str], start: Tables | None = None) -> bool:
        """Whether the tables' columns differ from what the applied steps, as they are registered now, make of the start."""
        names = [a for a in applied if a in self.steps]
        fresh = dict(start or {})
        for a in names:
            step = self.steps[a]
            fresh = step.run(dict(fresh), frozenset()) if step.merging else step.run(dict(fresh))
        shape = lambda ts: {t: [(f.name, f.dataType.simpleString()) for f in df.schema.fields] for t, df in ts.items()}
        return shape(fresh) != shape(tables) or set(applied) - set(self.steps) != set()

    def superseded(self, applied: list[str]) -> bool:
        merged = {m for s in self.steps.values() for m in s.merging}
        return bool(set(applied) - set(self.steps) - merged)
