"""Registry of sources, models, tests and exposures, and the frames built from it.

A model is a function of its inputs' DataFrames. Building registers each
model's frame as a temporary view, which keeps the plan declarative and gives
column lineage its boundaries; only models marked ``table`` are written.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomwork.session import materialized
from loomwork.sources.versions import Versions


@dataclass(frozen=True)
class Source:
    name: str
    group: str
    loaded_at: str = "_extracted_at"
    warn_hours: int = 6
    error_hours: int = 12


@dataclass(frozen=True)
class DataTest:
    """``kind``: unique, not_null, relationships (with parent and field), or custom (with a condition)."""

    kind: str
    model: str
    column: str
    parent: str | None = None
    parent_column: str | None = None
    failing: str | None = None

    @property
    def name(self) -> str:
        return "_".join(filter(None, (self.kind, self.model, self.column, self.parent)))


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    materialized: str = "view"
    description: str = ""
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Exposure:
    name: str
    kind: str
    priority: str
    maturity: str
    inputs: tuple[str, ...]


@dataclass
class Project:
    name: str
    sources: dict[str, Source] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)
    tests: list[DataTest] = field(default_factory=list)
    exposures: dict[str, Exposure] = field(default_factory=dict)

    def source(self, name: str, group: str) -> None:
        self.sources[name] = Source(name, group)

    def model(self, *inputs: str, layer: str, materialized: str = "view") -> Callable:
        def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.models[build.__name__] = Model(build.__name__, layer, inputs, build, materialized, (build.__doc__ or "").strip())
            return build
        return add

    def node_id(self, name: str) -> str:
        """Canonical id of a source, model or exposure."""
        if name in self.sources:
            return f"source.{self.name}.{self.sources[name].group}.{name}"
        return f"{'exposure' if name in self.exposures else 'model'}.{self.name}.{name}"

    def build(self, spark: SparkSession, raw: dict[str, DataFrame], only: set[str] | None = None, share: bool = False, reads: Collection[str] = (), layers: tuple[str, ...] = ("intermediate",)) -> dict[str, DataFrame]:
        """Frames of all sources and models (or of ``only`` and what they need), each a temporary view of its name.

        With ``share``, a model of ``layers`` that several of the built ones read is computed once and written to the shared folder; ``reads`` are read by the caller, too.
        """
        frames: dict[str, DataFrame] = {}
        readers = Counter(i for m in self._needed(only) for i in self.models[m].inputs) + Counter(reads)

        def frame(name: str) -> DataFrame:
            if name not in frames:
                made = raw[name] if name in self.sources else self.models[name].build(*[frame(i) for i in self.models[name].inputs])
                if share and name in self.models and self.models[name].layer in layers and readers[name] > 1:
                    made = materialized(made, name)
                made.createOrReplaceTempView(name)
                frames[name] = spark.table(name)
            return frames[name]

        for name in [*self.sources, *self.models] if only is None else sorted(only):
            frame(name)
        return frames

    def _needed(self, only: set[str] | None) -> set[str]:
        """The models of ``only`` and those that they stand on; all without it."""
        found, left = set(), list(self.models if only is None else only)
        while left:
            name = left.pop()
            if name in self.models and name not in found:
                found.add(name)
                left += self.models[name].inputs
        return found

    def write(self, spark: SparkSession, raw: dict[str, DataFrame], folder: str) -> list[str]:
        """Build, and store every model marked ``table`` under ``folder``, all in one step as a version of it; the names written. What several read is computed once."""
        frames = self.build(spark, raw, share=True)
        done = [m.name for m in self.models.values() if m.materialized == "table" and m.name in frames]
        Versions(spark, folder).replace({name: frames[name] for name in done})
        return done
