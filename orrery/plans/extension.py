"""Where users of the engine plug in their own parts (P2-P5, P7, P8), and what guards calls to the outside.

All of it is driver-side metadata; the parts take and give lazy DataFrames.
"""

from __future__ import annotations

import threading
import time
from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import graph
from orrery.plans.model import topological
from orrery.plans.query_plane import Registry
from orrery.session import scratch
from orrery.sources import writers

T = TypeVar("T")


class Connectors(Registry):
    """By source type a factory and the options that it needs; ``connect`` refuses a source that lacks one."""

    def offer(self, source_type: str, factory: Callable[..., Any], needs: tuple[str, ...] = ()) -> None:
        self.register(source_type, (factory, needs))

    def connect(self, source_type: str, **options: Any) -> Any:
        factory, needs = self.get(source_type)
        missing = sorted(set(needs) - set(options))
        if missing:
            raise ValueError(f"{source_type} needs {missing}")
        return factory(**options)


class Compilers(Registry):
    """By target a function of the resources and of what the targets that it requires gave."""

    def target(self, name: str, compile_: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], requires: tuple[str, ...] = ()) -> None:
        self.register(name, (compile_, requires))

    def compile(self, resources: DataFrame, wanted: list[str]) -> dict[str, DataFrame]:
        """The wanted targets and all that they require, each once, in order of dependence."""
        needed, todo = {}, list(wanted)
        while todo:
            name = todo.pop()
            if name not in needed:
                needed[name] = list(self.get(name)[1])
                todo += needed[name]
        out: dict[str, DataFrame] = {}
        for name in topological(needed):
            compile_, requires = self.get(name)
            out[name] = compile_(resources, {r: out[r] for r in requires})
        return out


class Generators(Registry):
    """By name a function of named inputs to (messages), and which inputs it reads."""

    def generator(self, name: str, make: Callable[..., DataFrame], reads: tuple[str, ...]) -> None:
        self.register(name, (make, reads))

    def generate(self, inputs: dict[str, DataFrame], names: list[str] | None = None) -> dict[str, DataFrame]:
        """Samples of each generator whose inputs are all there; one that is asked for by name must have them."""
        out = {}
        for name in names if names is not None else self.names():
            make, reads = self.get(name)
            missing = [r for r in reads if r not in inputs]
            if missing and names is not None:
                raise KeyError(f"{name} reads {missing}")
            if not missing:
                out[name] = make(*[inputs[r] for r in reads])
        return out


class GraphBackend(ABC):
    """What a graph store must do. nodes(id, label, type), edges(src, dst, relation)."""

    @abstractmethod
    def nodes(self) -> DataFrame: ...

    @abstractmethod
    def edges(self) -> DataFrame: ...

    @abstractmethod
    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None: ...

    @abstractmethod
    def delete(self, ids: DataFrame) -> None: ...

    def neighbours(self, seeds: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
        return graph.reach(self.edges(), seeds, depth, direction)

    def shortest_path(self, source: Any, target: Any) -> DataFrame:
        return graph.shortest_path(self.edges(), source, target)

    def statistics(self) -> DataFrame:
        return graph.statistics(self.nodes(), self.edges())


class LazyBackend(GraphBackend):
    """Keeps plans: nothing is written until a result is asked for."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self._nodes, self._edges = nodes, edges

    def nodes(self) -> DataFrame:
        return self._nodes

    def edges(self) -> DataFrame:
        return self._edges

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None:
        self._nodes = writers.upsert(self._nodes, nodes, ["id"])
        self._edges = self._edges.unionByName(edges).distinct()

    def delete(self, ids: DataFrame) -> None:
        self._nodes, self._edges = writers.delete(self._nodes, self._edges, ids)


class StoredBackend(LazyBackend):
    """Writes a new version of both tables after every change, so plans stay short and readers keep what they read."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        super().__init__(nodes, edges)
        self._write()

    def _write(self) -> None:
        spark = self._nodes.sparkSession
        for name in ("_nodes", "_edges"):
            path = scratch(spark)
            getattr(self, name).write.parquet(path)
            setattr(self, name, spark.read.parquet(path))

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None:
        super().upsert(nodes, edges)
        self._write()

    def delete(self, ids: DataFrame) -> None:
        super().delete(ids)
        self._write()


def graph_backends() -> Registry:
    out = Registry()
    out.register("lazy", LazyBackend)
    out.register("stored", StoredBackend)
    return out


@dataclass
class Task:
    task_type: str
    payload: dict[str, Any]
    status: str = "pending"
    result: Any = None
    error: str = ""


class TaskExecutors(Registry):
    """By task type a function of the payload. A task that fails says so and does not stop the others."""

    def run(self, task: Task) -> Task:
        task.status = "running"
        try:
            task.result, task.status = self.get(task.task_type)(**task.payload), "completed"
        except Exception as e:  # noqa: BLE001 - whatever a task raises is its result
            task.status, task.error = "failed", f"{type(e).__name__}: {e}"
        return task


# --- calls to the outside ---------------------------------------------------------------------------------------------


class CircuitOpen(RuntimeError):
    pass


@dataclass
class CircuitBreaker:
    """After ``failures`` failures in a row calls are refused for ``rest`` seconds; then up to ``trials`` are tried,
    ``successes`` of which, in a row, close it again, and one failure opens it."""

    failures: int = 5
    rest: float = 30.0
    trials: int = 3
    successes: int = 2
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    _count: int = 0
    _tried: int = 0
    _opened: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def call(self, f: Callable[[], T]) -> T:
        with self._lock:
            if self.state == "open":
                if self.clock() - self._opened < self.rest:
                    raise CircuitOpen(f"try again in {self.rest - (self.clock() - self._opened):.0f} s")
                self.state, self._count, self._tried = "half_open", 0, 0
            if self.state == "half_open":
                if self._tried >= self.trials:
                    raise CircuitOpen("being tried")
                self._tried += 1
        try:
            out = f()
        except Exception:
            with self._lock:
                self._count += 1
                if self.state == "half_open" or self._count >= self.failures:
                    self.state, self._opened = "open", self.clock()
            raise
        with self._lock:
            if self.state == "half_open":
                self._count += 1
                if self._count >= self.successes:
                    self.state, self._count = "closed", 0
            else:
                self._count = 0
        return out


def retry(f: Callable[[], T], attempts: int = 3, delay: float = 1.0, most: float = 60.0, base: float = 2.0, on: type[Exception] = Exception, sleep: Callable[[float], None] = time.sleep) -> T:
    """F again after a failure, waiting delay * base^(n - 1) seconds but at most ``most``; the last failure is raised."""
    for n in range(1, attempts + 1):
        try:
            return f()
        except on:
            if n == attempts:
                raise
            sleep(min(most, delay * base ** (n - 1)))
    raise ValueError("no attempt was allowed")


class TwoLevelCache:
    """Results by key: plans of the most recent in memory (L1), all of them as tables in the shared folder (L2).

    A result ends ``ttl`` seconds after it was made. Many threads that ask for a key that is not there compute it once.
    An empty result is a result.
    """

    def __init__(self, spark: SparkSession, most: int = 64, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.most, self.ttl, self.clock = spark, most, ttl, clock
        self.first: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.second: dict[str, tuple[float, str]] = {}
        self.hits = {"l1": 0, "l2": 0, "computed": 0}
        self._lock, self._flights = threading.Lock(), {}

    def _held(self, key: str) -> DataFrame | None:
        now = self.clock()
        if key in self.first and now - self.first[key][0] < self.ttl:
            self.first.move_to_end(key)
            self.hits["l1"] += 1
            return self.first[key][1]
        if key in self.second and now - self.second[key][0] < self.ttl:
            self.hits["l2"] += 1
            return self._keep(key, self.second[key][0], self.spark.read.parquet(self.second[key][1]))
        return None

    def _keep(self, key: str, made: float, df: DataFrame) -> DataFrame:
        self.first[key] = (made, df)
        self.first.move_to_end(key)
        while len(self.first) > self.most:
            self.first.popitem(last=False)
        return df

    def get(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            got = self._held(key)
            if got is not None:
                return got
            flight = self._flights.setdefault(key, threading.Lock())
        with flight:
            with self._lock:
                got = self._held(key)
                if got is not None:
                    return got
            path = scratch(self.spark)
            compute().write.parquet(path)
            with self._lock:
                self.second[key] = (self.clock(), path)
                self.hits["computed"] += 1
                return self._keep(key, self.second[key][0], self.spark.read.parquet(path))

    def drop(self, prefix: str = "") -> None:
        with self._lock:
            for held in (self.first, self.second):
                for key in [k for k in held if k.startswith(prefix)]:
                    del held[key]


def rows_of(spark: SparkSession, state: dict[str, Any]) -> DataFrame:
    """A registry's or a cache's state as rows (name, value), for reports."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(state.items())], "name string, value string").orderBy(F.col("name"))
