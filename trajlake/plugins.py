"""Hooks by dotted name: table functions, frame functions, column functions and data sources that users plug in.

A hook is named ``package.module.attribute``. ``load`` checks that it has the
shape of its kind, ``register`` makes it known to a session's SQL.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

#: Kinds of hooks and the parameters that a call passes, beside options by name.
KINDS: dict[str, tuple[str, ...]] = {
    "rollout": (),  # a UDTF class: eval(*arguments) yields rows, RETURNS names their columns
    "filter": ("samples",),  # frame -> frame of the same columns
    "postprocess": ("samples",),  # frame -> frame
    "log": ("samples",),  # frame -> frame of one row of metrics
    "reward": ("response", "label"),  # columns -> column
    "advantage": ("rewards",),  # column -> column
    "source": (),  # a DataSource class
}


def resolve(path: str) -> object:
    """The object of a dotted name; a name without a module, or of nothing, raises."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"{path!r} names no module")
    found = getattr(import_module(module), name, None)
    if found is None:
        raise ValueError(f"{module} has no {name!r}")
    return found


def load(kind: str, path: str) -> object:
    """The hook of a dotted name, checked against its kind."""
    if kind not in KINDS:
        raise ValueError(f"{kind!r} is no kind of hook; there are {sorted(KINDS)}")
    hook = resolve(path)
    if kind == "rollout":
        if not (inspect.isclass(hook) and callable(getattr(hook, "eval", None)) and isinstance(getattr(hook, "RETURNS", None), str)):
            raise TypeError(f"{path} isn't a class with eval and RETURNS")
    elif kind == "source":
        if not (inspect.isclass(hook) and issubclass(hook, DataSource)):
            raise TypeError(f"{path} isn't a data source")
    else:
        if not callable(hook):
            raise TypeError(f"{path} can't be called")
        try:
            inspect.signature(hook).bind(*KINDS[kind])
        except TypeError as reason:
            raise TypeError(f"{path} doesn't take ({', '.join(KINDS[kind])}): {reason}") from None
    return hook


def register(spark: SparkSession, kind: str, name: str, path: str) -> None:
    """Makes a rollout hook a table function, or a source hook a format, of the session."""
    hook = load(kind, path)
    if kind == "rollout":
        spark.udtf.register(name, F.udtf(hook, returnType=hook.RETURNS))
    elif kind == "source":
        if hook.name() != name:
            raise ValueError(f"{path} is the format {hook.name()!r}")
        spark.dataSource.register(hook)
    else:
        raise ValueError(f"a {kind} hook is applied, not registered")


def roll_out(samples: DataFrame, path: str, *arguments: Column | str, **options: object) -> DataFrame:
    """Each row of ``samples`` with the rows that a rollout hook makes of its arguments, by a lateral join."""
    hook = load("rollout", path)
    table = F.udtf(hook, returnType=hook.RETURNS)
    made = table(*(F.col(a).outer() if isinstance(a, str) else a.outer() for a in arguments), **{k: F.lit(v) for k, v in options.items()})
    return samples.lateralJoin(made)


def apply_frame(samples: DataFrame, kind: str, path: str, **options: object) -> DataFrame:
    """What a filter, postprocess or log hook makes of ``samples``; a filter that changes the columns raises."""
    out = load(kind, path)(samples, **options)
    if not isinstance(out, DataFrame):
        raise TypeError(f"{path} gave no frame")
    if kind == "filter" and out.schema.names != samples.schema.names:
        raise TypeError(f"{path} changed the columns")
    return out


def apply_column(kind: str, path: str, *columns: Column, **options: object) -> Column:
    """What a reward or advantage hook makes of columns."""
    out = load(kind, path)(*columns, **options)
    if not isinstance(out, Column):
        raise TypeError(f"{path} gave no column")
    return out


class Generators:
    """Generator plugins by task type: a rollout hook and, optionally, validity, transformation and interval metrics of its groups."""

    def __init__(self) -> None:
        self.known: dict[str, dict[str, object]] = {}

    def add(self, module: str) -> str:
        """Adds a module with TASK_TYPE and run_rollout; transform_group, is_valid_group and interval_meta may follow."""
        found = import_module(module)
        task = getattr(found, "TASK_TYPE", None)
        if not isinstance(task, str) or not callable(getattr(found, "run_rollout", None)):
            raise TypeError(f"{module} needs TASK_TYPE and run_rollout")
        if task in self.known:
            raise ValueError(f"task type {task!r} is known already")
        load("rollout", f"{module}.run_rollout")
        self.known[task] = {k: getattr(found, k, None) for k in ("run_rollout", "transform_group", "is_valid_group", "interval_meta")}
        return task

    def hook(self, task: str, name: str, default: Callable | None = None) -> object:
        if task not in self.known:
            raise KeyError(f"no generator for task type {task!r}")
        return self.known[task].get(name) or default
