"""Actions, models and the runner: what is called for the runs of a spec set."""

from __future__ import annotations

import inspect
import json
import logging
import math
import time
import traceback
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("gridloom")
#: Log levels by verbosity: fixed values.
LEVELS = {-1: logging.WARNING, 0: logging.INFO, 1: logging.DEBUG}
ERROR_LOG_BYTES = 100 * 1024
#: Runs that earn a warning.
MANY = 2_000_000


@dataclass
class RunContext:
    """What an action sees of its run."""

    spark: SparkSession
    run: dict[str, Any]
    position: int = 0
    total: int = 1
    shared: dict[str, Any] = field(default_factory=dict)

    @property
    def is_first(self) -> bool:
        return self.position == 0

    @property
    def is_last(self) -> bool:
        return self.position == self.total - 1

    def header(self) -> str:
        return f"{self.position + 1}/{self.total} {self.run.get('_expe_name', '')}"

    def project(self, names: dict[str, str], scope: str | None = None) -> dict[str, Any]:
        """Parameters for a callee: ``scope__name`` first, then the named key, where the run has them."""
        out = {}
        for name, key in names.items():
            for k in ([f"{scope}__{name}"] if scope else []) + [key]:
                if k in self.run:
                    out[name] = self.run[k]
                    break
        return out


class Script(ABC):  # noqa: B024
    """Public methods are actions; hooks run before and after all runs and each run."""

    def before_all(self, contexts: list[RunContext]) -> None: ...  # noqa: B027
    def after_all(self, contexts: list[RunContext]) -> None: ...  # noqa: B027
    def before_each(self, context: RunContext) -> None: ...  # noqa: B027
    def after_each(self, context: RunContext) -> None: ...  # noqa: B027

    @classmethod
    def actions(cls) -> dict[str, Callable]:
        hooks = {"before_all", "after_all", "before_each", "after_each", "actions"}
        return {n: f for n, f in inspect.getmembers(cls, inspect.isfunction) if not n.startswith("_") and n not in hooks}


SCRIPTS: dict[str, type[Script]] = {}
MODELS: dict[str, type[Model]] = {}


def script(cls: type[Script]) -> type[Script]:
    SCRIPTS[cls.__name__.lower()] = cls
    return cls


def find_action(name: str) -> tuple[type[Script], str]:
    """By script name (its first action, or ``script.action``), else by method name."""
    head, _, method = name.lower().partition(".")
    if head in SCRIPTS:
        cls = SCRIPTS[head]
        return cls, method or next(iter(cls.actions()))
    for cls in SCRIPTS.values():
        if name in cls.actions():
            return cls, name
    raise KeyError(f"no script or action {name}")


class Model(ABC):
    """A model of a run: parameters are looked up in the run, then the class, then the default."""

    defaults: dict[str, Any] = {}

    def __init__(self, run: dict[str, Any]):
        self.run = run

    def __init_subclass__(cls, **more: Any):
        super().__init_subclass__(**more)
        MODELS[cls.__name__.lower()] = cls

    def setting(self, name: str, default: Any = None) -> Any:
        for place in (self.run, vars(type(self)), self.defaults):
            if name in place:
                return place[name]
        return default

    @abstractmethod
    def fit(self, data: DataFrame) -> Model: ...

    def transform(self, data: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict(self, data: DataFrame) -> DataFrame:
        return self.transform(data)

    def fit_transform(self, data: DataFrame) -> DataFrame:
        return self.fit(data).transform(data)

    def measure(self, spec: str) -> Any:
        """``name@k=v``: the method compute_<name> with its options, else the attribute."""
        name, _, rest = spec.partition("@")
        options = {k: int(v) if v.lstrip("-").isdigit() else v for k, v in (x.split("=", 1) for x in rest.split("&") if x)}
        options.pop("_freq", None)
        compute = getattr(self, f"compute_{name}", None)
        return compute(**options) if compute else getattr(self, name, None)


def snapshot(model: Any, path: str, purge: tuple[str, ...] = ()) -> None:
    """Saves a model: a fitted Spark pipeline or stage by its writer; any other object's plain attributes (functions and those of ``purge`` go) as JSON rows."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
        return
    plain = {k: v for k, v in vars(model).items() if k not in purge and not callable(v) and not isinstance(v, (DataFrame, SparkSession))}
    spark = SparkSession.getActiveSession()
    rows = [(type(model).__name__.lower(), k, json.dumps(v, default=str)) for k, v in sorted(plain.items())]
    spark.createDataFrame(rows, "model string, attribute string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def alternatives(spark: SparkSession, folder: str) -> list[str]:
    """What is stored in a folder: names a user may have meant."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def load_model(spark: SparkSession, path: str) -> Any:
    """A saved model: a Spark pipeline, or a registered model with its attributes. A missing one is an error that names what its folder holds."""
    folder, _, name = path.rstrip("/").rpartition("/")
    have = alternatives(spark, folder or ".")
    if name not in have:
        raise FileNotFoundError(f"no model {path}; there are: {', '.join(have) or 'none'}")
    if "metadata" in alternatives(spark, path):
        from pyspark.ml import PipelineModel

        return PipelineModel.load(path)
    rows = spark.read.parquet(path).collect()
    cls = MODELS[rows[0]["model"]]
    model = cls.__new__(cls)
    vars(model).update({r["attribute"]: json.loads(r["value"]) for r in rows})
    return model


def model_for(spark: SparkSession, run: dict[str, Any], path: str, load: bool = False) -> Model:
    """The run's model, loaded from its path or built; settings that only the model has (measures, format) come to the run."""
    model = load_model(spark, path) if load else MODELS[str(run["model"]).rsplit(".", 1)[-1].lower()](run)
    for key in ("_measures", "_fmt"):
        if getattr(model, key, None) and not run.get(key):
            run[key] = getattr(model, key)
    return model


def accepts(f: Callable) -> list[str]:
    """Names that a callable takes: what a frontend is passed to."""
    return [p for p in inspect.signature(f).parameters if p != "self"]


def is_abstract(cls: type) -> bool:
    return inspect.isabstract(cls)


def decorated(cls: type, mark: str) -> list[str]:
    """Methods that carry an attribute of this name, as decorators leave it."""
    return sorted(n for n, f in inspect.getmembers(cls, inspect.isfunction) if hasattr(f, mark))


def scan(package: str) -> list[str]:
    """Imports every module of a package, so that its scripts and models register; their names."""
    import importlib
    import pkgutil

    root = importlib.import_module(package)
    found = [package]
    for m in pkgutil.walk_packages(getattr(root, "__path__", []), package + "."):
        importlib.import_module(m.name)
        found.append(m.name)
    return found


class Tracker:
    """Values of measures with their change, evaluated at every k-th call."""

    def __init__(self, model: Model, specs: list[str]):
        self.model, self.specs, self.calls, self.before = model, specs, 0, dict.fromkeys(specs, 0.0)

    def step(self) -> dict[str, tuple[float, float]]:
        out = {}
        for spec in self.specs:
            every = next((int(x[6:]) for x in spec.partition("@")[2].split("&") if x.startswith("_freq=")), 1)
            if self.calls % every == 0:
                value = self.model.measure(spec)
                out[spec] = value, value - self.before[spec]
                self.before[spec] = value
        self.calls += 1
        return out


def seed_of(text: str, repeat: int = 0) -> int:
    """A run's seed from the characters of its seed text and its repeat."""
    return (sum(ord(c) * 31**i for i, c in enumerate(text)) + repeat) % 2**32


def run_all(spark: SparkSession, runs: DataFrame, action: str, *args: Any, error_log: str | None = None) -> tuple[list[Any], list[str]]:
    """Calls an action for each run in order; an error ends its run only. Returns results and error texts.

    Every run is called, with a warning where there are many. Hooks see all contexts, so the driver holds the runs; ``run_distributed`` does not.
    """
    cls, method = find_action(action)
    rows = [r.asDict() for r in runs.orderBy("_expe_id").toLocalIterator()]
    if len(rows) > MANY:
        log.warning("%d runs are called by the driver", len(rows))
    shared: dict[str, Any] = {}
    contexts = [RunContext(spark, row, i, len(rows), shared) for i, row in enumerate(rows)]
    one, results, errors = cls(), [], []
    one.before_all(contexts)
    for context in contexts:
        try:
            one.before_each(context)
            results.append(getattr(one, method)(context, *args))
            one.after_each(context)
        except Exception:
            errors.append(f"{context.run.get('_expe_id')} {action}\n{traceback.format_exc()}")
            if error_log:
                append_bounded(Path(error_log), f"{time.time():.0f} {errors[-1]}")
    one.after_all(contexts)
    return results, errors


def run_distributed(runs: DataFrame, work: Callable[[dict[str, Any]], dict[str, Any]], schema: str, slots: int = 8) -> DataFrame:
    """Runs dealt out over the cluster: plain Python work per run, one result row each; errors come back in the column ``error``."""
    names = [x.split()[0] for x in schema.split(",")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append({"_expe_id": row["_expe_id"], "error": None, **work(row)})
                except Exception as e:
                    rows.append({"_expe_id": row["_expe_id"], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["_expe_id", "error", *names])

    return runs.repartition(slots, "_expe_id").mapInPandas(go, f"_expe_id long, error string, {schema}")


def chunked(n: int, hosts: int) -> list[list[int]]:
    """Run indices in chunks of ceil(n / hosts)."""
    size = max(1, math.ceil(n / hosts))
    return [list(range(i, min(n, i + size))) for i in range(0, n, size)]


def append_bounded(path: Path, text: str, most: int = ERROR_LOG_BYTES) -> None:
    """Appends to a text log; beyond ``most`` bytes its last tenth stays."""
    old = path.read_text() if path.exists() else ""
    if len(old) > most:
        old = old[-len(old) // 10 :]
    path.write_text(old + text + "\n")


def remember(path: Path, command: str, near: int = 10) -> None:
    """Appends a command unless the last ones hold it."""
    old = path.read_text().splitlines() if path.exists() else []
    if command not in old[-near:]:
        path.write_text("\n".join([*old, command]) + "\n")


def history(path: Path, n: int = 42) -> list[str]:
    return path.read_text().splitlines()[-n:] if path.exists() else []


def table(x: str, y: str, how: str = "mean"):
    """An action that returns (x, y, value) rows becomes one that returns the reduced, pivoted table."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def made(*args: Any, **options: Any) -> DataFrame:
            from ..operators.results import REDUCERS, pivot

            return pivot(f(*args, **options), x, y, "value", REDUCERS[how])

        return made

    return wrap


def whole_rows(df: DataFrame, most: int) -> list:
    """All rows of a small result; more than ``most`` are an error, never a cut table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows; ask for more, or write it to a file")
    return rows


def markdown(df: DataFrame, caption: str = "", most: int = 100_000) -> str:
    """A small result as a markdown table."""
    rows = whole_rows(df, most)
    body = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)] + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(([caption, ""] if caption else []) + body)


def latex(df: DataFrame, caption: str = "", most: int = 100_000) -> str:
    rows = whole_rows(df, most)
    body = "\n".join(" & ".join("" if v is None else str(v).replace("_", r"\_") for v in r) + r" \\" for r in [df.columns, *rows])
    return f"\\begin{{table}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body}\n\\end{{tabular}}\n\\caption{{{caption}}}\n\\end{{table}}"


def command_of(run: dict[str, Any], action: str) -> str:
    """The command line that gives one run."""
    flags = " ".join(f"--{k.strip('_')} {json.dumps(v) if isinstance(v, (list, dict)) else v}" for k, v in sorted(run.items()) if v is not None and not k.startswith("_expe"))
    return f"gridloom run {action} {flags}"


def catalogue(spark: SparkSession) -> DataFrame:
    """(kind, name, module, signature, content) of registered scripts' actions and models."""
    rows = [("script", f"{n}.{a}", c.__module__, str(inspect.signature(f)), inspect.getdoc(f) or "") for n, c in SCRIPTS.items() for a, f in c.actions().items()]
    rows += [("model", n, c.__module__, str(inspect.signature(c.__init__)), inspect.getdoc(c) or "") for n, c in MODELS.items()]
    return spark.createDataFrame(rows, "kind string, name string, module string, signature string, content string")


def curve_table(log_rows: DataFrame, value: str = "value") -> DataFrame:
    """(measure, it, mean, std) over runs."""
    return log_rows.groupBy("measure", "it").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
