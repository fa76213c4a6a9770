"""Pipelines of library estimators whose parameters come from a run: scoped, renamed or defaulted by name, as one estimator that can be saved.

A run's key ``name__param`` is the parameter of the stage of that name. ``specMap`` gives a stage's parameter another name in the run, ``defaultSpec`` a value where the run has none.
Stages of ``postTransform`` are fitted and applied to what the fitted pipeline gives, each time that it transforms.
"""

from __future__ import annotations

import importlib
import json
from typing import Any

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters that hold column names, which the chain of stages sets itself.
_INPUTS, _OUTPUTS = ("inputCol", "featuresCol"), ("outputCol", "predictionCol")


def class_of(path: str) -> type:
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def settings_for(cls: type, name: str, run: dict[str, Any], spec_map: dict[str, str] | None = None, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """A stage's parameters: the run's scoped key (under its mapped name), else the default; what the stage does not know is passed over."""
    spec_map, defaults = spec_map or {}, defaults or {}
    scoped = {k.split("__", 1)[1]: v for k, v in run.items() if "__" in k and k.split("__", 1)[0].lower() == name.lower()}
    out = {}
    for p in cls().params:
        key = spec_map.get(p.name, p.name)
        if key in scoped:
            out[p.name] = scoped[key]
        elif p.name in defaults and p.name not in scoped and p.name not in spec_map:
            out[p.name] = defaults[p.name]
    return out


class _Shared(Params):
    """Parameters of the estimator and of its model. Dictionaries are JSON, so that the library's writers can keep them."""

    modules = Param(Params._dummy(), "modules", "class paths of the stages", TypeConverters.toListString)
    names = Param(Params._dummy(), "names", "names of the stages in runs", TypeConverters.toListString)
    run = Param(Params._dummy(), "run", "the run, JSON", TypeConverters.toString)
    specMap = Param(Params._dummy(), "specMap", "names of parameters in runs, JSON", TypeConverters.toString)
    defaultSpec = Param(Params._dummy(), "defaultSpec", "values where a run has none, JSON", TypeConverters.toString)
    postTransform = Param(Params._dummy(), "postTransform", "class paths of stages fitted to the result", TypeConverters.toListString)
    inputCol = Param(Params._dummy(), "inputCol", "column of numbers or vectors that goes in", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column that comes out", TypeConverters.toString)

    def _value(self, param: Param) -> Any:
        value = self.getOrDefault(param)
        return json.loads(value) if param.name in ("run", "specMap", "defaultSpec") else value

    def _stage(self, path: str, name: str, source: str, target: str) -> Any:
        cls = class_of(path)
        stage = cls(**settings_for(cls, name, self._value(self.run), self._value(self.specMap), self._value(self.defaultSpec)))
        have = {p.name for p in stage.params}
        for names, column in ((_INPUTS, source), (_OUTPUTS, target)):
            for n in names:
                if n in have:
                    stage.set(stage.getParam(n), column)
        return stage

    def _vectors(self, data: DataFrame) -> DataFrame:
        """data with the input as a vector in the first column of the chain."""
        column = F.col(self.getOrDefault(self.inputCol))
        kind = dict(data.dtypes)[self.getOrDefault(self.inputCol)]
        return data.withColumn(self._link(0), array_to_vector(column.cast("array<double>")) if kind.startswith("array") else column)

    def _link(self, i: int) -> str:
        return f"__{self.uid}_{i}"


class RunPipeline(Estimator, _Shared, MLReadable, MLWritable):
    """The estimator: ``fit`` gives a ``RunPipelineModel``."""

    def __init__(self, modules: list[str] | None = None, run: dict[str, Any] | None = None, names: list[str] | None = None, specMap: dict[str, str] | None = None, defaultSpec: dict[str, Any] | None = None, postTransform: list[str] | None = None, inputCol: str = "features", outputCol: str = "output"):
        super().__init__()
        modules = modules or []
        names = names or [m.rpartition(".")[2].lower() for m in modules]
        if len(names) != len(modules):
            raise ValueError(f"{len(modules)} stages have {len(names)} names")
        as_json = {"run": run or {}, "specMap": specMap or {}, "defaultSpec": defaultSpec or {}}
        self._set(modules=modules, names=names, postTransform=postTransform or [], inputCol=inputCol, outputCol=outputCol, **{k: json.dumps(v) for k, v in as_json.items()})

    def stages(self) -> list:
        modules, names = self._value(self.modules), self._value(self.names)
        return [self._stage(m, n, self._link(i), self._link(i + 1)) for i, (m, n) in enumerate(zip(modules, names, strict=True))]

    def _fit(self, dataset: DataFrame) -> RunPipelineModel:
        model = RunPipelineModel(Pipeline(stages=self.stages()).fit(self._vectors(dataset)))
        model._resetUid(self.uid)
        return self._copyValues(model)

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class RunPipelineModel(Model, _Shared, MLReadable, MLWritable):
    """A fitted pipeline. Attributes that it lacks are looked up in its last stage (``clusterCenters``, ``pc``, ...)."""

    def __init__(self, pipeline: PipelineModel | None = None):
        super().__init__()
        self.pipeline = pipeline

    def __getattr__(self, name: str) -> Any:
        stages = self.__dict__.get("pipeline")
        if name.startswith("_") or stages is None or not stages.stages:
            raise AttributeError(name)
        return getattr(stages.stages[-1], name)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        data, at = self.pipeline.transform(self._vectors(dataset)), len(self.pipeline.stages)
        for path in self._value(self.postTransform):
            stage = self._stage(path, path.rpartition(".")[2].lower(), self._link(at), self._link(at + 1))
            data, at = (stage if isinstance(stage, Transformer) else stage.fit(data)).transform(data), at + 1
        inner = [self._link(i) for i in range(at)]
        return data.withColumn(self.getOrDefault(self.outputCol), F.col(self._link(at))).drop(*inner, self._link(at))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: RunPipelineModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.pipeline.write().save(f"{path}/stages")


class _ModelReader(MLReader):
    def load(self, path: str) -> RunPipelineModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RunPipelineModel(PipelineModel.load(f"{path}/stages"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
