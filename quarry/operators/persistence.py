"""Writers and readers for models whose fitted state is data frames, other models or numbers.

A stored model is a folder as Spark ML lays it out: ``metadata`` (class, uid, params and the plain
values of the state), and beside it ``frames/<name>`` as Parquet and ``models/<name>``, each written
by its own writer. :class:`StoredModel` subclasses say what their state is; they work as stages of a
``PipelineModel``, too. :func:`load` reads any of them by the class named in the metadata.

Frames are written by the executors and read back lazily, so the state never passes the driver; only
the plain values do (one number per column or model).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


class StoredModel(Model, MLWritable, MLReadable):
    """A model that names its state: :meth:`state` and :meth:`from_state` are inverses."""

    def state(self) -> tuple[dict, dict[str, DataFrame], dict[str, Model]]:
        """(plain values, frames, models)"""
        raise NotImplementedError

    @classmethod
    def from_state(cls, values: dict, frames: dict[str, DataFrame], models: dict[str, Model]) -> StoredModel:
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _StateWriter(MLWriter):
    def __init__(self, model: StoredModel):
        super().__init__()
        self.model = model

    def save(self, path: str) -> None:
        _, frames, _ = self.model.state()
        here = _plain_path(path)
        for name, frame in frames.items():
            if any(f.startswith(f"{here}/") for f in map(_plain_path, frame.inputFiles())):
                raise ValueError(f"frame {name!r} is read from {path}, which cannot be overwritten by itself")
        super().save(path)

    def saveImpl(self, path: str) -> None:
        values, frames, models = self.model.state()
        names = {"values": values, "frames": list(frames), "models": list(models)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": names})
        for name, frame in frames.items():
            frame.write.parquet(f"{path}/frames/{name}")
        for name, model in models.items():
            model.write().save(f"{path}/models/{name}")


class _StateReader(MLReader):
    def __init__(self, cls: type[StoredModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> StoredModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        named = metadata["state"]
        model = self.cls.from_state(
            named["values"],
            {x: spark.read.parquet(f"{path}/frames/{x}") for x in named["frames"]},
            {x: DefaultParamsReader.loadParamsInstance(f"{path}/models/{x}", spark) for x in named["models"]})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class ModelSet(StoredModel, Mapping):
    """Named models kept together, as a weighted average of them needs; reads like a dict."""

    def __init__(self, models: dict[str, Model]):
        super().__init__()
        self.models = dict(models)

    def __getitem__(self, name: str) -> Model:
        return self.models[name]

    def __iter__(self):
        return iter(self.models)

    def __len__(self) -> int:
        return len(self.models)

    def state(self):
        # Numbered folders: a model's name may hold any character.
        return {"names": list(self.models)}, {}, {str(i): m for i, m in enumerate(self.models.values())}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls({name: models[str(i)] for i, name in enumerate(values["names"])})

    def _transform(self, df: DataFrame) -> DataFrame:
        raise TypeError("a set of models has no transform of its own: see weighted_average_predict")


def _plain_path(path: str) -> str:
    """One spelling of file:/x, file:///x and /x."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path.rstrip("/")


def save(model, path: str, overwrite: bool = True) -> None:
    """Store any fitted model of this library, an MLlib model or a dict of models under ``path``."""
    model = ModelSet(model) if isinstance(model, dict) else model
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load(path: str, spark: SparkSession | None = None):
    """The model stored under ``path``, of whatever class."""
    return DefaultParamsReader.loadParamsInstance(path, spark or SparkSession.active())


def class_of(path: str, spark: SparkSession | None = None) -> str:
    """Name of the class of the model stored under ``path``, from its metadata alone."""
    return DefaultParamsReader.loadMetadata(path, spark or SparkSession.active())["class"]


def frame_of_trees(spark: SparkSession, trees: list[dict]) -> DataFrame:
    """(tree, node, feature, threshold, left, right, size) of array-encoded trees: at most a few
    hundred nodes a tree."""
    rows = [(t, i, int(x["f"][i]), float(x["t"][i]), int(x["l"][i]), int(x["r"][i]), int(x["s"][i]))
            for t, x in enumerate(trees) for i in range(len(x["f"]))]
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, size int")


def trees_of_frame(frame: DataFrame) -> list[dict]:
    rows = sorted(frame.collect(), key=lambda r: (r["tree"], r["node"]))  # a forest is a bounded table
    trees: list[dict] = []
    for r in rows:
        if r["tree"] == len(trees):
            trees.append({"f": [], "t": [], "l": [], "r": [], "s": []})
        for k, name in (("f", "feature"), ("t", "threshold"), ("l", "left"), ("r", "right"), ("s", "size")):
            trees[-1][k].append(r[name])
    return trees


__all__ = ["ModelSet", "StoredModel", "class_of", "frame_of_trees", "load", "save", "trees_of_frame"]
