"""Vectors from an embedding client that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingError
from .log import Versioned


def embed_texts(client: Callable[[list[str]], list[list[float]]], texts: list[str], batch_size: int = 64) -> list[list[float]]:
    """One vector for each text, in order; all of one size above zero."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    out: list[list[float]] = []
    for k in range(0, len(texts), batch_size):
        try:
            out += client(texts[k : k + batch_size])
        except Exception as e:
            raise EmbeddingError("the client failed") from e
    if len(out) != len(texts) or texts and (len({len(v) for v in out}) != 1 or not out[0]):
        raise EmbeddingError("the client must give each text a vector, all of one size above zero")
    return out


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch_size: int = 64, text: str = "text", profile: ResourceProfile | None = None) -> DataFrame:
    """``rows`` with ``embedding``; the client is made once a task, and only if it has texts. A null text has none. With a
    ``profile``, the stage that calls the client asks for its resources, such as a GPU for each task."""
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for frame in frames:
            told = frame[text].notna()
            if client is None and told.any():
                client = load()
            vectors = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            if told.any():
                vectors[told] = pd.Series(embed_texts(client, list(frame.loc[told, text]), batch_size), index=frame.index[told], dtype=object)
            yield frame.assign(embedding=vectors)

    return rows.mapInPandas(run, f"{kinds}, embedding array<float>", profile=profile)


class EmbeddingCache(Versioned):
    """Vectors by the SHA-256 of their text and the model's name, so that no text is sent to a model twice.

    ``embedded`` sends the distinct texts that the model has no vector for, those of like length together, and writes their
    vectors before it reads any: what has been written once is not sent again after a restart. Two runs at once may send
    one text both; either vector then counts once.
    """

    KINDS = "key binary, embedding array<float>"

    def _known(self, model: str) -> DataFrame:
        folder = f"model={folder_name(model)}"
        if not self._list(folder):
            return self.spark.createDataFrame([], self.KINDS)
        return self.spark.read.schema(self.KINDS).parquet(f"{self.root}/{folder}")

    def embedded(self, rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, batch_size: int = 64, text: str = "text", profile: ResourceProfile | None = None) -> DataFrame:
        """``rows`` with ``embedding``; a null text has none."""
        key = F.unhex(F.sha2(F.col(text), 256))
        texts = rows.where(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        fresh = texts.join(self._known(model), "key", "left_anti").repartition("key").sortWithinPartitions(F.length("text"))
        embedded(fresh, load, batch_size, profile=profile).select("key", "embedding").write.mode("append").parquet(f"{self.root}/model={folder_name(model)}")
        known = self._known(model).dropDuplicates(["key"]).withColumnRenamed("key", "_key")
        return rows.join(known, key == F.col("_key"), "left").drop("_key")


def folder_name(name: str) -> str:
    """A model's name as a folder's."""
    return name.encode().hex()
