"""Frames -> latents through a pluggable encoder, and latents -> patch rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Encoder(Protocol):
    def encode(self, images: list[bytes]) -> np.ndarray: ...


def encode_frames(frames: DataFrame, encoder: Callable[[], Encoder], image: str = "image") -> DataFrame:
    """(episode, step, image) -> (episode, step, embedding, shape): one encoder per partition,
    one call per Arrow batch. An embedding is stored flat with its shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encoder()
        for batch in batches:
            if not len(batch):
                continue
            block = np.asarray(made.encode(list(batch[image])), dtype=np.float32)
            yield pd.DataFrame(
                {
                    "episode": batch["episode"].to_numpy(),
                    "step": batch["step"].to_numpy(),
                    "embedding": list(block.reshape(len(batch), -1)),
                    "shape": [list(block.shape[1:])] * len(batch),
                }
            )

    types = dict(frames.dtypes)
    schema = f"episode {types['episode']}, step {types['step']}, embedding array<float>, shape array<int>"
    return frames.select("episode", "step", image).mapInPandas(run, schema)


def patch_rows(latents: DataFrame, rows: int, cols: int) -> DataFrame:
    """Grid (rows, cols, dim) latents as one row per patch: (episode, step, row, col, vec)."""
    patches = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    size = F.floor(F.size("embedding") / (rows * cols)).cast("int")
    p = latents.withColumn("_size", size).select("*", F.explode(patches).alias("_p"))
    return p.select(
        "episode",
        "step",
        F.floor(F.col("_p") / cols).cast("int").alias("row"),
        (F.col("_p") % cols).cast("int").alias("col"),
        F.slice("embedding", F.col("_p") * F.col("_size") + 1, F.col("_size")).alias("vec"),
    )
