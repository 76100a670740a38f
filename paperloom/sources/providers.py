"""Providers outside Spark: language models by route, and readings of page images."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Model = Callable[[Sequence[str]], Sequence[str]]
Reader = Callable[[bytes], tuple[str, float]]


def routed(prompts: DataFrame, mode: str, local_up: bool, cloud_up: bool, text: str = "prompt") -> DataFrame:
    """prompts with route: local, cloud or none. Sensitive prompts are never routed to the cloud, also not if the local model is down."""
    return prompts.withColumn("route", T.route(F.lit(mode), T.sensitive(F.col(text)), F.lit(local_up), F.lit(cloud_up)))


def answers(model: Model, prompts: Sequence[str | None]) -> list[str | None]:
    """The replies to one batch of prompts; null ones have none, and a batch that fails has none at all."""
    asked = [p for p in prompts if p is not None]
    try:
        said = iter(list(model(asked)) if asked else ())
        out = [None if p is None else next(said, None) for p in prompts]
    except (OSError, RuntimeError, ValueError):
        return [None] * len(prompts)
    return out


def ask(prompts: DataFrame, models: dict[str, Model], batch: int = 16, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, route, content): replies of models[route] to the prompts of (keys, prompt, route), in batches of at most `batch` prompts.

    A null prompt, a route without a model and a batch that fails have a null reply, so that the fallback can tell them apart.
    Models are called in the executors; repartition prompts first where calls are slow.
    """

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            out = frame[[*keys, "route"]].copy()
            out["content"] = None
            for route, model in models.items():
                rows = frame.index[(frame["route"] == route) & frame["prompt"].notna()]
                for at in range(0, len(rows), batch):
                    part = rows[at : at + batch]
                    try:
                        out.loc[part, "content"] = list(model(list(frame.loc[part, "prompt"])))
                    except (OSError, RuntimeError, ValueError):
                        continue
            yield out

    kinds = ", ".join(f"`{k}` {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return prompts.select(*keys, "prompt", "route").mapInPandas(run, f"{kinds}, route string, content string")


def read_images(images: DataFrame, readers: dict[str, Reader], enough: float = 0.9) -> DataFrame:
    """(page_id, strategy, text, confidence) of the best reading of each (page_id, content): strategies in order, until one is over `enough`.

    A null image or one that no strategy reads has an empty text and confidence 0. Equal confidences go to the earlier strategy.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for page, content in zip(frame["page_id"], frame["content"], strict=True):
                best = (None, "", 0.0)
                for name, reader in readers.items() if content is not None else ():
                    try:
                        found, sure = reader(bytes(content))
                    except (OSError, RuntimeError, ValueError):
                        continue
                    best = (name, found, sure) if best[0] is None or sure > best[2] else best
                    if best[2] > enough:
                        break
                rows.append((page, *best))
            yield pd.DataFrame(rows, columns=["page_id", "strategy", "text", "confidence"])

    kind = images.schema["page_id"].dataType.simpleString()
    return images.select("page_id", "content").mapInPandas(run, f"page_id {kind}, strategy string, text string, confidence double")
