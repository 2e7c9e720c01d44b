"""Page classification: a pluggable model in a pandas function, and formatted predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prediction(probabilities: Column, names: Sequence[str], threshold: float = 0.5, needs_image: Sequence[str] = ()) -> Column:
    """struct of needs_image_embedding, predicted_classes (at the threshold or above) and probabilities by class."""
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), probabilities.alias("p"))
    hit = F.transform(F.filter(pairs, lambda x: x["p"] >= threshold), lambda x: x["name"])
    needed = F.exists(hit, lambda c: c.isin(list(needs_image))) if needs_image else F.lit(False)
    return F.struct(needed.alias("needs_image_embedding"), hit.alias("predicted_classes"), F.map_from_arrays(F.array(*map(F.lit, names)), probabilities).alias("probabilities"))


def preprocess(images: np.ndarray, size: tuple[int, int], mean: Sequence[float], std: Sequence[float], center_crop: bool = True, whiteout: float | None = None) -> np.ndarray:
    """Batches of height x width x RGB bytes to scaled, normalised channel-first floats."""
    n, h, w, _ = images.shape
    if center_crop and h != w:
        k = min(h, w)
        images = images[:, (h - k) // 2 : (h - k) // 2 + k, (w - k) // 2 : (w - k) // 2 + k]
        h = w = k
    ys = np.clip(((np.arange(size[0]) + 0.5) * h / size[0] - 0.5).round().astype(int), 0, h - 1)
    xs = np.clip(((np.arange(size[1]) + 0.5) * w / size[1] - 0.5).round().astype(int), 0, w - 1)
    x = images[:, ys][:, :, xs].astype(np.float32) / 255
    if whiteout:
        x[:, : int(size[0] * whiteout)] = 1.0
    return ((x - np.float32(mean)) / np.float32(std)).transpose(0, 3, 1, 2)


def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader of an ONNX model, for classify(); each worker loads it once."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0]

    return load


def classify(pages: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], size: tuple[int, int], names: Sequence[str], mean: Sequence[float] = (0.5, 0.5, 0.5), std: Sequence[float] = (0.5, 0.5, 0.5), threshold: float = 0.5, needs_image: Sequence[str] = (), batch: int = 32) -> DataFrame:
    """pages: doc_id, page, height, width, image (RGB bytes) -> doc_id, page, prediction."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                x = np.concatenate([preprocess(np.frombuffer(b, np.uint8).reshape(1, h, w, 3), size, mean, std) for b, h, w in zip(part["image"], part["height"], part["width"], strict=True)])
                yield pd.DataFrame({"doc_id": part["doc_id"], "page": part["page"], "p": [list(map(float, r)) for r in model(x)]})

    got = pages.select("doc_id", "page", "height", "width", "image").mapInPandas(run, "doc_id long, page int, p array<double>")
    return got.select("doc_id", "page", prediction(F.col("p"), names, threshold, needs_image).alias("prediction"))


def pages_to_embed(predictions: DataFrame) -> DataFrame:
    return predictions.where("prediction.needs_image_embedding").select("doc_id", "page")
