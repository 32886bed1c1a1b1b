"""Sinks: equations as text (S8), network weights as a binary file (S7), tables as parquet."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import poly

#: Fixed values of the weights format: the activations' numbers, and the header after the magic bytes (version, layers,
#: hidden width, activation, centre, scale).
ACTIVATIONS = {"relu": 0, "tanh": 1, "sine": 2}
HEADER = struct.Struct("<BBHB3ff")


def equation_text(terms: Mapping[poly.Powers, float]) -> list[str]:
    """The polynomial and its three partial derivatives, a line each."""
    def line(t: Mapping[poly.Powers, float]) -> str:
        return " + ".join(f"{c!r}" + "".join(f"*x{i}**{n}" if n > 1 else f"*x{i}" for i, n in enumerate(e) if n) for e, c in sorted(t.items())) or "0"

    return [line(terms), *(line(poly.derivative(terms, i)) for i in range(3))]


def write_equation(spark: SparkSession, terms: Mapping[poly.Powers, float], path: str) -> None:
    spark.createDataFrame([(x,) for x in equation_text(terms)], "value string").coalesce(1).write.mode("overwrite").text(path)


def weights_bytes(layers: Sequence[tuple[np.ndarray, np.ndarray]], activation: str, center: Sequence[float], scale: float, magic: bytes = b"VXNET") -> bytes:
    """Magic and header, then of each layer rows, columns, weights by row, and a bias for each row."""
    hidden = layers[0][0].shape[0]
    out = [magic, HEADER.pack(1, len(layers) - 1, hidden, ACTIVATIONS[activation], *center, scale)]
    for w, b in layers:
        out += [struct.pack("<HH", *w.shape), w.astype("<f4").tobytes(), b.astype("<f4").tobytes()]
    return b"".join(out)


def read_weights(data: bytes, magic: bytes = b"VXNET") -> tuple[list[tuple[np.ndarray, np.ndarray]], str, list[float], float]:
    """(layers, activation, centre, scale) of weights_bytes()."""
    if data[: len(magic)] != magic:
        raise ValueError("not a weights file")
    version, n, _, act, *frame = HEADER.unpack_from(data, len(magic))
    if version != 1:
        raise ValueError(f"weights of version {version}")
    at, layers = len(magic) + HEADER.size, []
    while at < len(data):
        rows, cols = struct.unpack_from("<HH", data, at)
        w = np.frombuffer(data, "<f4", rows * cols, at + 4).reshape(rows, cols)
        b = np.frombuffer(data, "<f4", rows, at + 4 + 4 * rows * cols)
        layers.append((w, b))
        at += 4 + 4 * rows * (cols + 1)
    return layers, next(k for k, v in ACTIVATIONS.items() if v == act), list(frame[:3]), frame[3]


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
