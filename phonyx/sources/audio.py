"""Wave files: what their headers say, and levels of short frames of 16-bit samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The level of silence, in dB below full scale.
SILENCE_DB = -100.0


def wave_parts(content: memoryview) -> tuple[int, int, int, int, int]:
    """(channels, rate, bits, first byte of the samples, bytes of samples) of a RIFF file, chunk by chunk; an error if it is none."""
    if bytes(content[:4]) != b"RIFF" or bytes(content[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = bytes(content[at : at + 4]), int.from_bytes(content[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = (int.from_bytes(content[at + 10 : at + 12], "little"), int.from_bytes(content[at + 12 : at + 16], "little"), int.from_bytes(content[at + 22 : at + 24], "little"))
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            # A size beyond the file's end stands for all that is there.
            return (*form, at + 8, min(size, len(content) - at - 8))
        at += 8 + size + size % 2
    raise ValueError("no samples")


def frame_levels(samples: np.ndarray, frame: int) -> np.ndarray:
    """Level of each whole frame in dB below full scale."""
    whole = samples[: len(samples) // frame * frame].reshape(-1, frame).astype(np.float64) / 32768
    power = (whole * whole).mean(1)
    return np.maximum(10 * np.log10(np.maximum(power, 1e-30)), SILENCE_DB)


def wave_levels(spark: SparkSession, path: str, frame_s: float = 0.02) -> DataFrame:
    """(path, rate, channels, frame, level): levels of 16-bit wave files, channels averaged; a task reads one file at a time.

    A file that is no 16-bit wave file is an error that names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                view = memoryview(content.as_buffer())
                try:
                    channels, rate, bits, first, size = wave_parts(view)
                    if bits != 16:
                        raise ValueError(f"{bits} bits a sample")
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from None
                samples = np.frombuffer(view[first : first + size // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(1)
                level = frame_levels(samples, max(1, round(frame_s * rate)))
                n = len(level)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([rate] * n, pa.int32()), pa.array([channels] * n, pa.int32()), pa.array(np.arange(n)), pa.array(level)], ["path", "rate", "channels", "frame", "level"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, rate int, channels int, frame long, level double")
