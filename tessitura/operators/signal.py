"""Operators on samples and detections of one recording at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def cross_faded(parts: list[np.ndarray], overlap: int) -> np.ndarray:
    """Parts one after another; each fades out while the next fades in, over ``overlap`` samples or what they have."""
    if not parts:
        return np.zeros(0)
    lengths = [len(p) for p in parts]
    out, end = np.zeros(sum(lengths)), lengths[0]
    out[:end] = parts[0]
    for part in parts[1:]:
        shared = max(0, min(overlap, end, len(part)))
        ramp = np.linspace(0, 1, shared)
        start = end - shared
        out[start:end] = out[start:end] * (1 - ramp) + part[:shared] * ramp
        out[end : start + len(part)] = part[shared:]
        end = start + len(part)
    return out[:end]


def mixed(signal: np.ndarray, noise: np.ndarray, decibels: float) -> np.ndarray:
    """Signal with noise, repeated or cut to its length, so loud that their powers differ by so much."""
    fitted = np.resize(noise, len(signal))
    power = lambda x: float(np.mean(np.square(x))) if len(x) else 0.0
    if not power(fitted):
        return signal.astype(np.float64)
    return signal + fitted * np.sqrt(power(signal) / power(fitted) / 10 ** (decibels / 10))


def reverberated(signal: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Signal convolved with a room's response of energy 1, cut to its own length."""
    energy = np.sqrt(np.square(response).sum())
    return np.convolve(signal, response / energy)[: len(signal)] if energy else signal.astype(np.float64)


def concatenated(rows: DataFrame, group: str, order: str, samples: str, overlap: int) -> DataFrame:
    """group and samples: a recording's chunks in order, cross-faded."""
    kind = rows.schema[group].dataType.simpleString()

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([(order, "ascending")])
        wave = cross_faded([np.array(x or [], np.float64) for x in data[samples].to_pylist()], overlap)
        return pa.table({group: data[group].slice(0, 1), samples: pa.array([wave.tolist()], pa.list_(pa.float64()))})

    return rows.select(group, order, samples).groupBy(group).applyInArrow(run, f"`{group}` {kind}, `{samples}` array<double>")


def linked(frames: np.ndarray, boxes: np.ndarray, gap: int, least: float = 0.5) -> np.ndarray:
    """The track of each detection, given by frame: a track starts with the first that is free, and in every later frame takes the first free one that overlaps its last by over ``least``, until none came for ``gap`` frames."""
    track = np.full(len(frames), -1)
    bounds = np.searchsorted(frames, np.unique(frames)).tolist() + [len(frames)]
    number = 0
    while (track < 0).any():
        last = int(np.argmax(track < 0))
        track[last] = number
        for a, b in zip(bounds, bounds[1:], strict=False):
            if frames[a] <= frames[last]:
                continue
            if frames[a] - frames[last] > gap:
                break
            free = a + np.flatnonzero(track[a:b] < 0)
            low, high = np.maximum(boxes[free, :2], boxes[last, :2]), np.minimum(boxes[free, 2:], boxes[last, 2:])
            area = lambda x: np.maximum(x[..., 2:] - x[..., :2], 0).prod(axis=-1)
            both = np.maximum(high - low, 0).prod(axis=1)
            near = free[both > least * (area(boxes[free]) + area(boxes[last]) - both)]
            if len(near):
                last = int(near[0])
                track[last] = number
        number += 1
    return track


def tracks(faces: DataFrame, group: str, gap: int, least: float = 0.5) -> DataFrame:
    """Detections (group, frame, id, left, top, right, bottom) with their ``track``; a shot is the unit of work."""
    fields = {f.name: f.dataType.simpleString() for f in faces.schema.fields}
    sides = ["left", "top", "right", "bottom"]

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([("frame", "ascending"), ("id", "ascending")])
        boxes = np.stack([data[c].to_numpy().astype(np.float64) for c in sides], axis=1)
        found = linked(data["frame"].to_numpy(), boxes, gap, least)
        return data.select([group, "frame", "id"]).append_column("track", pa.array(found.astype(np.int32)))

    return faces.select(group, "frame", "id", *sides).groupBy(group).applyInArrow(run, f"`{group}` {fields[group]}, frame {fields['frame']}, id {fields['id']}, track int")
