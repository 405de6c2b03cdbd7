"""Columns from file names, paths and free text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_token(path: Column, tokens: Mapping[str, str], default: str | None) -> Column:
    """The value of the first of the tokens that is a part of the path, letters' case aside."""
    parts = F.split(F.lower(path), r"[/\\_.\-]")
    out = F.lit(default)
    for token, value in reversed(list(tokens.items())):
        out = F.when(F.array_contains(parts, token), value).otherwise(out)
    return out


def split_of(path: Column) -> Column:
    return first_token(path, {"training": "train", "train": "train", "validation": "val", "valid": "val", "val": "val", "test": "test"}, "unknown")


def kind_of(path: Column) -> Column:
    return first_token(path, {"breathing": "breathing", "breath": "breathing", "temperature": "temperature", "temp": "temperature", "feeding": "feeding", "feed": "feeding"}, "other")


def housing(activity: Column) -> Column:
    """Pair where the text says so, else Isolation."""
    return F.when(F.contains(F.lower(F.coalesce(activity, F.lit(""))), F.lit("pair")), "Pair").otherwise("Isolation")


def image_parts(name: Column) -> dict[str, Column]:
    """Farm, channel, hour, clip and frame of names such as F01_CH02_2023010510_0003_00017.jpg."""
    pattern = r"^([A-Za-z0-9]+)_CH(\d+)_(\d{10})_(\d+)_(\d+)\."
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return {"farm_id": part(1), "channel": part(2).try_cast("long"), "hour": F.try_to_timestamp(part(3), F.lit("yyyyMMddHH")).cast("timestamp_ntz"), "clip": part(4).try_cast("long"), "frame": part(5).try_cast("long")}


def frame_time(hour: Column, frame: Column, fps: float = 30.0) -> Column:
    return hour + F.make_dt_interval(secs=(frame / F.lit(fps)).cast("decimal(18,6)"))
