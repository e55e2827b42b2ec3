from __future__ import annotations

import uuid
from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession


@pytest.fixture
def tables(spark: SparkSession, tmp_path) -> Callable[..., str]:
    """Writes frames as ``<name>.parquet`` into a fresh folder and returns it."""

    def write(**frames: DataFrame) -> str:
        folder = tmp_path / uuid.uuid4().hex
        for name, frame in frames.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
