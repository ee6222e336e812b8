"""Which reader opens a file: by its last extension; readers and backends of the user come first."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePath

from pyspark.sql import SparkSession

from ..wave import Wave
from .fst import fst_wave
from .plugin import Backend, MissingBackend, found, plugin_wave
from .vcd import vcd_wave

Reader = Callable[[SparkSession, str], Wave]
_BUILT_IN: dict[str, Reader] = {"vcd": vcd_wave, "fst": fst_wave, "": vcd_wave, "parquet": lambda spark, path: Wave.load(spark, path)}
_USER: dict[str, Reader] = {}


def register(extension: str, reader: Reader) -> None:
    """``reader(spark, path)`` opens files with this extension from now on, in place of any other."""
    _USER[extension.lower().lstrip(".")] = reader


def register_backend(backend: type[Backend]) -> None:
    """Files with the extension ``backend.name`` are read by this class."""
    register(backend.name, lambda spark, path: plugin_wave(spark, path, backend))


def unregister(extension: str) -> None:
    _USER.pop(extension.lower().lstrip("."), None)


def open_wave(spark: SparkSession, path: str) -> Wave:
    """The wave in a file: by a registered reader, a backend that the environment names, or a built-in reader."""
    extension = PurePath(path).suffix.lower().lstrip(".")
    if reader := _USER.get(extension):
        return reader(spark, path)
    if extension and (backend := found(extension)):
        return plugin_wave(spark, path, backend)
    if reader := _BUILT_IN.get(extension):
        return reader(spark, path)
    raise MissingBackend(extension)
