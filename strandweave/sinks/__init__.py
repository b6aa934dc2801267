"""Writers by format name."""

from __future__ import annotations

from collections.abc import Callable

from strandweave.sinks import exports


class UnknownFormatError(ValueError):
    """A format that no writer is registered for."""


_WRITERS: dict[str, Callable] = {}


def register_writer(name: str, writer: Callable) -> None:
    """``writer(graph, path, overwrite, **options)``"""
    _WRITERS[name.lower()] = writer


def get_writer(name: str) -> Callable:
    if name.lower() not in _WRITERS:
        raise UnknownFormatError(f"unknown format {name!r}; known: {', '.join(list_formats())}")
    return _WRITERS[name.lower()]


def list_formats() -> list[str]:
    return sorted(_WRITERS)


def write(g, path: str, format: str | None = None, overwrite: bool = False, **options) -> str:
    """Writes a graph; without a format the path's ending names it, CSV where it has none."""
    ending = path.rstrip("/").rpartition("/")[2].rpartition(".")
    name = format or (ending[2] if ending[0] else "csv")
    get_writer({"txt": "text"}.get(name, name))(g, path, overwrite, **options)
    return path


register_writer("csv", exports.write_csv)
register_writer("graphml", exports.write_graphml)
register_writer("text", exports.write_text)
register_writer("parquet", exports.write_parquet)
