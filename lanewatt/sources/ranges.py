"""A data source that reads large GeoJSON files by many tasks: partitions are planned by file and byte range."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of what is read at once behind its end for its last feature.
RANGE_BYTES = 8 << 20
TAIL_BYTES = 1 << 16
_HEAD = re.compile(r'"features"\s*:\s*\[')
_BEGUN = re.compile(r'\{\s*"(type"\s*:\s*"Feature"|properties"|geometry")')
_DECODER = json.JSONDecoder()
SCHEMA = "file string, offset long, route string, pm double, longitude double, latitude double, problem string"


@dataclass
class FileRange(InputPartition):
    path: str
    lo: int
    hi: int


def feature_rows(file, size: int, lo: int, hi: int) -> Iterator[tuple[int, dict | str]]:
    """(offset, feature, or text that is no feature) of the features whose brace lies in the bytes [lo, hi) of an open file.

    A feature is an object with ``properties`` and ``geometry``. Within a JSON string quotes are escaped, so no text in one
    parses as such an object: from any byte on, the first brace from which one can be parsed begins the next feature. An
    object that has a feature's first key but can't be parsed, or a file that ends within it, is told as a problem.
    """
    file.seek(lo)
    raw = file.read(max(0, min(hi, size) - lo))
    text, end = raw.decode("latin-1"), lo + len(raw)  # a character a byte, so that places are offsets
    head = None if lo else _HEAD.search(text)
    at = head.end() if head else 0  # past the file's own brace, which all of it would have to be read for
    while (start := text.find("{", at)) >= 0 and lo + start < hi:
        more = TAIL_BYTES
        while True:
            try:
                value, stop = _DECODER.raw_decode(text, start)
                break
            except (json.JSONDecodeError, RecursionError) as error:
                cut = isinstance(error, json.JSONDecodeError) and (error.msg.startswith("Unterminated string") or error.pos >= len(text) - 12)
                if not cut or end >= size:
                    value, stop = error, start + 1
                    break
                raw = file.read(more)
                text, end, more = text + raw.decode("latin-1"), end + len(raw), 2 * more
        if isinstance(value, dict) and "properties" in value and "geometry" in value:
            yield lo + start, json.loads(text[start:stop].encode("latin-1").decode("utf-8", "replace"))
            at = stop
        else:  # an object within a broken feature, or a brace in a text: look inside
            if not isinstance(value, dict) and _BEGUN.match(text, start):
                yield lo + start, str(value)
            at = start + 1


class MarkerReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[FileRange]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [FileRange(f.path, lo, min(lo + self.size, f.size)) for f in sorted(files, key=lambda f: f.path) for lo in range(0, f.size, self.size)]

    def read(self, part: FileRange) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(part.path) as file:
            size = file.size()
            for offset, feature in feature_rows(file, size, part.lo, part.hi):
                yield (part.path, offset, *marker(feature))


def marker(feature: dict | str) -> tuple[str | None, float | None, float | None, float | None, str | None]:
    """(route, pm, longitude, latitude, problem) of a feature; what is missing or no number is null and named."""
    if isinstance(feature, str):
        return None, None, None, None, f"not JSON: {feature}"
    own, shape = feature["properties"], feature["geometry"]
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    place = shape.get("coordinates") if isinstance(shape, dict) else None
    at = [number(x) for x in place[:2]] if isinstance(place, list) and len(place) >= 2 else [None, None]
    route, pm = (own.get("Route"), number(own.get("PM"))) if isinstance(own, dict) else (None, None)
    wrong = [n for n, x in (("Route", route), ("PM", pm), ("coordinates", None if None in at else at)) if x is None]
    return None if route is None else str(route), pm, at[0], at[1], f"no {', '.join(wrong)}" if wrong else None


class MarkerSource(DataSource):
    """Format ``postmile_markers``: a GeoJSON file, or a folder of them, by path or URI; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "postmile_markers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MarkerReader:
        return MarkerReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_marker_features(spark: SparkSession, uri: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a feature, with its file and byte offset; ``problem`` says why a row is no marker, and is null for markers.

    A file is cut into ranges of ``range_bytes``, each a task, whatever its size; a feature belongs to the range in which it
    begins. The URI must be one that pyarrow's file systems open.
    """
    spark.dataSource.register(MarkerSource)
    return spark.read.format("postmile_markers").option("rangeBytes", range_bytes).load(uri)
