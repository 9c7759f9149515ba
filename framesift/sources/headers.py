"""Sizes of images from their headers: a Spark data source that reads a few ranges of each file.

Files are listed once, on the driver, and dealt out by count; a task opens its files one after the other and walks
markers (JPEG), chunks (PNG, WebP), directories (TIFF) or a fixed header (BMP) until it knows the size. What lies between is skipped, not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framesift.sources.files import EXTENSIONS
from framesift.sources.store import uri

#: Bytes of a ranged read, and images of a partition.
RANGE, FILES = 512, 2000
SCHEMA = "path string, rel string, size long, kind string, w long, h long, bytes_read long, error string"


class Ranges:
    """A file as bytes at places; ranges are read when they are asked for, and kept."""

    def __init__(self, file, size: int) -> None:  # noqa: ANN001
        self.file, self.size, self.read = file, size, 0
        self.kept: dict[int, bytes] = {}

    def at(self, place: int, n: int) -> bytes:
        """n bytes at a place; an error beyond the end."""
        if place < 0 or place + n > self.size:
            raise ValueError("the file ends within its header")
        out = b""
        while len(out) < n:
            number, skip = divmod(place + len(out), RANGE)
            if number not in self.kept:
                self.file.seek(number * RANGE)
                self.kept[number] = self.file.read(RANGE)
                self.read += len(self.kept[number])
            out += self.kept[number][skip : skip + n - len(out)]
        return out

    def number(self, place: int, form: str) -> int:
        return struct.unpack(form, self.at(place, struct.calcsize(form)))[0]


def _png(r: Ranges) -> tuple[int, int]:
    if r.at(12, 4) != b"IHDR":
        raise ValueError("no IHDR chunk")
    return r.number(16, ">I"), r.number(20, ">I")


def _jpeg(r: Ranges) -> tuple[int, int]:
    """Marker by marker to the frame header; those without a length are skipped."""
    place = 2
    while True:
        if r.at(place, 1) != b"\xff":
            raise ValueError("no marker where one should be")
        kind = r.number(place + 1, ">B")
        if kind == 0xFF:  # a fill byte
            place += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            place += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return r.number(place + 7, ">H"), r.number(place + 5, ">H")
        elif kind in (0xD9, 0xDA):
            raise ValueError("no frame header before the image data")
        else:
            place += 2 + r.number(place + 2, ">H")


def _webp(r: Ranges) -> tuple[int, int]:
    kind = r.at(12, 4)
    if kind == b"VP8X":
        low, high = r.at(24, 3), r.at(27, 3)
        return int.from_bytes(low, "little") + 1, int.from_bytes(high, "little") + 1
    if kind == b"VP8L":
        if r.at(20, 1) != b"\x2f":
            raise ValueError("no lossless image")
        bits = r.number(21, "<I")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 ":
        if r.at(23, 3) != b"\x9d\x01\x2a":
            raise ValueError("no key frame")
        return r.number(26, "<H") & 0x3FFF, r.number(28, "<H") & 0x3FFF
    raise ValueError("no image chunk")


def _tiff(r: Ranges) -> tuple[int, int]:
    """The first directory, wherever it is; widths and heights are of 16 or 32 bits."""
    order = "<" if r.at(0, 2) == b"II" else ">"
    place = r.number(4, f"{order}I")
    found: dict[int, int] = {}
    for i in range(r.number(place, f"{order}H")):
        entry = place + 2 + 12 * i
        tag, form = r.number(entry, f"{order}H"), r.number(entry + 2, f"{order}H")
        if tag in (256, 257):
            found[tag] = r.number(entry + 8, f"{order}{'H' if form == 3 else 'I'}")
        if len(found) == 2:
            return found[256], found[257]
    raise ValueError("a directory without a size")


def _bmp(r: Ranges) -> tuple[int, int]:
    if r.number(14, "<I") == 12:
        return r.number(18, "<H"), r.number(20, "<H")
    return abs(r.number(18, "<i")), abs(r.number(22, "<i"))


def header(r: Ranges) -> tuple[str, int, int]:
    """Kind, width and height of an image, by its first bytes, whatever its name says."""
    first = r.at(0, min(12, r.size))
    if first.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png", *_png(r)
    if first.startswith(b"\xff\xd8"):
        return "jpeg", *_jpeg(r)
    if first[:4] == b"RIFF" and first[8:12] == b"WEBP":
        return "webp", *_webp(r)
    if first[:4] in (b"II*\0", b"MM\0*"):
        return "tiff", *_tiff(r)
    if first[:2] == b"BM":
        return "bmp", *_bmp(r)
    raise ValueError("no image that is known here")


class Part(InputPartition):
    def __init__(self, root: str, files: list[tuple[str, int]]) -> None:
        self.root, self.files = root, files


class HeaderReader(DataSourceReader):
    def __init__(self, root: str, files: int) -> None:
        self.root, self.files = root, files

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri(self.root))
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        images = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.extension.lower() in EXTENSIONS)
        return [Part(root, images[i : i + self.files]) for i in range(0, len(images), self.files)] or [Part(root, [])]

    def read(self, part: Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri(self.root))
        for path, size in part.files:
            rel = path.removeprefix(part.root.rstrip("/") + "/")
            ranges = None
            try:
                with store.open_input_file(path) as file:
                    ranges = Ranges(file, size)
                    yield path, rel, size, *header(ranges), ranges.read, None
            except (OSError, ValueError, struct.error) as e:  # a row with an error, not a failed job
                yield path, rel, size, None, None, None, ranges.read if ranges else 0, str(e)[:200]


class HeaderSource(DataSource):
    """spark.read.format("image_headers").load(folder): SCHEMA of all images below a folder; option `files` is how many a task gets."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:  # noqa: ANN001
        return HeaderReader(self.options["path"], int(self.options.get("files", FILES)))


def image_headers(spark: SparkSession, root: str, files: int = FILES) -> DataFrame:
    """SCHEMA of all images below root. A file that can't be read, or that is no image of a kind known here, has an error and no size; an empty or missing folder gives no row."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("image_headers").option("files", files).load(root)
