"""What a camera wrote into a picture's header: time, orientation, exposure."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "taken string, orientation int, make string, model string, exposure double, aperture double, iso int, focal_length double"

# Numbers of tags, and sizes of the types of their values.
ORIENTATION, DATE, MAKE, MODEL, MORE = 0x0112, 0x0132, 0x010F, 0x0110, 0x8769
EXPOSURE, APERTURE, ISO, TAKEN, PARTS_OF_SECOND, FOCAL_LENGTH = 0x829A, 0x829D, 0x8827, 0x9003, 0x9291, 0x920A
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NUMBERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: By the mark of the order of bytes: an offset, a number of entries, an entry's head, and numbers and fractions by type.
ORDERS = {
    mark: (struct.Struct(o + "I"), struct.Struct(o + "H"), struct.Struct(o + "HHI"), {k: struct.Struct(o + c) for k, c in NUMBERS.items()}, {5: struct.Struct(o + "II"), 10: struct.Struct(o + "ii")})
    for mark, o in ((b"II", "<"), (b"MM", ">"))
}
PLAIN = re.compile(r"([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})")
#: Bytes of a value that are read at most; longer ones are no part of a header that is of use here.
VALUE = 1 << 10


def block(data: bytes) -> bytes | None:
    """The TIFF structure within the first bytes of a JPEG, PNG or TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if kind == 0xFF:
                at += 1  # filling
                continue
            if kind == 0xDA:
                return None  # pixels begin
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + max(size, 2)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def fields(tiff: bytes) -> dict[int, object]:
    """The values of the first directory and of the one that it points to; what is broken is left out."""
    order = ORDERS.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}
    offset, number, head, numbers, fractions = order
    out: dict[int, object] = {}
    waiting, seen = [offset.unpack_from(tiff, 4)[0]], set()
    while waiting:
        at = waiting.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(number.unpack_from(tiff, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(tiff):
                break
            tag, kind, count = head.unpack_from(tiff, entry)
            size = SIZES.get(kind, 0) * count
            if not 0 < size <= VALUE:
                continue
            place = entry + 8 if size <= 4 else offset.unpack_from(tiff, entry + 8)[0]
            raw = tiff[place : place + size]
            if len(raw) < size:
                continue
            if kind == 2:
                value: object = raw.split(b"\0")[0].decode("latin-1").strip() or None
            elif kind in fractions:
                above, below = fractions[kind].unpack_from(raw)
                value = above / below if below else None
            elif kind in numbers:
                value = numbers[kind].unpack_from(raw)[0]
            else:
                value = None
            if tag == MORE and isinstance(value, int):
                waiting.append(value)
            elif value is not None:
                out.setdefault(tag, value)
    return out


def _time(text: object, parts: object) -> str | None:
    """A time as ``year-month-day hour:minute:second``; null where there is no such time."""
    if text is None:
        return None
    plain = PLAIN.fullmatch(str(text)[:19])
    try:
        # other spellings, as with single digits, are rare and take longer
        found = datetime(*map(int, plain.groups())) if plain else datetime.strptime(str(text)[:19], "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None
    digits = str(parts or "").strip()
    return found.isoformat(" ") + (f".{digits[:6]}" if digits.isascii() and digits.isdigit() else "")


def header(data: bytes | None) -> tuple:
    """:data:`HEADER` of a file's first bytes; null for what is not there or cannot be read."""
    tags = fields(block(data or b"") or b"")
    number = lambda tag, kind: kind(tags[tag]) if isinstance(tags.get(tag), (int, float)) else None
    text = lambda tag: tags[tag] if isinstance(tags.get(tag), str) else None
    turned = number(ORIENTATION, int)
    taken = _time(tags.get(TAKEN), tags.get(PARTS_OF_SECOND)) or _time(tags.get(DATE), None)
    return taken, turned if turned in range(1, 9) else None, text(MAKE), text(MODEL), number(EXPOSURE, float), number(APERTURE, float), number(ISO, int), number(FOCAL_LENGTH, float)


def headers(files: DataFrame, key: str, content: Column, prefix: int) -> DataFrame:
    """``key`` and :data:`HEADER` of every file, from the first ``prefix`` bytes alone.

    ``taken`` becomes a timestamp without a zone, as cameras write it. A broken header gives nulls.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
        for batch in batches:
            rows = [header(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [key, *(c.split()[0] for c in HEADER.split(", "))])

    kind = files.schema[key].dataType.simpleString()
    found = files.select(key, F.substring(content, 1, prefix).alias("content")).mapInArrow(read, f"{key} {kind}, {HEADER}")
    return found.withColumn("taken", F.col("taken").cast("timestamp_ntz"))
