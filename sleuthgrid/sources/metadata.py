"""What files say about their making: images (EXIF, PNG text), office documents and PDFs, read by bounded walks over their bytes.

Files are untrusted. Every offset and length is checked against the file, no directory is read twice, what is inflated is
limited, and XML with a document type isn't read. A file that can't be read keeps its row, with a note.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of image file directories, sizes of their types, fields of documents.
IMAGE_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright"}
CAMERA_TAGS = {0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9286: "UserComment", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel"}
PLACE_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 6: "GPSAltitude", 29: "GPSDateStamp"}
CAMERA, PLACE = 0x8769, 0x8825
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CORE = {
    "creator": "Author", "lastModifiedBy": "LastModifiedBy", "title": "Title", "subject": "Subject", "description": "Description", "keywords": "Keywords", "category": "Category", "created": "Created", "modified": "Modified",
    "revision": "Revision", "contentStatus": "ContentStatus", "lastPrinted": "LastPrinted", "identifier": "Identifier",
}
APP = {"Application": "Application", "Company": "Company", "Manager": "Manager", "AppVersion": "AppVersion", "Template": "Template", "TotalTime": "EditingMinutes", "Pages": "Pages", "Words": "Words", "HyperlinkBase": "HyperlinkBase"}
OPEN = {"title": "Title", "creator": "Author", "generator": "Creator", "initial-creator": "Author", "keyword": "Keywords", "description": "Subject", "creation-date": "CreationDate", "date": "ModDate"}
PDF_KEYS = ["Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Company"]
XMP = {"dc:creator": "Author", "dc:title": "Title", "xmp:CreatorTool": "Creator", "pdf:Producer": "Producer"}
#: Entries of a directory, bytes of a value, characters kept of one, bytes of a zip member, streams of a PDF and bytes inflated of them all, links of a document.
ENTRIES, VALUE, KEPT, MEMBER, STREAMS, INFLATED, LINKS = 512, 65536, 2000, 4 << 20, 400, 16 << 20, 40

Fields = dict[str, str]


class Directories:
    """The image file directories of a TIFF block."""

    def __init__(self, data: bytes):
        self.data, self.seen = data, set()
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")

    def number(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def read(self, at: int, names: dict[int, str]) -> dict[int, object]:
        """The values of a directory's known tags and pointers; none for one that lies outside or was read before."""
        out: dict[int, object] = {}
        if at in self.seen or not 8 <= at <= len(self.data) - 2:
            return out
        self.seen.add(at)
        for i in range(min(self.number("H", at), ENTRIES)):
            entry = at + 2 + 12 * i
            if entry + 12 > len(self.data):
                break
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, entry)
            size = TYPE_SIZES.get(kind, 0) * count
            start = entry + 8 if size <= 4 else self.number("I", entry + 8)
            if (tag in names or tag in (CAMERA, PLACE)) and 0 < size <= VALUE and start + size <= len(self.data):
                out[tag] = self.value(kind, self.data[start : start + size])
        return out

    def value(self, kind: int, raw: bytes) -> object:
        if kind in (5, 10):
            pairs = struct.iter_unpack(self.order + ("II" if kind == 5 else "ii"), raw)
            return [a / b if b else 0.0 for a, b in pairs]
        if kind in (3, 4, 8, 9):
            return [x for (x,) in struct.iter_unpack(self.order + {3: "H", 4: "I", 8: "h", 9: "i"}[kind], raw)]
        return (raw.split(b"\0")[0] if kind == 2 else raw).decode("utf-8", "replace").strip("\0")


def _degrees(values: object, side: object) -> float | None:
    if not isinstance(values, list) or len(values) < 3:
        return None
    out = values[0] + values[1] / 60 + values[2] / 3600
    return round(-out if str(side or "").upper()[:1] in ("S", "W") else out, 6)


def _tiff(data: bytes, notes: list[str]) -> Fields:
    walk = Directories(data)
    if len(data) < 8 or not walk.order or walk.number("H", 2) != 42:
        notes.append("no image file directory where one is due")
        return {}
    plain = lambda found, names: {names[t]: v if isinstance(v, str) else ", ".join(f"{x:g}" for x in v) for t, v in found.items() if t in names}
    first = walk.read(walk.number("I", 4), IMAGE_TAGS)
    out = plain(first, IMAGE_TAGS)
    for pointer, names in ((CAMERA, CAMERA_TAGS), (PLACE, PLACE_TAGS)):
        if isinstance(first.get(pointer), list):
            found = walk.read(int(first[pointer][0]), names)
            if pointer == PLACE:
                at = _degrees(found.get(2), found.get(1)), _degrees(found.get(4), found.get(3))
                if None not in at:
                    out["GPSPosition"] = f"{at[0]},{at[1]}"
                found = {t: v for t, v in found.items() if t in (6, 29)}
            out |= plain(found, names)
    return out


def _jpeg(data: bytes, notes: list[str]) -> Fields:
    at = 2
    while at + 4 <= len(data) and data[at + 1] != 0xDA:
        if data[at] != 0xFF:
            at = data.find(b"\xff", at)
            if at < 0:
                break
            continue
        if data[at + 1] in (0xFF, 0x01, *range(0xD0, 0xDA)):
            at += 1 if data[at + 1] == 0xFF else 2
            continue
        size = max(2, struct.unpack_from(">H", data, at + 2)[0])
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _tiff(body[6:], notes)
        at += 2 + size
    notes.append("no EXIF block: saved anew or scrubbed, which doesn't say that it never had one")
    return {}


def _png(data: bytes, notes: list[str]) -> Fields:
    out: Fields = {}
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT" or at + 8 + size > len(data):
            break
        if kind in (b"tEXt", b"iTXt"):
            key, found, value = data[at + 8 : at + 8 + size].partition(b"\0")
            if kind == b"iTXt" and value[:1] == b"\0":  # not compressed: flag, method, language and translated key come first
                value = value[2:].split(b"\0", 2)[-1]
            if found:
                out[key.decode("latin-1")[:60]] = value.decode("utf-8", "replace").strip("\0")
        at += 12 + size
    if not out:
        notes.append("no text chunks")
    return out


def _member(archive: zipfile.ZipFile, name: str, notes: list[str]) -> bytes | None:
    """A member of at most MEMBER bytes, whatever its header says."""
    if name not in archive.namelist():
        return None
    try:
        with archive.open(name) as f:
            data = f.read(MEMBER + 1)
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, NotImplementedError, RuntimeError) as error:
        notes.append(f"{name}: {error}")
        return None
    if len(data) > MEMBER:
        notes.append(f"{name} is too large")
        return None
    return data


def _xml(data: bytes | None, name: str, fields: dict[str, str], notes: list[str]) -> Fields:
    out: Fields = {}
    if data is None:
        return out
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        notes.append(f"{name} declares a document type and isn't read")
        return out
    try:
        for node in ElementTree.fromstring(data).iter():
            label, text = fields.get(str(node.tag).rsplit("}", 1)[-1]), (node.text or "").strip()
            if label and text:
                out.setdefault(label, text)
    except (ElementTree.ParseError, ValueError, LookupError) as error:
        notes.append(f"{name} is no valid XML: {error}")
    return out


def _zip(data: bytes, notes: list[str]) -> tuple[str, Fields]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, EOFError, ValueError, OSError, NotImplementedError) as error:
        notes.append(f"no zip directory: {error}")
        return "zip", {}
    names = archive.namelist()
    if "meta.xml" in names:
        out = _xml(_member(archive, "meta.xml", notes), "meta.xml", OPEN, notes)
        kind = "odf"
    elif "[Content_Types].xml" in names or any(n.startswith("docProps/") for n in names):
        out = _xml(_member(archive, "docProps/core.xml", notes), "docProps/core.xml", CORE, notes) | _xml(_member(archive, "docProps/app.xml", notes), "docProps/app.xml", APP, notes)
        links = re.findall(rb'Target="(https?://[^"]{4,400})"', _member(archive, "word/_rels/document.xml.rels", notes) or b"")
        if links:
            out["ExternalLinks"] = " ".join(x.decode("utf-8", "replace") for x in links[:LINKS])
        kind = "ooxml"
    else:
        return "zip", {}
    if not out:
        notes.append("no document properties: stripped, or written by another tool")
    return kind, out


def _pdf_text(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace").strip()
    return re.sub(r"\\([()\\])", r"\1", raw.decode("latin-1")).strip()


def _pdf_fields(data: bytes, out: Fields) -> None:
    for key in PDF_KEYS:
        for m in re.finditer(rb"/" + key.encode() + rb"\s{0,20}(?:\(((?:[^()\\]|\\.){0,4000}+)\)|<([0-9A-Fa-f\s]{2,4000})>)", data, re.S):
            digits = re.sub(rb"\s", b"", m[2] or b"")
            value = _pdf_text(m[1]) if m[1] is not None else _pdf_text(bytes.fromhex(digits.decode())) if len(digits) % 2 == 0 else ""
            if value:
                out.setdefault(key, value)
                break


def _pdf(data: bytes, notes: list[str]) -> Fields:
    out: Fields = {}
    _pdf_fields(data, out)
    at = inflated = 0
    for _ in range(STREAMS):
        start = re.compile(rb"stream\r?\n").search(data, at)
        end = data.find(b"endstream", start.end()) if start else -1
        if end < 0 or inflated >= INFLATED:
            break
        try:
            blob = zlib.decompressobj().decompress(data[start.end() : end], INFLATED - inflated)
            inflated += len(blob)
            _pdf_fields(blob, out)
        except zlib.error:
            pass  # a stream of another kind
        at = end + 9
    begin = data.find(b"<x:xmpmeta")
    packet = data[begin : max(begin, data.find(b"</x:xmpmeta>", begin))][:200_000].decode("utf-8", "replace") if begin >= 0 else ""
    for tag, label in XMP.items():
        found = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", packet, re.S)
        value = re.sub(r"<[^>]*>", " ", found[1]).strip() if found else ""
        if value:
            out.setdefault(label, value)
    if not out:
        packed = b"/ObjStm" in data or b"/FlateDecode" in data
        notes.append("no document information" + (", but packed streams that may hold some" if packed else ""))
    return out


def read_file(data: bytes) -> tuple[str, Fields, list[str]]:
    """kind, fields and notes of a file, by its first bytes."""
    notes: list[str] = []
    try:
        if data[:3] == b"\xff\xd8\xff":
            kind, out = "jpeg", _jpeg(data, notes)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            kind, out = "png", _png(data, notes)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            kind, out = "tiff", _tiff(data, notes)
        elif data[:2] == b"PK":
            kind, out = _zip(data, notes)
        elif data[:1024].lstrip()[:5] == b"%PDF-":
            kind, out = "pdf", _pdf(data, notes)
        else:
            kind, out = "other", {}
    except (struct.error, IndexError, OverflowError, ValueError) as error:
        kind, out = "broken", {}
        notes.append(f"cut or contradictory: {error}")
    return kind, {k: v[:KEPT] for k, v in out.items() if v}, notes


def file_metadata(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, kind, fields (map) and notes of each file (path, content), as spark.read.format("binaryFile") gives them. Null content: kind other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(b.num_rows):  # one file after the other: contents are large
                kind, fields, notes = read_file(b.column("content")[lo].as_py() or b"")
                row = {"path": b.column("path")[lo].as_py(), "kind": kind, "fields": list(fields.items()), "notes": notes}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("kind", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("notes", pa.list_(pa.string()))]))

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(read, "path string, kind string, fields map<string,string>, notes array<string>")


def metadata_of_folder(spark: SparkSession, path: str) -> DataFrame:
    """As file_metadata, of all files below a folder."""
    return file_metadata(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
