import io
import struct
import time
import zipfile
import zlib

import pytest

from sleuthgrid.sources.metadata import file_metadata, metadata_of_folder, read_file


def tiff(order="<", south=True, loop=False):
    """A TIFF block with a camera's directory and a place."""
    parts, at = [], 8
    text = lambda s: s.encode() + b"\0"

    def directory(entries, start):
        nonlocal parts
        extra, body = b"", struct.pack(order + "H", len(entries))
        base = start + 2 + 12 * len(entries) + 4
        for tag, kind, count, value in entries:
            if len(value) <= 4:
                field = value.ljust(4, b"\0")
            else:
                field = struct.pack(order + "I", base + len(extra))
                extra += value
            body += struct.pack(order + "HHI", tag, kind, count) + field
        return body + struct.pack(order + "I", start if loop else 0) + extra

    rational = lambda *xs: b"".join(struct.pack(order + "II", int(x * 100), 100) for x in xs)
    owner = text("Owner Name <o@example.org>")
    place = [(1, 2, 2, b"S\0" if south else b"N\0"), (2, 5, 3, rational(10, 30, 0)), (3, 2, 2, b"W\0"), (4, 5, 3, rational(20, 0, 36))]
    first = lambda a, b: [(0x10F, 2, 6, text("Maker")), (0x110, 2, 9, text("Model 12")), (0x8769, 4, 1, struct.pack(order + "I", a)), (0x8825, 4, 1, struct.pack(order + "I", b))]
    one = len(directory(first(0, 0), at))
    two = directory([(0xA430, 2, len(owner), owner), *([(0x8769, 4, 1, struct.pack(order + "I", at))] if loop else [])], at + one)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + directory(first(at + one, at + one + len(two)), at) + two + directory(place, at + one + len(two))


def jpeg(block):
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00\x02data"


def docx(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>A Writer</dc:creator><cp:lastModifiedBy>e@x.org</cp:lastModifiedBy></cp:coreProperties>'
WORD = docx({"[Content_Types].xml": "<a/>", "docProps/core.xml": CORE, "docProps/app.xml": "<P><Company>Acme</Company><TotalTime>12</TotalTime></P>", "word/_rels/document.xml.rels": '<R Target="https://links.example.org/a"/>'})
PDF = b"%PDF-1.5\n<< /Producer (A \\(tool\\)) /Author <FEFF00480069> >>\n5 0 obj << /FlateDecode >> stream\n" + zlib.compress(b"/Title (inside) /Company (Co)") + b"\nendstream\n<x:xmpmeta><dc:title><rdf:li>outer</rdf:li></dc:title><xmp:CreatorTool>Pen</xmp:CreatorTool></x:xmpmeta>"


@pytest.mark.parametrize("order", ["<", ">"])
def test_images(order):
    want = {"Make": "Maker", "Model": "Model 12", "CameraOwnerName": "Owner Name <o@example.org>", "GPSPosition": "-10.5,-20.01"}
    assert read_file(jpeg(tiff(order)))[:2] == ("jpeg", want) and read_file(tiff(order))[:2] == ("tiff", want)
    assert read_file(tiff(order, south=False))[1]["GPSPosition"] == "10.5,-20.01"
    kind, fields, notes = read_file(b"\xff\xd8\xff\xda\x00\x02")
    assert (kind, fields) == ("jpeg", {}) and "no EXIF" in notes[0]


def test_documents():
    assert read_file(WORD) == ("ooxml", {"Author": "A Writer", "LastModifiedBy": "e@x.org", "Company": "Acme", "EditingMinutes": "12", "ExternalLinks": "https://links.example.org/a"}, [])
    assert read_file(docx({"meta.xml": '<m xmlns:d="d"><d:title>T</d:title><generator>G</generator></m>'}))[:2] == ("odf", {"Title": "T", "Creator": "G"})
    assert read_file(PDF) == ("pdf", {"Producer": "A (tool)", "Author": "Hi", "Title": "inside", "Company": "Co", "Creator": "Pen"}, [])
    assert "stripped" in read_file(docx({"[Content_Types].xml": "<a/>"}))[2][0]
    assert "no valid XML" in read_file(docx({"[Content_Types].xml": "", "docProps/core.xml": "<a>"}))[2][0]
    assert "document type" in read_file(docx({"[Content_Types].xml": "", "docProps/core.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'}))[2][0]
    assert "packed" in read_file(b"%PDF-1.5 /ObjStm stream\nno zlib\nendstream")[2][0]


def test_cut_and_hostile_files():
    for whole in (jpeg(tiff()), tiff(">"), WORD, PDF, jpeg(tiff(loop=True))):
        for n in range(0, len(whole), 3):
            read_file(whole[:n])
            read_file(whole[:n] + b"\xff" * 8 + whole[n + 8 :])
    assert read_file(tiff(loop=True))[1]["Make"] == "Maker"
    began = time.time()
    bomb = zlib.compress(b"\0" * (64 << 20))
    for data in (b"%PDF-1.4" + (b"stream\n" + bomb + b"endstream") * 8, b"%PDF-/Title (" * 50_000, b"%PDF-" + b"/Title (" + b"a" * 2_000_000, b"\xff\xd8" + b"\xff" * 2_000_000, docx({"[Content_Types].xml": "", "docProps/core.xml": b" " * (64 << 20)})):
        read_file(data)
    assert time.time() - began < 20


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.jpg": jpeg(tiff()), "in/b.docx": WORD, "in/c.pdf": PDF, "in/d.jpg": jpeg(tiff())[:40], "e": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in metadata_of_folder(spark, str(tmp_path)).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"a.jpg": "jpeg", "b.docx": "ooxml", "c.pdf": "pdf", "d.jpg": "jpeg", "e": "other"}
    assert got["c.pdf"]["fields"]["Title"] == "inside" and got["a.jpg"]["notes"] == []
    assert file_metadata(spark.createDataFrame([(None, None)], "path string, content binary")).collect()[0]["kind"] == "other"
