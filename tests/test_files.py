"""Folders with files that can't be read: each is a reject row with its reason, and none ends the job."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from quillspark.plans import batch
from quillspark.sources import readers

TYPES = "<Types>application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml</Types>"
BODY = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello there</w:t></w:r></w:p></w:body></w:document>'


def archive(method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("[Content_Types].xml", TYPES * 20)
        z.writestr("word/document.xml", BODY)
    return out.getvalue()


def flagged(data: bytes) -> bytes:
    """Each entry marked as encrypted, in its own header and in the directory."""
    out = bytearray(data)
    for sign, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        k = out.find(sign)
        while k >= 0:
            out[k + at : k + at + 2] = struct.pack("<H", struct.unpack("<H", out[k + at : k + at + 2])[0] | 1)
            k = out.find(sign, k + 4)
    return bytes(out)


def damaged(data: bytes) -> bytes:
    """The first entry's stream holds nonsense."""
    at = 30 + len("[Content_Types].xml")
    return data[:at] + b"\xff" * 12 + data[at + 12 :]


def test_each_file_has_a_row_and_a_reason(spark, tmp_path, monkeypatch):
    good = archive()
    made = {"good file.docx": good, "empty.docx": b"", "locked.docx": flagged(good), "damaged.docx": damaged(good), "cut.docx": good[: len(good) // 2], "large.pdf": b"%PDF" + b"x" * 5000, "notes.txt": b"a", "~temp.docx": b"a", "old.doc": b"\xd0\xcf\x11\xe0aaaa"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(readers, "LARGEST", 4000)
    files = readers.scan(spark, str(tmp_path))
    rows = {r.name: r for r in files.collect()}
    assert set(rows) == set(made) - {"~temp.docx"}
    assert {n: r.reason for n, r in rows.items() if r.reason} == {"empty.docx": "empty", "large.pdf": "too large", "notes.txt": "extension"}
    assert rows["large.pdf"].content is None and rows["good file.docx"].content == good
    texts, rejects = batch.read_texts(files)
    assert [r.text for r in texts.collect()] == ["Hello there"]
    said = {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
    assert said == {"empty.docx": "empty", "large.pdf": "too large", "notes.txt": "extension", "locked.docx": "encrypted", "damaged.docx": "broken", "cut.docx": "broken", "old.doc": "unsupported"}


def test_contents_over_the_limit_are_not_fetched(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive())
    plan = readers.scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan


def test_a_folder_of_empty_files(spark, tmp_path):
    (tmp_path / "a b.docx").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"")
    rows = readers.scan(spark, str(tmp_path)).select("name", "reason", F.length("content").alias("n")).collect()
    assert sorted((r.name, r.reason, r.n) for r in rows) == [("a b.docx", "empty", None), ("c.pdf", "empty", None)]
