"""Dumps and provenance records."""

import bz2
import hashlib

import pytest

from lumenlex.sources import provenance as P
from lumenlex.sources import wiki as W

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"><siteinfo/>
<page><title>አንድ</title><ns>0</ns><id>1</id><revision><text xml:space="preserve"> first </text></revision></page>
<page><title>Talk:x</title><ns>1</ns><revision><text bytes="3">talk</text></revision></page>
<page><title>R</title><ns>0</ns><redirect title="አንድ"/><revision><text>#R</text></revision></page>
<page><title>E</title><ns>0</ns><revision><text>   </text></revision></page>
<page><title>N</title><ns>0</ns><revision><text/></revision></page>
<page><title>ሁለት</title><ns>0</ns><revision><text>a &amp; b</text></revision></page>
</mediawiki>"""
WANTED = [("አንድ", " first "), ("ሁለት", "a & b")]


def test_articles_of_a_dump(spark, tmp_path):
    plain, packed = tmp_path / "d.xml", tmp_path / "e.xml.bz2"
    plain.write_text(DUMP, "utf-8")
    packed.write_bytes(bz2.compress(DUMP.encode()))
    for path in (plain, packed):
        assert list(W.iter_pages(str(path))) == WANTED
        for read in (W.read_pages, W.read_pages_in_order):
            assert [(r["title"], r["text"]) for r in read(spark, str(path)).orderBy("page_ord").collect()] == WANTED
    assert W.read_pages_in_order(spark, str(tmp_path)).count() == 4


def test_damaged_and_missing_dumps(spark, tmp_path):
    (tmp_path / "bad.xml").write_text(DUMP[:-200])
    with pytest.raises(ValueError):
        list(W.iter_pages(str(tmp_path / "bad.xml")))
    with pytest.raises(FileNotFoundError):
        list(W.iter_pages(str(tmp_path / "none.xml")))


RECORD = {
    "source_id": "s", "source_name": "n", "url": "u", "language": "am", "license": "l", "access_date": "2026-09-01", "original_format": "xml",
    "original_size": 0, "sha256": "0" * 64, "description": "d", "processing_steps": ["a"], "notes": "",
}


def test_checksums(spark, tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(b"abc" * 1000)
    digest = hashlib.sha256(b"abc" * 1000).hexdigest()
    assert P.sha256_file(str(path)) == P.sha256_file(str(path), 7) == digest
    assert P.verify_checksum(str(path), f" {digest.upper()}\n") and not P.verify_checksum(str(path), "00")
    assert P.sha256_files(spark, str(path)).first()["sha256"] == digest
    with pytest.raises(ValueError):
        P.sha256_file(str(path), 0)


def test_records(spark, tmp_path):
    record = P.build_provenance_record(**RECORD)
    path = str(tmp_path / "deep/r.json")
    P.save_provenance(path, record)
    assert P.load_provenance(path) == record
    with pytest.raises(FileExistsError):
        P.save_provenance(path, record)
    P.save_provenance(path, record | {"notes": "ሀ"}, overwrite=True)
    table = P.read_provenance(spark, path)
    assert table.first()["notes"] == "ሀ" and all(v for k, v in P.record_rules(table).first().asDict().items() if k != "source_id")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        P.load_provenance(str(tmp_path / "bad.json"))


@pytest.mark.parametrize(
    "change",
    [{"source_id": " "}, {"url": 3}, {"access_date": "2026-9-1"}, {"access_date": "20260901"}, {"access_date": None}, {"original_size": -1}, {"original_size": True}, {"original_size": 1.5}, {"processing_steps": "abc"}, {"processing_steps": [1]}, {"notes": None}, {"sha256": "0" * 63}, {"sha256": "G" * 64}],
)
def test_malformed_records(change):
    with pytest.raises(ValueError):
        P.build_provenance_record(**RECORD | change)
    assert pytest.raises(ValueError, P.validate_record, {"source_id": "s"})
