"""WARC archives that are broken, split, foreign or empty."""

import gzip
import random

import pytest

from paperloom.llm import warc
from paperloom.llm.shared import fresh_path


def record(k, length=None, size=60):
    body = bytes([97 + k % 26]) * size
    whole = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{k}>")], body)
    return whole if length is None else whole.replace(b"Content-Length: %d" % size, b"Content-Length: " + length)


def seen(rows):
    return sorted((int(r.record_id[10:-1]), r.payload_bytes) for r in rows if r.error is None), sum(r.error is not None for r in rows)


BAD = [b"", b"x", b"-5", b"1e3", b"9" * 40]


@pytest.mark.parametrize("length", BAD)
def test_bad_lengths_in_plain_files(spark, tmp_path, length):
    (tmp_path / "a.warc").write_bytes(record(0) + record(1, length) + record(2))
    assert seen(warc.read(spark, str(tmp_path)).collect()) == ([(0, 60), (2, 60)], 1)
    assert warc.read(spark, str(tmp_path)).where("record_type = 'response'").count() == 2
    with pytest.raises(Exception, match="Content-Length"):
        warc.read(spark, str(tmp_path), mode="FAILFAST").collect()


@pytest.mark.parametrize("pack", ["one stream", "members", "own"])
def test_good_bad_good_in_gzip_files(spark, tmp_path, pack):
    parts = [record(0), b"junk\r\n\r\n", record(1), record(2, b"x"), record(3)]
    make = {"one stream": lambda p: gzip.compress(b"".join(p)), "members": lambda p: b"".join(map(gzip.compress, p)), "own": lambda p: b"".join(map(warc.member, p))}[pack]
    (tmp_path / "a.warc.gz").write_bytes(make(parts))
    assert seen(warc.read(spark, str(tmp_path)).collect()) == ([(0, 60), (1, 60), (3, 60)], 2)


def test_damaged_and_cut_members(spark, tmp_path):
    rng = random.Random(4)
    for own in (True, False):
        make = warc.member if own else gzip.compress
        members = [make(record(k, size=3000 + k)) for k in range(4)]
        members[1] = members[1][:36] + rng.randbytes(12) + members[1][48:]
        folder = tmp_path / str(own)
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(b"".join(members[:3]) + members[3][:-10])
        found, errors = seen(warc.read(spark, str(folder)).collect())
        assert [k for k, _ in found] in ([0, 2], [0, 2, 3]) and errors == (4 - len(found) if len(found) == 2 else 2)
    (tmp_path / "cut.warc").write_bytes(record(0) + record(1)[:-40])
    assert seen(warc.read(spark, str(tmp_path / "cut.warc")).collect()) == ([(0, 60)], 1)


def test_ranges_of_large_files_read_every_record_once(spark, tmp_path):
    rng = random.Random(6)
    body = [rng.randbytes(rng.randint(10, 400_000)) for _ in range(120)]
    pack = lambda number, ks: b"".join(warc.member(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{k}>")], body[k]), 1, number) for k in ks)
    nested = warc.member(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:500>")], pack(9, range(40))), 0, 7)
    # archives of two numbers one after the other, one inside another, and members of another writer
    data = pack(7, range(40)) + nested + pack(8, range(40, 90)) + b"".join(gzip.compress(record(k)) for k in range(600, 640)) + pack(7, range(90, 120))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(b"".join(record(k, size=300_000) for k in range(700, 730)))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    assert len(data) > 20 << 20
    rows = warc.read(spark, str(tmp_path), payload="digest", partition_bytes=4 << 20)
    assert rows.rdd.getNumPartitions() > 5
    found, errors = seen(rows.collect())
    assert errors == 0 and [k for k, _ in found] == [*range(120), 500, *range(600, 640), *range(700, 730)]
    assert all(n == len(body[k]) for k, n in found if k < 120)


def test_no_rows(spark):
    path = fresh_path(spark, "warc")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(pages, path)
    assert warc.read(spark, path).count() == 0 and warc.page_index(spark, path).count() == 0
