import io

import zstandard
from fixtures_llm import prose

from gritstone.llm import warc_zstd as wz

SCHEMA = "page_id long, url string, html string, archive string, frame int"


def rows(n):
    return [(i, f"https://h{i % 5}.example.com/{i}", f"<html><body><nav>menu</nav><p>{prose(40, i)}</p></body></html>", "x", 1) for i in range(n)]


def archives(frames):
    out = {}
    for r in sorted(frames.collect(), key=lambda r: (r.archive, r.member)):
        data = out.setdefault(r.archive, bytearray())
        assert len(data) == r.byte_offset
        data += r.frame
    return {k: bytes(v) for k, v in out.items()}


def test_exact_round_trip(spark):
    data = rows(500)
    pages = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = archives(wz.frames(pages, archive_bytes=60_000))
    assert len(out) > 3
    records = [r for a in out.values() for r in list(wz.read(a))[1:]]
    assert sorted(records) == sorted(wz.response(*r[:3]) for r in data)
    for a in out.values():
        assert next(wz.read(a)).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_records_are_frames_of_their_own_and_the_dictionary_helps():
    records = [wz.response(*r[:3]) for r in rows(300)]
    members = list(wz.archive("a.warc.zst", records))
    assert members[0][:4] == b"\x5d\x2a\x4d\x18" and len(members[0]) > 1000
    words = zstandard.ZstdCompressionDict(members[0][8:])
    assert zstandard.ZstdDecompressor(dict_data=words).decompress(members[42]) == records[40]
    plain = zstandard.ZstdCompressor(level=wz.LEVEL)
    assert sum(map(len, members[2:])) < 0.8 * sum(len(plain.compress(r)) for r in records)


def test_record_form():
    record = wz.response(7, "https://x.example/\r\nEvil: 1", "é")
    head, body = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert "Evil" not in fields and fields["WARC-Page-ID"] == "7"
    assert body.endswith(b"\r\n\r\n") and len(body) - 4 == int(fields["Content-Length"])
    assert body[:-4].endswith("é".encode())


def test_awkward_rows(spark):
    data = [(None, "https://a.example", "x", "q", 1), (1, None, "y", None, None), (2, "https://b.example", None, "q", 1), (3, "", "", "q", 1), (4, "https://c.example", "z" * 3_000_000, "q", 1), (4, "https://c.example", "z" * 3_000_000, "q", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(data, SCHEMA)
    got = [r for a in archives(wz.frames(pages)).values() for r in list(wz.read(a))[1:]]
    assert sorted(got) == sorted(wz.response(*r[:3]) for r in data)
    assert wz.frames(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files(spark, tmp_path):
    data = rows(200)
    made = wz.write(spark.createDataFrame(data, SCHEMA).repartition(2), f"file://{tmp_path}/out", archive_bytes=40_000).collect()
    files = sorted((tmp_path / "out").iterdir())
    assert [f.name for f in files] == sorted(r.archive for r in made) and sum(r.records for r in made) == 200
    got = [r for f in files for r in list(wz.read(io.BytesIO(f.read_bytes()).getvalue()))[1:]]
    assert sorted(got) == sorted(wz.response(*r[:3]) for r in data)


def test_table_is_written_whole(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = [r for a in archives(wz.frames(pages)).values() for r in list(wz.read(a))[1:]]
    assert sorted(got) == sorted(wz.response(*r) for r in pages.select("page_id", "url", "html").collect())


def test_dates(spark):
    pages = spark.sql("select cast(1 as bigint) page_id, 'u' url, 'h' html, timestamp '2024-05-06 07:08:09' at union all select 2, 'v', 'i', null")
    records = [r for a in archives(wz.frames(pages, date="2023-01-01T00:00:00Z", date_column="at")).values() for r in wz.read(a)]
    assert sorted(r.split(b"WARC-Date: ")[1][:20] for r in records) == [b"2023-01-01T00:00:00Z"] * (len(records) - 1) + [b"2024-05-06T07:08:09Z"]
