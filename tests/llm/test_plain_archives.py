import gzip

from pyspark.sql import functions as F

from senseloom.llm import warc


def test_plain_archives_are_read_beside_gzip(spark, tmp_path):
    def record(rid):
        block = b"HTTP/1.1 200 OK\r\n\r\nbody " + rid
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (rid, len(block), block)

    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(record(b"a")))
    (tmp_path / "two.warc").write_bytes(record(b"b") + record(b"c"))
    (tmp_path / "notes.txt").write_text("no archive")
    found = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, str(tmp_path)).collect()}
    assert found == {f"<{x}>": f"body {x}".encode() for x in "abc"}


def test_damaged_archives_give_what_is_left(spark, tmp_path):
    import glob
    import gzip

    rows = [(1, "u", "abc"), (6, "big", "é" * 90000), (7, None, None)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/whole")
    raw = b"".join(b"".join(warc.inflated(open(x, "rb").read(), 1000)) for x in glob.glob(f"{tmp_path}/whole/*.gz"))

    def back(data, name):
        folder = tmp_path / name.replace(".", "_")
        folder.mkdir()
        (folder / name).write_bytes(data)
        return {r["page_id"]: r["complete"] for r in warc.read(spark, str(folder)).collect()}

    assert back(raw, "whole.warc") == back(gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]), "members.gz") == {1: True, 6: True, 7: True}
    assert back(raw + b"WARC/1.1\r\nWARC-Type: response\r\nPage-Id: 8\r\nContent-Le", "header.warc")[8] is False
    lost = back(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nPage-Id: 9\r\n\r\nrubbish\r\n\r\n" + raw, "length.warc")
    assert lost == {1: True, 6: True, 7: True, 9: False}
    assert sorted(back(raw[: len(raw) - 3000], "cut.warc").values()).count(False) == 1
    assert sorted(back(gzip.compress(raw)[:-9], "tail.gz").values()) == [True, True, True]
    assert back(b"", "empty.warc") == back(b"no archive", "other.warc") == {}


def test_rows_alike_and_small_payloads(spark):
    rows = [(1, "u", "abc")] * 3 + [(2, None, "abc"), (None, "u", None), (None, "u", None), (7, "q", "x" * 70000)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "copy": F.lit(2), "record_type": F.lit("x")})
    found = warc.round_trip(pages).collect()
    assert len(found) == len(rows) and all(r["complete"] for r in found)
    assert sorted(((r["page_id"], r["refers_to"]) for r in found if r["record_type"] == "revisit"), key=str) == sorted([(1, 2)] * 3 + [(2, 2), (7, 7)] + [(None, None)] * 3, key=str)
    small = warc.round_trip(pages, 10).collect()
    assert sorted((r["page_id"] or 0) for r in small if r["record_type"] == "response") == [0, 0, 0, 0, 1, 1, 1, 2, 2, 7]
