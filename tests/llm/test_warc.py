import gzip

import pytest
from pyarrow import fs

from gradeworks.llm import warc


def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def pages(spark, rows):
    full = [(i, u, h, "k", "x", 3, "f") for i, u, h in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, key string, hash string, offset long, file string")


ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "n", "<p>é</p>"),
        (5, "long", "x" * 300000), (2, "http://b/\r\nX: y", "<p>é</p>"), (6, "w", "WARC/1.1\r\n\r\n\r\n\r\n"), (-9, "http://a/", "<p>é</p>")]


def test_round_trip(spark, tmp_path):
    index = warc.write_archives(pages(spark, ROWS), folder(tmp_path))
    back = warc.read_records(index, folder(tmp_path)).collect()
    got = sorted((str(r["key"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"], r["payload_digest"],
                  None if r["payload"] is None else bytes(r["payload"])) for r in back)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        home = {"<p>é</p>": 2, None: 4, "": 4}.get(html, i)
        revisit = i != home
        want.append((str(i), "revisit" if revisit else "response", str(home if revisit else None), len(data), warc.base32_sha1(data),
                     None if revisit else data))
    assert got == sorted(want)
    assert {r["key"]: r["url"] for r in back}["2"] == "http://b/%0D%0AX: y"


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(i, "u", "same") for i in range(5)] + [(10 + i, "u", "a longer payload") for i in range(3)]
    index = warc.write_archives(pages(spark, rows), folder(tmp_path), revisit_from=5)
    kinds = {int(r["key"]): (r["record_type"], r["refers_to"]) for r in warc.read_records(index, folder(tmp_path)).collect()}
    assert all(kinds[i] == ("response", None) for i in (0, 1, 2, 3, 4, 12)) and kinds[10] == kinds[11] == ("revisit", "12")


def test_index_ranges_and_selection(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(60)]
    index = warc.write_archives(pages(spark, rows).coalesce(1), folder(tmp_path), max_bytes=2000)
    entries = index.collect()
    assert len({e["file"] for e in entries}) > 3
    for e in entries:
        raw = (tmp_path / "archives" / e["file"]).read_bytes()[e["offset"]:e["offset"] + e["length"]]
        found = warc.parse_record(gzip.decompress(raw))
        assert (found["key"], found["url"], found["payload_digest"]) == (e["key"], e["url"], e["digest"])
    some = warc.read_records(index.filter("cast(key as int) % 7 = 0"), folder(tmp_path)).collect()
    assert sorted(int(r["key"]) for r in some) == list(range(0, 60, 7))


def test_reads_are_coalesced():
    ranges = [("a", 0, 10), ("a", 12, 5), ("a", 500, 5), ("b", 505, 5), ("b", 510, 1)]
    assert list(warc.coalesced(ranges, gap=4, most=100)) == [
        ("a", 0, 17, [0, 1]), ("a", 500, 5, [2]), ("b", 505, 6, [3, 4])]
    assert [r[2] for r in warc.coalesced([("a", i * 10, 10) for i in range(9)], most=30)] == [30, 30, 30]


def test_damage_is_noticed():
    raw, _ = warc.record("1", "u", b"payload", None)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"payload\r\n", b"pAyload\r\n"))


def test_empty_table(spark, tmp_path):
    index = warc.write_archives(pages(spark, []), folder(tmp_path))
    assert index.collect() == [] and warc.read_records(index, folder(tmp_path)).collect() == []
    assert fs.LocalFileSystem().get_file_info(f"{tmp_path}/archives").type == fs.FileType.Directory
