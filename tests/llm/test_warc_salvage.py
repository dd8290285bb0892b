import zlib

from corvane.llm import warc
from corvane.llm.common import shared_dir


def record(k):
    body = f"<p>{k}".encode() * 50
    return warc.record(k, f"http://h/{k}", body, warc.base32_sha1(body), None, False)


def member(content, level=5):
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(content) + gz.flush()


def found(data):
    out = list(warc.salvage(data))
    assert not data or (out[0][1] == 0 and out[-1][2] == len(data))
    return [x[3][0]["warc-record-id"][10:-1] if x[0] == "record" else "gap" for x in out]


def test_members_of_several_records():
    bad = record(1).replace(b"<p>1", b"<p>x", 1)
    assert found(member(record(0) + bad + record(2)) + member(record(3))) == ["0", "gap", "2", "3"]
    whole = member(b"".join(map(record, range(40))))
    cut = found(whole[: len(whole) // 2])
    assert cut[-1] == "gap" and len(cut) > 5 and cut[:-1] == [str(k) for k in range(len(cut) - 1)]
    # a wrong CRC, then a member that is stored and cut: no record twice
    assert found(whole[:-8] + b"\0" * 8 + member(record(50))) == [*map(str, range(40)), "gap", "50"]
    stored = member(record(60) + record(61), 0)
    got = found(stored[:-30] + member(record(62)))
    assert [x for x in got if x != "gap"] == ["60", "62"]


def test_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://h/" + "u" * (1 << 21), "<p>x")], "page_id long, url string, html string")
    path = shared_dir(spark, "warc-long")
    warc.write_warc(pages, path)
    assert [r.kind for r in warc.read_warc(spark, path).select("kind").collect()] == ["record"]
