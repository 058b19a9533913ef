import base64
import hashlib

from playstat.llm.warc import MAGIC, archive, page_record, read, read_archive, train, write_archive

PAGES = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "u\r\nX: y", None), (9, "u", ""),
         (None, "u", "same"), (4, "é ü", "<p>é🙂</p>\r\n\r\nWARC/1.1\r\n"), (7, "u", "x" * 300_000), (7, "v", "x" * 300_000),
         (None, "n", "alone"), (6, "u", "WARC/1.1\r\n")]


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == p]
        top = max((j for j in same if j is not None), default=None)
        revisit = len(p) >= least and i != top
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response",
                    top if revisit else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w") for r in rows],
                                 "page_id long, url string, html string, sha1 int, winner string").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_round_trip(spark):
    assert got(read(archive(frame(spark, PAGES)))) == brute(PAGES)
    assert got(read(archive(frame(spark, PAGES), min_bytes=10))) == brute(PAGES, 10)
    assert got(read(archive(frame(spark, []).limit(0)))) == []


def test_many_small_archives(spark, monkeypatch):
    import playstat.llm.warc as W
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)
    rows = [(i, f"http://h/{i}", f"<p>{i % 40} " + "text " * (i % 40)) for i in range(300)]
    files = archive(frame(spark, rows))
    assert files.count() > 10 and files.select("archive").distinct().count() == files.count()
    assert got(read(files)) == brute(rows)


def test_archive_format():
    records = [page_record(i, f"http://h/{i}", f"<p>hello {i}</p>" * 9, None, False) for i in range(50)]
    dictionary = train(records)
    data = write_archive(records, dictionary)
    assert int.from_bytes(data[:4], "little") == MAGIC and data[8:8 + len(dictionary)] == dictionary
    back = list(read_archive(data))
    assert len(back) == 50 and all(h["WARC-Type"] == "response" for h, _ in back)
    assert b"".join(b for _, b in back) == b"".join(r.split(b"\r\n\r\n", 1)[1][:-4] for r in records)
    import zstandard
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    one = d.decompressobj().decompress(data[8 + len(dictionary):])
    assert one == records[0]                   # each record is a frame of its own
    assert list(read_archive(write_archive([], b""))) == []


def test_pages_all_large_train_a_dictionary(spark):
    import random
    r = random.Random(3)
    words = ["<div class='row'>", "<p>some words</p>", "<a href='/x'>more</a>", "été ", "\n"]
    rows = [(i, f"http://h/{i}", "".join(r.choice(words) + str(r.randrange(99)) for _ in range(9000))) for i in range(40)]
    assert min(len(h.encode()) for _, _, h in rows) > 64 << 10
    files = archive(frame(spark, rows))
    for f in files.collect():
        assert int.from_bytes(f.data[4:8], "little") > 1000
    assert got(read(files)) == brute(rows)


def test_samples_are_slices_of_the_payload(spark):
    from playstat.llm.warc import SAMPLE_CHARS, samples
    rows = [(i, "u", None if i == 0 else str(i) * (5 if i % 2 else 40_000), str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    drawn = {r.page_id: r.html for r in samples(df).collect()}
    assert len(drawn) == len(rows) and drawn[0] is None
    for i, _, h, _ in rows:
        if h is not None:
            assert len(drawn[i]) == min(len(h), SAMPLE_CHARS) and drawn[i] in h
