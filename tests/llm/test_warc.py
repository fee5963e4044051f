import glob
import hashlib
import struct
from collections import Counter

import pyspark.sql.functions as F
import zstandard

from crosstally.llm import warc


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def back(spark, path):
    return spark.read.format("binaryFile").load(path), warc.read_archives(spark, path).withColumn("page_id", warc.page_of(F.col("record_id"))).withColumn(
        "refers_to", warc.page_of(F.col("refers_to_id"))).collect()


def test_round_trip(spark, tmp_path):
    long, hot = "é" * 400_000, "<p>" + "same " * 40
    rows = [(i, f"http://h/{i}", f"<html>{i} " + "common words in a page " * 20) for i in range(3, 300)]
    rows += [(9000 - i, "http://hot", hot) for i in range(200)] + [(None, None, hot), (8801, "http://hot", hot), (-5, "a b\nc", None), (-4, None, ""), (-3, "u", "x" * 99), (-2, "u", "x" * 99),
             (7000, "u", long), (7001, "v", long), (6000, "u", "y" * 50 + "é" * 25), (6001, "u", "y" * 50 + "é" * 25), (None, "q", "z" * 100), (None, "q", "z" * 100)]
    path = str(tmp_path / "a")
    warc.write_archives(frame(spark, rows), path, piece_bytes=20_000)
    files, got = back(spark, path)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h] = min(i, least.get(h, i))
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and h in least and i != least[h]
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least[h] if again else None, b"" if again else b)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    assert next(r.target_uri for r in got if r.page_id == -5) == "a%20b%0Ac"
    assert files.count() > 1


def test_layout(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(frame(spark, [(i, "http://h", f"<html><body>number {i} " + "words of all pages " * 30) for i in range(500)]).coalesce(1), path)
    (name,) = glob.glob(path + "/part-*")
    data = open(name, "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 1000
    plain = sum(len(zstandard.ZstdCompressor().compress(f"<html><body>number {i} ".encode() + b"words of all pages " * 30)) for i in range(500))
    assert len(data) - size < plain * 2
    # The first record's frame can be read alone with the dictionary.
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])).decompressobj()
    start = data.index(b"\x28\xb5\x2f\xfd", 8 + size)
    one = d.decompress(data[start:])
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: response") and one.count(b"WARC/1.1") == 1


def test_archives_roll_over_by_bytes(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(frame(spark, [(i, "u", f"{i} " * 500) for i in range(200)]).coalesce(1), path, piece_bytes=5000)
    files, got = back(spark, path)
    assert files.count() > 1 and len(got) == 200


def test_empty_table(spark, tmp_path):
    warc.write_archives(frame(spark, []), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0
