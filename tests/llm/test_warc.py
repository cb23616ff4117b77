import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id long, url string, html string, sha1 string, n int").repartition(3)


def brute(rows, least):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        first = min((j for j in same if j is not None), default=None)
        revisit = len(data) >= least and len(same) > 1 and first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    pool = [None, "", "é😀\r\n\r\nWARC/1.1\r\n\r\n", "<p>x</p>", "y" * 200_000, "".join(rng.choices("ab\r\n", k=70_000))]
    rows = [(i, rng.choice([None, "http://a.b/c d\n", "http://x.example/"]), rng.choice(pool)) for i in range(60)] + [(None, "u", "only null"), (None, None, "<p>x</p>"), (7, "u", "<p>x</p>")]
    for least in (0, 20):
        manifest = warc.write(table(spark, rows), str(tmp_path / f"w{least}"), least)
        assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
        table_read = warc.read(spark, manifest, size=10_000)
        assert table_read.rdd.getNumPartitions() == manifest.count()
        chunks = table_read.collect()
        last = [(int(r.record) if r.record else None, r.n_bytes, r.digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in chunks if r.last]
        assert sorted(last, key=str) == brute(rows, least)
        assert max(len(r.data) for r in chunks) <= 10_000
        held = {}
        for r in sorted((r for r in chunks if r.record_type == "response"), key=lambda r: r.chunk):
            key = (r.path, r.place, r.record)
            held[key] = held.get(key, b"") + bytes(r.data)
            assert base64.b32encode(hashlib.sha1(held[key]).digest()).decode() == r.digest and len(held[key]) == r.n_bytes
        texts = {str(i): (h or "").encode() for i, _, h in rows if i not in (None, 7)}
        assert all(texts[record] == data for (_, _, record), data in held.items() if record in texts)
        path = manifest.first().path
        assert gzip.decompress(open(path.removeprefix("file://"), "rb").read()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    warc.delete(spark, str(tmp_path / "w0"))
    assert not (tmp_path / "w0").exists()


def test_empty_table(spark, tmp_path):
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert manifest.collect() == [] and warc.read(spark, manifest).collect() == []


def written(chunk_list, size, digest):
    out = io.BytesIO()
    writer = warc.Writer(out)
    for k, part in enumerate(chunk_list):
        writer.chunk("1", k, k == len(chunk_list) - 1, part, "u", size, digest, None)
    return out.getvalue()


def test_a_torn_archive_is_an_error():
    digest = base64.b32encode(hashlib.sha1(b"xy" * 50_000).digest()).decode()
    parts = [b"xy" * 10_000] * 5
    whole = written(parts, 100_000, digest)
    assert b"".join(r[4] for r in warc.read_records(io.BytesIO(whole), 7_000)) == b"xy" * 50_000
    other = whole.replace(whole[-8:-4], bytes(4))  # the checksum of the gzip member
    for wrong in (whole[:-40], other):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(wrong)))
    for wrong in ((parts[:-1], 100_000, digest), (parts, 100_000, "D"), (parts[::-1][:4] + [b"yx" * 10_000], 100_000, digest)):
        with pytest.raises(ValueError):
            written(*wrong)


def test_every_archive_is_read_by_a_task_of_its_own(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 5_000) for i in range(64)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        manifest = warc.write(table(spark, rows), str(tmp_path / "many"), size=1_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    n = manifest.count()
    chunks = warc.read(spark, manifest, size=1_000)
    tasks = chunks.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("path").alias("archives"), F.count_distinct("chunk").alias("chunks")).collect()
    assert n >= 12 and len(tasks) == n and all(t.archives == 1 and t.chunks > 30 for t in tasks)


def test_a_third_of_all_rows_alike(spark, tmp_path):
    rows = [(i, "u", "same " * 40_000 if i % 3 == 0 else f"{i}") for i in range(120)]
    manifest = warc.write(table(spark, rows), str(tmp_path / "hot"))
    found = warc.read(spark, manifest).where("last").collect()
    assert sorted(((int(r.record), r.n_bytes, r.digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in found), key=str) == brute(rows, 0)
