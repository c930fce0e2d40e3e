import base64
import hashlib

from corvid.llm import warc
from corvid.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, shard int, payload string, first int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 0, "", 0) for i, u, h in rows], SCHEMA)


def brute(rows):
    out, top = [], {}
    for i, _, h in rows:
        d = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        top[d] = max(top.get(d, -1), -1 if i is None else i)
        out.append((i, len((h or "").encode()), d))
    seen = set()
    done = []
    for i, n, d in sorted(out, key=str):
        best = top[d] if top[d] >= 0 else None
        response = i == best and (i, d) not in seen
        seen.add((i, d))
        done.append((i, n, d, "response" if response else "revisit", None if response else best))
    return sorted(done, key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in warc.archive_digest(frame(spark, rows)).collect()), key=str)


def test_round_trip_and_roll(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 150} é</p>" * (i % 9)) for i in range(400)]
    assert run(spark, rows) == brute(rows)
    folder = f"{shared_dir(spark)}/w"
    manifest = warc.write_archives(frame(spark, rows), folder, shard_bytes=4000, file_bytes=3000)
    first = {(r.file, r.sha1) for r in manifest.collect()}
    assert len(first) > 10 and sum(r.records for r in manifest.collect()) == 400
    payloads = {r.page_id: r.payload.decode() for r in warc.read_archives(manifest, folder).collect() if r.payload is not None}
    assert all(payloads[i] == rows[i][2] for i in payloads)
    again = f"{shared_dir(spark)}/w"
    other = warc.write_archives(frame(spark, rows[::-1]).repartition(7), again, shard_bytes=4000, file_bytes=3000)
    assert {(r.file, r.sha1) for r in other.collect()} == first


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "a\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r\n"), (3, "a", "x\r\n\r\nWARC/1.1\r\n"), (None, "n", "z"), (4, "b", "y" * 3_000_000), (7, "é", "𝔘")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_ids_of_any_spread_and_sign_lose_nothing(spark):
    ids = [0, 5, 2**60 - 1, -(2**62) - 5, 2**62 + 7, 2**63 - 1, -(2**63), 2**53 + 1]
    rows = [(i, f"http://h/{i}", f"page {i}") for i in ids]
    assert sorted(r[0] for r in run(spark, rows)) == sorted(ids)


def test_outliers_repeated_and_null_ids_spread_over_shards(spark):
    for ids in ([*range(3000), 2**55], [7] * 1500 + [2**40], [None] * 1500 + [1]):
        rows = [(i, "u", f"<p>{k} text of a page</p>" * 3) for k, i in enumerate(ids)]
        folder = f"{shared_dir(spark)}/w"
        manifest = warc.write_archives(frame(spark, rows), folder, shard_bytes=50_000).collect()
        held = [r.records for r in manifest]
        assert sum(held) == len(rows) and len({r.shard for r in manifest}) >= 20 and max(held) < 6 * len(rows) / len(held)
        import os

        assert not os.path.exists(folder.removeprefix("file://") + "/_temporary")


def test_records_by_the_standard(spark):
    folder = f"{shared_dir(spark)}/w"
    rows = [(1, "http://h/1", "same"), (2, "http://h/2", "same"), (3, "http://h/3", "other")]
    manifest = warc.write_archives(frame(spark, rows), folder).collect()
    found = {}
    for part in manifest:
        with open(f"{folder.removeprefix('file://')}/{part.file}", "rb") as stream:
            records = list(warc.records_of(stream))
        assert records[0][0]["WARC-Type"] == "warcinfo" and records[0][0]["WARC-Filename"] == part.file and len(records) == part.records + 1
        found |= {h["X-Page-Id"]: h for h, _ in records[1:]}
    assert found["1"]["WARC-Type"] == "revisit" and found["1"]["WARC-Refers-To"] == found["2"]["WARC-Record-ID"]
    assert len({h["WARC-Record-ID"] for h in found.values()}) == 3
