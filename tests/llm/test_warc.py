import random

from lingmill.llm import warc


def pages(spark, n=300, seed=0):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    return spark.createDataFrame([(i, f"http://host{i % 7}.example/{i}", f"<html><p>{' '.join(r.choices(words, k=80))}</p></html>") for i in range(n)], "page_id long, url string, html string")


def test_round_trip_through_files(spark, tmp_path):
    docs = pages(spark).repartition(3)
    frames = warc.archived(docs, archive_bytes=40_000)
    saved = warc.save(frames, f"file://{tmp_path}").collect()
    assert len(saved) > 3 and sum(r["records"] for r in saved) == 300
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted(r["archive"] for r in saved)
    assert all((tmp_path / r["archive"]).stat().st_size == r["bytes"] for r in saved)
    got = sorted((r["url"], r["html"]) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == sorted((r["url"], r["html"]) for r in docs.collect())


def test_every_record_by_its_offset(spark, tmp_path):
    frames = warc.archived(pages(spark, 60).coalesce(1)).orderBy("archive", "seq").collect()
    archive = b"".join(r["frame"] for r in frames)
    assert frames[0]["seq"] == 0 and frames[0]["page_id"] is None and archive[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(archive[4:8], "little")
    import zstandard

    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    for r in frames[1:]:
        fields, block = warc.headers_and_block(d.decompress(archive[r["offset"] : r["offset"] + r["length"]]))
        assert fields["WARC-Record-ID"] == f"<{r['record_id']}>" and fields["WARC-Target-URI"].endswith(f"/{r['page_id']}") and b"word" in block
    # the trained dictionary pays
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert sum(r["length"] for r in frames[1:]) < 0.9 * sum(len(plain.compress(d.decompress(r["frame"]))) for r in frames[1:])


def test_running_again_gives_the_same(spark):
    one = {(r["record_id"], bytes(r["frame"])) for r in warc.archived(pages(spark, 50).coalesce(1)).collect()}
    assert one == {(r["record_id"], bytes(r["frame"])) for r in warc.archived(pages(spark, 50).coalesce(1)).collect()}


def test_nulls_empty_long_repeated_and_clashing_columns(spark, tmp_path):
    rows = [(1, None, "<p>a</p>", 1), (2, "http://x/\nbad", None, 2), (None, "", "", 3), (4, "http://x/", "é" * 300_000, None), (5, "u", "h", 5), (5, "u", "h", 5)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, seq long").coalesce(1)
    frames = warc.archived(docs, archive_bytes=1000)
    got = frames.where("seq > 0").collect()
    assert sorted((r["page_id"] or 0) for r in got) == [0, 1, 2, 4, 5, 5]
    assert len({r["record_id"] for r in got}) == 5
    assert frames.where("page_id = 4").select("archive").join(frames.where("seq > 0"), "archive").count() == 1
    warc.save(frames, f"file://{tmp_path}").collect()
    assert sorted((r["url"], r["html"]) for r in warc.read(spark, str(tmp_path)).collect()) == sorted(
        [("urn:page:1", "<p>a</p>"), ("http://x/ bad", ""), ("urn:page:", ""), ("http://x/", "é" * 300_000), ("u", "h"), ("u", "h")]
    )


def test_empty_table(spark):
    assert warc.archived(pages(spark).limit(0)).collect() == []
