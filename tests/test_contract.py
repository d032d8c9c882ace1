"""The driver contract and the rules every query keeps."""

import __spark_entry__ as entry


def test_every_query_has_an_oracle_and_entry_is_stable(spark):
    from workload.registry import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    columns = {"query_id", "rank", "object_id", "object_type", "score", "reason", "missing", "n_evidence"}
    assert set(entry.entry(spark).columns) == columns


def test_folder_scan_reads_no_content(spark, tmp_path):
    from keepsake.sources.folders import list_photos, scan_folder

    (tmp_path / "deep").mkdir()
    for name in ("b.JPG", "a b.jpeg", "c.png", "deep/d.jpg"):
        (tmp_path / name).write_bytes(b"x")
    files = scan_folder(spark, str(tmp_path))
    assert "content" not in files.columns
    rows = list_photos(files, str(tmp_path), "album").collect()
    assert [r["name"] for r in rows] == ["a b.jpeg", "b.JPG"] and rows[0]["raw_uri"].endswith("/a%20b.jpeg")


def test_links_out_of_the_folder_are_left_out(spark, tmp_path):
    from keepsake.sources.folders import list_photos, scan_folder

    folder, outside = tmp_path / "album", tmp_path / "private.jpg"
    folder.mkdir()
    outside.write_bytes(b"secret")
    (folder / "a.jpg").write_bytes(b"x")
    (folder / "evil.jpg").symlink_to(outside)
    (folder / "same.jpg").symlink_to(folder / "a.jpg")
    for name in (str(folder), f"file://{folder}"):
        rows = list_photos(scan_folder(spark, name), str(folder), "album").collect()
        assert [r["name"] for r in rows] == ["a.jpg", "same.jpg"]
