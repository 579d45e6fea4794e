"""Readers of large and odd files, and the publishing state over batches."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

import pytest

from pagequarry.sources import files
from pagequarry.streaming import logs


def test_tables_in_parts_equal_tables_at_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("# made by a tool\nurl;hits\n" + "\n".join(f"/p{i};{i}" for i in range(60)))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"url": f"/p{i}", "hits": i}) for i in range(60)))
    (tmp_path / "c.json").write_text(json.dumps([{"url": f"/p{i}", "hits": i} for i in range(60)]))
    (tmp_path / "d.txt").write_text("\n".join(f"https://example.com/p{i}" for i in range(60)))
    (tmp_path / "e.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>https://example.com/p{i}</loc></url>" for i in range(60)) + "</urlset>")
    rows = lambda name: sorted(tuple(sorted(r.asDict().items())) for r in files.read_table(spark, str(tmp_path / name)).collect())
    once = {n: rows(n) for n in ("a.csv", "b.jsonl", "c.json", "d.txt", "e.xml")}
    monkeypatch.setattr(files, "DRIVER_BYTES", 10)
    for name, want in once.items():
        assert len(want) == 60 and rows(name) == want, name


def test_workbooks_and_archives(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>url</t></is></c><c r="C1" t="inlineStr"><is><t>hits</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>/a</t></is></c><c r="C2"><v>3</v></c></row></sheetData></worksheet>'
    for name, inner, content in (("t.xlsx", "xl/worksheets/sheet1.xml", sheet), ("t.zip", "export.csv", "url,hits\n/a,3\n")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(inner, content)
        (tmp_path / name).write_bytes(data.getvalue())
        (row,) = files.read_table(spark, str(tmp_path / name)).collect()
        assert (row.url, row.hits) == ("/a", "3")


def test_sitemaps_are_read_where_they_are(spark, tmp_path):
    one = '<urlset><url><loc>https://example.com/%D0%BE/</loc><lastmod>2024-01-02</lastmod></url></urlset>'
    (tmp_path / "a.xml").write_text(one)
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(one.encode()))
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>https://example.com/a.xml</loc></sitemap><sitemap><loc>https://example.com/b.xml.gz</loc></sitemap></sitemapindex>")
    rows = files.read_sitemaps(spark, str(tmp_path / "index.xml")).collect()
    assert [(r.key, r.lastmod) for r in rows] == [("//example.com/о", "2024-01-02")] * 2
    (tmp_path / "loop.xml").write_text("<sitemapindex><sitemap><loc>https://example.com/loop.xml</loc></sitemap></sitemapindex>")
    with pytest.raises(ValueError, match="lists itself"):
        files.read_sitemaps(spark, str(tmp_path / "loop.xml"))
    with pytest.raises(ValueError, match="too large"):
        files.gunzip(gzip.compress(b"0" * 200_000), most=100_000)


def test_publishing_state_forgets_and_continues(spark, tmp_path):
    path, pages = str(tmp_path / "state"), lambda *rows: spark.createDataFrame(list(rows), "key string, hash string")
    state = lambda: {r.key: (r.hash, str(r.lastmod)) for r in spark.read.parquet(f"{path}/{max(logs._generations(spark, path))}").collect()}
    logs.manifest_sink(path, "2024-01-01")(pages(("a", "1"), ("b", "1")), 0)
    logs.manifest_sink(path, "2024-01-02")(pages(("a", "2")), 1)
    logs.manifest_sink(path, "2024-01-02")(pages(("a", "2")), 1)  # run again
    assert state() == {"a": ("2", "2024-01-02"), "b": ("1", "2024-01-01")}
    logs.manifest_sink(path, "2024-03-01")(pages(("a", "2")), 0)  # another checkpoint
    assert state() == {"a": ("2", "2024-01-02")}
    logs.manifest_sink(path, "2024-03-05")(pages(("a", "2"), ("b", "1")), 1)
    assert state() == {"a": ("2", "2024-01-02"), "b": ("1", "2024-03-05")}
    assert len(logs._generations(spark, path)) == 3
