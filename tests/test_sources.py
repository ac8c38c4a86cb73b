"""Landed text files: parsing rules, rejection and pinning."""

import datetime as dt
import hashlib

import pytest

from tidewatch.sources import readers as rd
from tidewatch.sources import sinks


def write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_level_csv_keeps_blank_rows_and_checks_the_header(spark, tmp_path):
    good = write(tmp_path, "a.csv", "observation_date,ABC\n2020-01-01,\n2020-01-02,3.5\n2020-01-03,.\n")
    rows = rd.read_level_csv(spark, good, "ABC").orderBy("date").collect()
    assert [r["value"] for r in rows] == [None, 3.5, None] and rows[0]["date"] == dt.date(2020, 1, 1)
    with pytest.raises(Exception, match="unexpected header"):
        rd.read_level_csv(spark, good, "XYZ").collect()
    bare = write(tmp_path, "bare.csv", "2020-01-01,1.0\n2020-01-02,3.5\n")
    with pytest.raises(Exception, match="unexpected header"):
        rd.read_level_csv(spark, bare, "ABC").collect()
    stamped = write(tmp_path, "t.csv", "DATE,ABC\n2020-01-01T00:00:00,1.0\n")
    assert rd.read_level_csv(spark, stamped, "ABC").count() == 1


def test_factor_text(spark, tmp_path):
    p = write(tmp_path, "f.txt", "Prose, with, commas\n20200102,  1.50\n20200103, -99.99\n20200106, -999\n2020,1.0\nCopyright, 2024\n")
    rows = rd.read_factor_text(spark, p, "F").orderBy("date").collect()
    assert [r["value"] for r in rows] == [pytest.approx(0.015), None, None]


def test_vendor_and_semicolon(spark, tmp_path):
    v = write(tmp_path, "v.csv", "Date,Close\n1/2/2020,5.5\n2020-01-03,null\nn/a,1.0\n")
    rows = rd.read_vendor_csv(spark, v, "V").orderBy("date").collect()
    assert [(r["date"].day, r["value"]) for r in rows] == [(2, 5.5), (3, None)]
    s = write(tmp_path, "s.txt", "Datum;Wert\nZürich;1\n02.01.2020;7.5;x\n03.01.2020;-;x\n04.01.2020\n", "latin-1")
    rows = rd.read_semicolon_text(spark, s, "S").collect()
    assert [(r["date"], r["value"]) for r in rows] == [(dt.date(2020, 1, 2), 7.5)]
    q = write(tmp_path, "q.txt", '"02.01.2020";7.5\n03.01.2020;"8"\n04.01.2020;9;"x\n05.01.2020;10\n', "latin-1")
    assert [r["value"] for r in rd.read_semicolon_text(spark, q, "S").orderBy("date").collect()] == [9.0, 10.0]


def test_landed_file_reasons(spark, tmp_path):
    body = "\n".join(f"2020-01-{d:02d},{d}.0" for d in range(1, 20))
    write(tmp_path, "ok.csv", "observation_date,ABC\n" + body)
    write(tmp_path, "short.csv", "observation_date,ABC\n")
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "page.csv", "  <!DOCTYPE html><html>" + body)
    write(tmp_path, "other.csv", "observation_date,XYZ\n" + body)
    got = {r["path"].rsplit("/", 1)[1]: (r["ok"], r["reason"]) for r in rd.validate_landed(spark, str(tmp_path), "ABC").collect()}
    assert got == {"ok.csv": (True, ""), "short.csv": (False, "too short to be a data file"), "empty.csv": (False, "too short to be a data file"),
                   "page.csv": (False, "looks like HTML"), "other.csv": (False, "unexpected header")}


def test_pinning(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    for name, text in (("DGS10_20240101.csv", "old"), ("DGS10_20240301.csv", "new"), ("A_B_20240101.csv", "x"), ("xyz_1.csv", "y")):
        write(d, name, text)
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "series string")
    side = tmp_path / "side"
    side.mkdir()
    for name, text in (("A_B_20240101.csv", "x"), ("xyz_1.csv", "other")):
        sha = hashlib.sha256(text.encode()).hexdigest()
        write(side, name + ".json", '{\n  "raw_file": "%s",\n  "sha256": "%s",\n  "bytes": 1,\n  "downloaded_at": "2024-01-02"\n}' % (name, sha))
    prov = rd.read_provenance(spark, str(side))
    got = {r["series"]: (r["file"], r["pinned_by"], r["sha_ok"]) for r in rd.pinned_snapshots(spark, str(d), prov, one("DGS10", "A_B", "xyz")).collect()}
    assert got == {"DGS10": ("DGS10_20240301.csv", "newest file", True), "A_B": ("A_B_20240101.csv", "provenance", True), "xyz": ("xyz_1.csv", "provenance", False)}
    with pytest.raises(Exception, match="checksum mismatch"):
        rd.pinned_snapshots(spark, str(d), prov, one("xyz"), strict=True).collect()
    with pytest.raises(Exception, match="no file for series"):
        rd.pinned_snapshots(spark, str(d), prov, one("absent")).collect()
    gone = spark.createDataFrame([("xyz", "xyz_9.csv", "0" * 64)], "series string, file string, sha256 string")
    with pytest.raises(Exception, match="no file for series"):
        rd.pinned_snapshots(spark, str(d), gone, one("xyz")).collect()


def test_thresholds_survive_csv_exactly(spark, tmp_path):
    vals = [0.1 + 0.2, -1.9580412345678901, 5e-324, 1.7976931348623157e308]
    df = spark.createDataFrame([(f"m{i}", 0.05, v) for i, v in enumerate(vals)], "method string, far_target double, threshold double")
    p = sinks.write_table(df, str(tmp_path / "t"), "csv")
    back = [r["threshold"] for r in sinks.read_frozen_thresholds(spark, p).orderBy("method").collect()]
    assert back == vals
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "u"), "avro")


def test_digests_of_files_of_any_size(spark, tmp_path):
    """Both ways agree with hashlib; a sparse file above the 2 GB limit of a value is summed in chunks."""
    d = tmp_path / "landed files"
    d.mkdir()
    write(d, "empty.csv", "")
    write(d, "a b.csv", "x" * 1000)
    with open(d / "big.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    zeros, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        zeros.update(block)
    zeros.update(bytes(5))
    want = {"empty.csv": hashlib.sha256(b"").hexdigest(), "a b.csv": hashlib.sha256(b"x" * 1000).hexdigest(), "big.bin": zeros.hexdigest()}
    for limit in (rd.WHOLE_BYTES, 10, -1):
        got = rd.file_digests(spark, str(d), whole_bytes=limit).collect()
        assert {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in got} == want
        assert len(got) == 3


def test_panel_parts_grow_with_the_table(spark, monkeypatch):
    """A task's share of the panel is bounded by the table's files, not by a fixed number of partitions."""
    from tidewatch.plans import fixtures as fx
    from tidewatch.sources import tables
    sf = "/root/testdata/sf0.001"
    few = fx.panel_supplier(spark, sf)
    monkeypatch.setattr(tables, "DEAL_BYTES", 2048)
    many = fx.panel_supplier(spark, sf)
    assert tables.deal_parts(spark, sf, "lineitem") > spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() == tables.deal_parts(spark, sf, "lineitem")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_ranks_use_one_set_of_cuts(spark):
    """The sketch behind the buckets is evaluated once; a second evaluation may cut elsewhere."""
    from tidewatch.functions.ranking import order_statistics
    got = order_statistics(spark.range(1000).selectExpr("id % 2 AS g", "id AS v"), ["g"], "v", {"third": lambda n: n * 0 + 3})
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["g"], r["n"], r["third"]) for r in got.collect()) == [(0, 500, 4), (1, 500, 5)]
