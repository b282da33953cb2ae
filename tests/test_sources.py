"""Delimited text, line shapefiles, the ingest job."""

import struct

import pytest
from pyspark.sql import functions as F

from roadlines.config import AccidentColumns, ColumnMap, GeometryColumns, IntervalColumns, SegmentColumns
from roadlines.plans import profile as pf
from roadlines.sources.delimited import LATIN1, UTF8, pick_delimiter, read_delimited, sniff_format
from roadlines.sources.ingest import ingest_all, tables_ready
from roadlines.sources.shapefile import crs_of, register


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("line,want", [
    ("a,b,c", ","), ("a;b;c", ";"), ("a\tb", "\t"), ("a|b|c,d", "|"), ("a;b,c", ","), ("abc", ",")])
def test_delimiter(line, want):
    assert pick_delimiter(line) == want


def test_sniff_and_read(spark, tmp_path):
    path = write(tmp_path / "a.txt", '\n"ID";"NAAM ";"WEG"\n1;"Zoë";A2\n2;"de ""A2""; zuid";\n')
    fmt = sniff_format(spark, path)
    assert (fmt.encoding, fmt.delimiter, fmt.header, fmt.columns) == (UTF8, ";", True, ("ID", "NAAM", "WEG"))
    df = read_delimited(spark, path)
    assert df.columns == ["ID", "NAAM", "WEG", "_source_file", "_ingested_at"]
    rows = df.orderBy("ID").collect()
    assert [r["NAAM"] for r in rows] == ["Zoë", 'de "A2"; zuid']
    assert rows[0]["_source_file"] == "a.txt" and rows[0]["_ingested_at"] is not None
    assert all(t == "string" for c, t in df.dtypes if c != "_ingested_at")


def test_latin1_beyond_the_first_lines(spark, tmp_path):
    body = "id,name\n" + "".join(f"{i},x\n" for i in range(30000)) + "30000,café\n"
    path = write(tmp_path / "l.csv", body, "latin-1")
    fmt = sniff_format(spark, path)
    assert fmt.encoding == LATIN1
    assert read_delimited(spark, path, fmt).where("id = '30000'").first()["name"] == "café"


def test_empty_file_and_single_column(spark, tmp_path):
    empty = sniff_format(spark, write(tmp_path / "e.txt", "\n  \n"))
    assert (empty.delimiter, empty.header, empty.columns) == (",", True, ())
    one = sniff_format(spark, write(tmp_path / "o.txt", "alpha\nbeta\n"))
    assert one.header is False and one.columns == ("alpha",)


def write_shapes(base, records, kind=3):
    """Minimal .shp/.shx/.dbf/.prj of poly lines: records are (key, parts)."""
    shp, shx, at = b"", b"", 50
    for i, (_, parts) in enumerate(records):
        if parts is None:
            body = struct.pack("<i", 0)
        else:
            pts = [p for part in parts for p in part]
            firsts, n = [], 0
            for part in parts:
                firsts.append(n)
                n += len(part)
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            body = struct.pack("<i4d", kind, min(xs), min(ys), max(xs), max(ys))
            body += struct.pack("<ii", len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *firsts)
            body += b"".join(struct.pack("<2d", *p) for p in pts)
        shp += struct.pack(">ii", i + 1, len(body) // 2) + body
        shx += struct.pack(">ii", at, len(body) // 2)
        at += 4 + len(body) // 2

    def head(size):
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)

    base.with_suffix(".shp").write_bytes(head(50 + len(shp) // 2) + shp)
    base.with_suffix(".shx").write_bytes(head(50 + len(shx) // 2) + shx)
    field = b"FK_VELD1".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    dbf = struct.pack("<4BIHH", 3, 24, 1, 1, len(records), 32 + 32 + 1, 11) + b"\0" * 20 + field + b"\x0d"
    dbf += b"".join(b" " + str(k).encode().ljust(10) for k, _ in records) + b"\x1a"
    base.with_suffix(".dbf").write_bytes(dbf)
    base.with_suffix(".prj").write_text('PROJCS["RD_New",GEOGCS["GCS_Amersfoort"]]')
    return str(base.with_suffix(".shp"))


LINES = [(500000 + i, [[(20000.0 + i, 400000.0), (20010.0 + i, 400005.0 + i)]]) for i in range(25)]


def test_shapefile_splits_into_record_ranges(spark, tmp_path):
    records = [*LINES, (1, None), (2, [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)]])]
    path = write_shapes(tmp_path / "geo", records)
    register(spark)
    df = spark.read.format("shp_lines").option("recordsPerTask", "4").load(path)
    assert df.columns == ["FK_VELD1", "geom", "geom_parts"]
    assert df.rdd.getNumPartitions() == 7
    rows = {r["FK_VELD1"]: r for r in df.collect()}
    assert len(rows) == 27
    assert [tuple(p) for p in rows["500003"]["geom"]] == LINES[3][1][0]
    assert rows["1"]["geom"] is None and rows["2"]["geom"] is None and len(rows["2"]["geom_parts"]) == 2
    assert crs_of(path) == "EPSG:28992 (RD New)"


def test_surplus_fields_never_vanish(spark, tmp_path):
    path = write(tmp_path / "r.txt", 'a;b\n1;2\n3;4;5\n6\n"x;y";"q"";"\n7;8;\n"9;";;"z;"\n1;2;;3\n')
    rows = read_delimited(spark, path, surplus="keep").collect()
    got = [(r.a, r.b, r._surplus) for r in rows]
    assert got == [("1", "2", None), ("3", "4", "3;4;5"), ("6", None, None), ("x;y", 'q";', None), ("7", "8", "7;8;"),
                   ("9;", None, '"9;";;"z;"'), ("1", "2", "1;2;;3")]
    with pytest.raises(Exception, match="more than 2 fields: 3;4;5"):
        read_delimited(spark, path).collect()
    with pytest.raises(ValueError):
        read_delimited(spark, path, surplus="drop")
    fine = read_delimited(spark, write(tmp_path / "f.txt", "a;b\n1;2\n6\n"))
    assert fine.count() == 2 and [(r.a, r.b) for r in fine.collect()] == [("1", "2"), ("6", None)]


def test_files_without_a_header_have_positional_names(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path / "n.txt", "100\n200\n300\n"))
    assert df.columns[0] == "column0" and sorted(r.column0 for r in df.collect()) == ["100", "200", "300"]


def test_shapes_of_all_kinds_and_scattered_records(spark, tmp_path, monkeypatch):
    from roadlines.sources import shapefile as sf
    records = [(7, [[(1.0, 2.0), (3.0, 4.0)]]), (8, None), (9, [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)]]),
               (10, [[(9.0, 9.0), (8.0, 8.0), (7.0, 6.0)]])]
    path = write_shapes(tmp_path / "geo", records)

    class Counted:
        def __init__(self, name):
            self.data, self.reads = open(name, "rb").read(), 0

        def read_at(self, n, at):
            self.reads += 1
            return self.data[at:at + n]

    shp, shx = Counted(path), Counted(path[:-4] + ".shx")
    index = sf.np.frombuffer(shx.data[100:], ">i4").astype(sf.np.int64) * 2
    offsets, sizes = index[0::2], index[1::2]
    for gap in (1 << 16, -10**9):  # one read, or one for each record
        monkeypatch.setattr(sf, "READ_GAP", gap)
        for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
            before = shp.reads
            line, parts = sf._lines(*sf._record_bytes(shp, offsets[order], sizes[order]))
            assert shp.reads - before == (1 if gap > 0 else 4)
            want = [records[k][1] for k in order]
            assert [p and [[(v["x"], v["y"]) for v in g] for g in p] for p in parts.to_pylist()] == want
            assert [g and [(v["x"], v["y"]) for v in g] for g in line.to_pylist()] == [p[0] if p and len(p) == 1 else None for p in want]
    dot = struct.pack("<i2d", 1, 4.0, 5.0)
    line, parts = sf._lines(dot, sf.np.array([0]))
    assert line.to_pylist() == [[{"x": 4.0, "y": 5.0}]] and parts.to_pylist() == [[[{"x": 4.0, "y": 5.0}]]]
    assert [len(a) for a in sf._lines(b"", sf.np.zeros(0, sf.np.int64))] == [0, 0]


def test_ingest_and_profile(spark, own_database, tmp_path):
    seg = write(tmp_path / "wegvakken.txt", "WVK_ID;FK_VELD1;WEGNR_HMP\n1;500000;A2\n2;500001;A 2\n3;;N1\n")
    acc = write(tmp_path / "ongevallen.txt", "VKL_NUMMER;JAAR_VKL;WVK_ID\nx;2020;1\ny;2021;2\n")
    geo = write_shapes(tmp_path / "wegvakgeografie", LINES)
    cmap = ColumnMap(wegvakken=SegmentColumns(path=seg), accidents=AccidentColumns(path=acc),
                     wegvakgeografie=GeometryColumns(path=geo),
                     hectointervallen=IntervalColumns(path=str(tmp_path / "none.txt")))
    with pytest.warns(UserWarning, match="raw_nwb_hectointervallen"):
        counts = {r["table"]: r["rows"] for r in ingest_all(spark, cmap).collect()}
    assert counts == {"raw_nwb_wegvakken": 3, "raw_nwb_wegvakgeografie": 25, "raw_bron_accidents": 2}
    assert not tables_ready(spark)
    with pytest.raises(FileNotFoundError):
        ingest_all(spark, ColumnMap(accidents=AccidentColumns(path=str(tmp_path / "gone.txt"))))

    report = pf.profile(spark, [seg, geo], cmap.target)
    assert report[seg]["candidate_summary"].first()["recommended_key"] == "WEGNR_HMP = 'A2'"
    assert {r["value"] for r in report[seg]["candidates"].collect()} == {"A2", "A 2"}
    assert report[seg]["files"].first()["size_bytes"] > 0
    assert {r["column"]: r["distinct_values"] for r in report[seg]["columns"].collect()} == {
        "WVK_ID": 3, "FK_VELD1": 2, "WEGNR_HMP": 3}
    assert report[geo]["geometry_types"].where(F.col("geometry_type") == "LineString").first()["rows"] == 25
    assert report[geo]["crs"].startswith("EPSG:28992")
