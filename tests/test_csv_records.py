import io
import os
import random

import pytest

from colscope.sources import csv_records, csv_tables, scan
from colscope.sources.scan import scan_file, scan_folder


def _cell(rng, sep, end):
    text = "".join(rng.choice(["a", "b", " ", sep, '""', end, "é", end + end]) for _ in range(rng.randint(0, 8)))
    odd = ["", '""', 'in"ch', '"a"b', '"a" "b', ' "q', '"a" ', "1", " x ", "z"]
    return f'"{text}"' if rng.random() < 0.45 else rng.choice(odd)


def _text(rng, sep, end, left_open):
    lines = [sep.join(["h1", "h2", "h3"])]
    for _ in range(rng.randint(0, 40)):
        lines.append(sep.join(_cell(rng, sep, end) for _ in range(rng.choice([2, 3, 3, 3, 4]))))
        lines += [""] * (rng.random() < 0.1)
    return end.join(lines) + rng.choice(["", end]) + (f'{end}1{sep}"open{end}x{end}' if left_open else "")


@pytest.mark.parametrize("range_bytes", [1, 40])
@pytest.mark.parametrize("sep, end, encoding", [(",", "\n", "UTF-8"), (";", "\r\n", "ISO-8859-1"), ("\t", "\r", "UTF-8")])
def test_split_reads_equal_whole_reads(spark, tmp_path, sep, end, encoding, range_bytes):
    """Quotes of every sort, ranges shorter than a record or a line: the rows of Spark's reader, which takes a file whole."""
    rng = random.Random(f"{sep}{range_bytes}")
    paths = []
    for i in range(4):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(_text(rng, sep, end, left_open=i == 3).encode(encoding))
        paths.append(str(path))
    files = [(f"file://{p}", os.path.getsize(p)) for p in paths]
    whole, names = csv_tables.read_csv(spark, paths, encoding, sep, True)
    split, same_names = csv_records.read_split(spark, files, paths, encoding, sep, range_bytes)
    assert [*names, csv_tables.CONTRADICTED] == same_names
    assert sorted(map(repr, split.drop(csv_records.PATH, f"_{len(names)}").collect())) == sorted(map(repr, whole.collect()))
    assert {r[0] for r in split.select(csv_records.PATH).distinct().collect()} <= {u for u, _ in files}


def test_a_spanning_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("id,text\n" + "".join(f'{i},"first {i}\nsecond, ""{i}"""\n' for i in range(5000)))
    size = path.stat().st_size
    frame, _ = csv_records.read_split(spark, [(f"file://{path}", size)], [str(path)], "UTF-8", ",", size // 15)
    found = frame.selectExpr("*", "spark_partition_id() AS task").collect()
    assert {(r["_0"], r["_1"]) for r in found} == {(str(i), f'first {i}\nsecond, "{i}"') for i in range(5000)}
    assert len(found) == 5000 and len({r.task for r in found}) > 4


def test_scan_of_spanning_files(spark, tmp_path, monkeypatch):
    """Several files of one header, in one scan, each told apart; a folder of parts; equal to the unsplit scan."""
    for i in range(3):
        (tmp_path / f"t{i}.csv").write_text("id,text\n" + "".join(f'{k},"l{k % 7}\nm"\n' for k in range(20 * (i + 1))))

    def found(layout):
        columns = "file_name", "column_name", "data_type", "null_count", "unique_count", "total_rows"
        return sorted(scan_folder(spark, str(tmp_path), layout=layout).schema_info.select(*columns).collect())

    monkeypatch.setattr(csv_records, "RANGE", 500)
    split = {layout: found(layout) for layout in ("file", "folder")}
    monkeypatch.setattr(csv_records, "reachable", lambda uri: False)
    assert split == {layout: found(layout) for layout in ("file", "folder")}
    assert [r.total_rows for r in split["file"]] == [20, 20, 40, 40, 60, 60]


class Endless(io.RawIOBase):
    """A file of 10 TB that counts what is read of it."""

    def __init__(self, header, line):
        self.header, self.line, self.at, self.read_bytes = header, line, 0, 0

    def seek(self, at, whence=0):
        self.at = at

    def read(self, size=-1):
        assert 0 < size < 1 << 24
        text = self.header + self.line * (2 + (self.at + size) // len(self.line)) if self.at < 1 << 24 else self.line * size
        block = text[self.at:self.at + size]
        self.at += len(block)
        self.read_bytes += len(block)
        return block


def test_heads_read_a_bounded_part():
    source = Endless(b"id;text\n", b'1;"two\nlines \xc3\xa9"\n')
    assert csv_records._dialect(source, 1000) == ("UTF-8", ";", True, "id;text")
    records = [r for r, _ in csv_records._head(source, 1000, ";", True)]
    assert len(records) == 1001 and records[-1] == b'1;"two\nlines \xc3\xa9"'
    assert source.read_bytes < 10 * csv_records.BLOCK


def test_sampled_scans_of_csv(spark, tmp_path, monkeypatch):
    """The first rows of many files in one job, in file order; what comes later in a file plays no part."""
    for i in range(5):
        lines = [f'{k},"a\nb{k}"' for k in range(10 * i)]
        (tmp_path / f"t{i:02d}.csv").write_text("\n".join(["id,text", *lines]))
    (tmp_path / "late.csv").write_bytes(b"n;m\n1;2\n\n3;4\n5;\xe9\n6;\"x\ny\"\n")
    (tmp_path / "early.csv").write_bytes("é\tm\nü\t2\n".encode("latin-1"))
    (tmp_path / "blank.csv").write_text("\n \n\n")
    found = scan_folder(spark, str(tmp_path), sample_rows=25)
    counts = {(r.file_name, r.column_name): (r.total_rows, r.unique_count) for r in found.schema_info.collect()}
    for i in range(5):
        n = min(25, 10 * i)
        assert counts[(f"t{i:02d}.csv", "id")] == counts[(f"t{i:02d}.csv", "text")] == (n, n)
    assert counts[("late.csv", "m")] == (4, 4) and counts[("early.csv", "é")] == (1, 1)
    assert [r.file_name for r in found.rejected.collect()] == ["blank.csv"]
    two = {r.column_name: (r.data_type, r.total_rows) for r in scan_file(spark, f"{tmp_path}/late.csv", sample_rows=2).collect()}
    assert two == {"n": ("integer", 2), "m": ("integer", 2)}
    folder = scan_folder(spark, str(tmp_path), layout="folder", sample_rows=7).schema_info
    assert {r.total_rows for r in folder.collect()} == {7}
    monkeypatch.setattr(csv_records, "reachable", lambda uri: False)  # by Spark's reader, of a scheme Arrow does not know
    by_spark = scan_folder(spark, str(tmp_path), sample_rows=25).schema_info
    assert counts == {(r.file_name, r.column_name): (r.total_rows, r.unique_count) for r in by_spark.collect()}


def test_a_first_line_that_is_blank(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\na;b\n1;2\n")
    sampled = {r.column_name: r.total_rows for r in scan_file(spark, f"{tmp_path}/a.csv", sample_rows=5).collect()}
    assert sampled == {"a": 1, "b": 1}
    assert scan.PATH == csv_records.PATH


def test_lines_read_with_marks_equal_whole_reads(spark, tmp_path):
    """Quotes that stay within their line: the rows of Spark's reader, and no mark."""
    rng = random.Random(3)
    paths = []
    for i in range(3):
        lines = [",".join(_cell(rng, ",", "") for _ in range(rng.choice([2, 3, 4]))) for _ in range(60)]
        path = tmp_path / f"{i}.csv"
        path.write_text("\n".join(["h1,h2,h3", *(line for line in lines if not csv_records.open_after(line.encode(), False, ","))]))
        paths.append(str(path))
    whole, names = csv_tables.read_csv(spark, paths)
    lines, _ = csv_tables.read_lines(spark, paths, "UTF-8", ",", csv_records.PATH)
    assert sorted(map(repr, lines.drop(csv_records.PATH, f"_{len(names)}").collect())) == sorted(map(repr, whole.collect()))


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_only_contradicted_files_are_probed_in_full(spark, tmp_path, monkeypatch, layout):
    """What a head does not show (an open quote, another encoding) shows in the profile; those files alone are read again."""
    plain = "".join(f"{i},x{i}\n" for i in range(200))
    late = {
        "plain": plain,
        "quote": plain + '200,"two\nlines"\n',
        "latin": plain + "200,\xfc\n",
        "both": '0,"a\nb"\n' + plain + "201,\xfc\n",
        "inch": plain + '200,12" pipe\n',
    }
    for name, text in late.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csv").write_bytes(("id,name\n" + text).encode("latin-1"))
    probed, probe = [], csv_tables.probe
    monkeypatch.setattr(csv_tables, "probe", lambda spark, paths: probed.extend(paths) or probe(spark, paths))
    found = scan_folder(spark, str(tmp_path), layout=layout)
    names = {r.file_name.removesuffix(".csv"): (r.data_type, r.null_count, r.unique_count, r.total_rows)
             for r in found.schema_info.filter("column_name = 'name'").collect()}
    assert names == {
        "plain": ("string", 0, 200, 200), "quote": ("string", 0, 201, 201), "latin": ("string", 0, 201, 201),
        "both": ("string", 0, 202, 202), "inch": ("string", 0, 201, 201),
    }
    assert {r.column_name for r in found.schema_info.collect()} == {"id", "name"} and found.rejected.count() == 0
    assert {p.split("/")[-1].removesuffix(".csv") for p in probed} == {"quote", "latin", "both"}
