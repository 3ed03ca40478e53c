import hashlib
import math
import os
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colscope.functions import labels
from colscope.operators.profile import profile
from colscope.sources import discovery, exports, scan
from colscope.sources.catalog_store import CatalogStore
from colscope.sources.csv_tables import column_names
from colscope.sources.scan import scan_file, scan_folder
from colscope.streaming.rescan import rescan_arrivals


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    files = {
        "a.csv": b'id,name,Name,price,flag,gap,allnull\n1,"x ""q""",1,1.50,TRUE,1,\n2,"l1\nl2",01,1.5,false,,\n3,None,1.0,2,True,3,NA\n',
        "header.csv": b"a,b,a\n",
        "semi.CSV": b"a;b\n1,5;2\n",
        "tab.csv": b"a\tb\n1\t2\n",
        "latin.csv": "n,é\nü,1\n".encode("latin-1"),
        "booleans.csv": b"flag,mixed\ntrue,1\n,yes\n",
        "sub dir/a.csv": b"id,z\n1,2\n",
        "bad.parquet": b"PAR1 nope",
        "notes.txt": b"hello",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    spark.range(5).selectExpr("id AS orderId", "id % 2 AS orderID2").coalesce(1).write.parquet(str(root / "part.parquet"))
    return str(root)


def rows(frame, name):
    return {
        r.column_name: (r.data_type, r.null_count, r.unique_count, r.total_rows)
        for r in frame.collect()
        if r.file_path.endswith(name)
    }


@pytest.fixture(scope="module")
def scanned(spark, lake):
    return scan_folder(spark, lake, labels_mode=labels.REFERENCE)


def test_discovery(spark, lake):
    found = {(r.file_name, r.format) for r in discovery.discover(spark, lake).collect()}
    assert ("semi.CSV", "csv") in found and ("bad.parquet", "parquet") in found
    assert not [n for n, _ in found if n.endswith(".txt")]


def test_inference_quoting_and_missing_tokens(scanned):
    assert rows(scanned.schema_info, "lake0/a.csv") == {
        "id": ("integer", 0, 3, 3),
        "name": ("string", 1, 2, 3),
        "Name": ("float", 0, 1, 3),
        "price": ("float", 0, 2, 3),
        "flag": ("boolean", 0, 2, 3),
        "gap": ("float", 1, 2, 3),
        "allnull": ("float", 3, 0, 3),
    }
    assert rows(scanned.schema_info, "booleans.csv") == {
        "flag": ("string", 1, 1, 2),
        "mixed": ("string", 0, 2, 2),
    }


def test_dialects(scanned):
    assert rows(scanned.schema_info, "semi.CSV") == {"a": ("string", 0, 1, 1), "b": ("integer", 0, 1, 1)}
    assert rows(scanned.schema_info, "tab.csv") == {"a": ("integer", 0, 1, 1), "b": ("integer", 0, 1, 1)}
    assert rows(scanned.schema_info, "latin.csv") == {"n": ("string", 0, 1, 1), "é": ("integer", 0, 1, 1)}


def test_header_only_and_repeated_names(scanned):
    assert rows(scanned.schema_info, "header.csv") == {c: ("string", 0, 0, 0) for c in ("a", "b", "a.1")}
    assert column_names(["x", None, "x", "x.1", "x"]) == ["x", "Unnamed: 1", "x.1", "x.1.1", "x.2"]


def test_equal_names_in_two_folders_are_two_files(scanned):
    assert rows(scanned.schema_info, "sub dir/a.csv") == {"id": ("integer", 0, 1, 1), "z": ("integer", 0, 1, 1)}


def test_broken_file_is_reported_and_the_rest_goes_on(scanned):
    problems = scanned.rejected.collect()
    assert [p.file_name for p in problems] == ["bad.parquet"] and problems[0].reason


def test_native_labels_ignore_gaps(spark, lake):
    found = rows(scan_file(spark, f"{lake}/a.csv"), "a.csv")
    assert found["gap"][0] == "integer" and found["allnull"][0] == "string"


def test_samples(spark, lake):
    assert rows(scan_file(spark, f"{lake}/a.csv", sample_rows=2), "a.csv")["id"] == ("integer", 0, 2, 2)
    orders = "/root/testdata/sf0.001/orders.parquet"
    once, twice = (scan_file(spark, orders, sample_rows=100).drop("last_scanned").collect() for _ in range(2))
    assert {r.total_rows for r in once} == {100}
    assert sorted(once) == sorted(twice)


def _sampled_by_hand(n, rows):
    digests = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i in range(n))
    return {i for _, i in digests[:rows]}


@pytest.mark.parametrize("root", [math.sqrt, lambda rows: -rows / 6 - 3])
def test_seeded_samples_of_many_files(spark, tmp_path, monkeypatch, root):
    """One job for all files of a schema; right too where the first cut leaves too few rows."""
    monkeypatch.setattr(scan, "math", SimpleNamespace(sqrt=root))
    sizes = [0, 1, 7, 30, 200, 3000]
    for i, n in enumerate(sizes):
        spark.range(n).withColumnRenamed("id", "a").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        part = next((tmp_path / f"p{i}").glob("*.parquet"))
        (tmp_path / f"t{i}.parquet").write_bytes(part.read_bytes())
    files = [str(tmp_path / f"t{i}.parquet") for i in range(len(sizes))]
    found = scan.seeded_samples(spark.read.parquet(*files), 30).collect()
    by_file = {i: {r.a for r in found if r[scan.PATH].endswith(f"t{i}.parquet")} for i in range(len(sizes))}
    assert by_file == {i: _sampled_by_hand(n, 30) for i, n in enumerate(sizes)}
    assert all(r.a == r[scan.ROW] for r in found)
    whole = scan.seeded_samples(spark.read.parquet(*files), 30, per_file=False)
    assert whole.count() == 30 and sorted(whole.collect()) == sorted(whole.collect())


def test_sampled_scan_groups_tables(spark, tmp_path):
    for i in range(25):
        pq.write_table(pa.table({"a": list(range(i * 4)), "b": ["x"] * (i * 4)}), tmp_path / f"t{i:02d}.parquet")
    found = scan_folder(spark, str(tmp_path), sample_rows=10)
    assert {(r.file_name, r.column_name): (r.total_rows, r.unique_count) for r in found.schema_info.collect()} == {
        (f"t{i:02d}.parquet", c): (min(10, i * 4), min(10, i * 4) if c == "a" else min(1, i)) for i in range(25) for c in "ab"
    }
    assert found.rejected.count() == 0


def test_errors_of_a_single_file(spark, lake):
    with pytest.raises(FileNotFoundError):
        scan_file(spark, f"{lake}/absent.csv")
    with pytest.raises(ValueError, match="Unsupported"):
        scan_file(spark, f"{lake}/notes.txt")
    with pytest.raises(ValueError, match="too large"):
        scan_file(spark, "/root/testdata/sf0.001/lineitem.parquet", max_file_size_mb=0.001)


def test_size_gate(spark):
    found = scan_folder(spark, "/root/testdata/sf0.001", max_file_size_mb=0.05)
    accepted = {r.file_name for r in found.schema_info.select("file_name").distinct().collect()}
    rejected = {r.file_name for r in found.rejected.collect()}
    assert accepted and rejected and not accepted & rejected
    assert all(
        (os.path.getsize(f"/root/testdata/sf0.001/{n}") / 1048576 > 0.05) == (n in rejected) for n in accepted | rejected
    )


def test_folder_layout(spark, lake):
    found = scan_folder(spark, f"{lake}/part.parquet", layout="folder").schema_info.collect()
    assert {(r.file_name, r.column_name, r.total_rows) for r in found} == {
        ("part.parquet", "orderId", 5),
        ("part.parquet", "orderID2", 5),
    }


def test_store_round_trip(spark, make_catalog, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "catalog"))
    assert store.read().count() == 0
    store.upsert(make_catalog({"x/a.csv": {"a": "integer", "b": "string"}, "y/a.csv": {"a": "float"}}))
    store.upsert(make_catalog({"x/a.csv": {"c": "string"}}))
    assert {(r.file_path, r.column_name) for r in store.read().collect()} == {("x/a.csv", "c"), ("y/a.csv", "a")}
    store.remove(spark.createDataFrame([("y/a.csv",)], "file_path string"))
    assert [r.file_path for r in store.read().collect()] == ["x/a.csv"]
    os.makedirs(tmp_path / "catalog" / "snapshot=99")
    assert store.read().count() == 1
    held = store.read()
    smaller = store.compacted(str(tmp_path / "compacted"))
    assert store.remove_file("a.csv").count() == 0
    assert held.count() == smaller.read().count() == 1  # neither is touched by the removal
    store.upsert(make_catalog({"x/a.csv": {"d": "string"}}))
    assert [r.column_name for r in store.read().collect()] == ["d"]


def test_exports(spark, tmp_path):
    root = str(tmp_path / "exports")
    assert exports.export_large(spark.range(20), "few", root) is None
    path = exports.export_large(spark.range(21), "Show me ALL the files!", root)
    assert "query_slug=show-me-all-the-files" in path and spark.read.parquet(path).count() == 21
    assert exports.export_stats(spark, root).first().asDict() == {"total_exports": 1, "day_folders": 1}


def test_arrivals_update_the_catalog(spark, tmp_path):
    folder, store = tmp_path / "in", CatalogStore(spark, str(tmp_path / "catalog"))
    folder.mkdir()

    def arrive(name, content):
        (folder / name).write_text(content)
        rescan_arrivals(spark, str(folder), store, str(tmp_path / "progress")).awaitTermination()
        return {(r.file_name, r.column_name, r.total_rows) for r in store.read().collect()}

    assert arrive("one.csv", "a,b\n1,2\n") == {("one.csv", "a", 1), ("one.csv", "b", 1)}
    assert arrive("two.csv", "c,d\n1,2\n3,4\n") == {
        ("one.csv", "a", 1), ("one.csv", "b", 1), ("two.csv", "c", 2), ("two.csv", "d", 2)
    }


def _write_parquet(path, columns):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table(columns), path, compression="none", use_dictionary=False)


def test_a_damaged_file_rejects_only_itself(spark, tmp_path):
    for name in ("one", "two", "three"):
        _write_parquet(f"{tmp_path}/{name}.parquet", {"a": list(range(1000)), "b": [f"{name}{i}" for i in range(1000)]})
    with open(f"{tmp_path}/two.parquet", "r+b") as file:  # the footer stays whole, the pages do not
        file.seek(4)
        file.write(b"\xff" * 3000)
    found = scan_folder(spark, str(tmp_path))
    assert {r.file_name for r in found.schema_info.collect()} == {"one.parquet", "three.parquet"}
    assert [r.file_name for r in found.rejected.collect()] == ["two.parquet"]


def test_damaged_files_cost_no_further_pass(spark, tmp_path, monkeypatch):
    """Some damaged from the first page, one only towards its end, among many; a column of null and an empty file are none of them."""
    for i in range(40):
        _write_parquet(f"{tmp_path}/t{i:02d}.parquet", {"a": list(range(500 + i)), "b": [None if i == 7 else f"{i} {k}" for k in range(500 + i)]})
    _write_parquet(f"{tmp_path}/empty.parquet", {"a": pa.array([], "int64"), "b": pa.array([], "string")})
    large = pa.table({"a": list(range(60_000)), "b": [f"row {k}" for k in range(60_000)]})
    pq.write_table(large, f"{tmp_path}/late.parquet", compression="none", use_dictionary=False, row_group_size=20_000)
    late = pq.read_metadata(f"{tmp_path}/late.parquet").row_group(2).column(0).data_page_offset
    for name, place in (("t03", 4), ("t31", 4), ("late", late)):
        with open(f"{tmp_path}/{name}.parquet", "r+b") as file:
            file.seek(place)
            file.write(b"\xff" * 3000)
    passes = []
    monkeypatch.setattr(scan, "profile", lambda groups, *more: passes.append(len(groups)) or profile(groups, *more))
    found = scan_folder(spark, str(tmp_path))
    counts = {(r.file_name, r.column_name): r.total_rows for r in found.schema_info.collect()}
    whole = {f"t{i:02d}.parquet": 500 + i for i in range(40) if i not in (3, 31)} | {"empty.parquet": 0}
    assert counts == {(name, c): n for name, n in whole.items() for c in "ab"}
    reasons = {r.file_name: r.reason for r in found.rejected.collect()}
    assert reasons.keys() == {"t03.parquet", "t31.parquet", "late.parquet"}
    assert all(r.startswith("damaged: ") for r in reasons.values()) and len(passes) == 1
    with pytest.raises(ValueError, match="damaged"):
        scan_file(spark, f"{tmp_path}/t03.parquet")


def test_parts_of_a_folder_may_differ(spark, tmp_path):
    for folder in ("grown", "clash", "swapped", "wide"):
        (tmp_path / folder).mkdir()
    _write_parquet(f"{tmp_path}/grown/1.parquet", {"a": [1, 2]})
    _write_parquet(f"{tmp_path}/grown/2.parquet", {"a": [3], "extra": ["x"]})
    _write_parquet(f"{tmp_path}/clash/1.parquet", {"a": [1]})
    _write_parquet(f"{tmp_path}/clash/2.parquet", {"a": ["x"]})
    (tmp_path / "swapped/1.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "swapped/2.csv").write_text("name,id\nz,3\n")
    (tmp_path / "wide/1.csv").write_text("id,name\n1,x\n")
    (tmp_path / "wide/2.csv").write_text("id,name,more\n2,y,5\n")
    found = scan_folder(spark, str(tmp_path), layout="folder")
    assert {(r.file_name, r.column_name): (r.data_type, r.null_count, r.total_rows) for r in found.schema_info.collect()} == {
        ("grown", "a"): ("integer", 0, 3), ("grown", "extra"): ("string", 2, 3),
        ("swapped", "id"): ("integer", 0, 3), ("swapped", "name"): ("string", 0, 3),
        ("wide", "id"): ("integer", 0, 2), ("wide", "name"): ("string", 0, 2), ("wide", "more"): ("integer", 1, 2),
    }
    assert [r.file_name for r in found.rejected.collect()] == ["clash"]
    sampled = scan_folder(spark, str(tmp_path), layout="folder", sample_rows=1).schema_info
    assert {r.total_rows for r in sampled.collect()} == {1}


def test_nothing_is_lost_silently(spark, tmp_path):
    (tmp_path / "surplus.csv").write_text("id,name\n1,x,lost\n2,y\n")
    (tmp_path / "short.csv").write_text("id,name\n1\n2,y\n")
    (tmp_path / "_hidden.csv").write_text("a,b\n1,2\n")
    (tmp_path / ".dot.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "inch.csv").write_text('size,n\n12" pipe,1\n"two\nlines",2\n')
    found = scan_folder(spark, str(tmp_path))
    assert rows(found.schema_info, "short.csv") == {"id": ("integer", 0, 2, 2), "name": ("string", 1, 1, 2)}
    assert {r.file_name: r.reason for r in found.rejected.collect()} == {
        "surplus.csv": "1 rows hold more cells than the header",
        "_hidden.csv": "hidden from Spark's readers by its name",
        ".dot.csv": "hidden from Spark's readers by its name",
        "empty.csv": "No columns to parse from file",
    }
    assert rows(found.schema_info, "inch.csv")["n"] == ("integer", 0, 2, 2)


def test_estimates_of_csv_columns(spark, lake):
    exact = rows(scan_folder(spark, lake, labels_mode="reference").schema_info, "a.csv")
    estimated = rows(scan_folder(spark, lake, labels_mode="reference", exact=False).schema_info, "a.csv")
    assert estimated == exact  # so few values are counted without error


def test_hidden_and_empty_files_at_any_depth(spark, tmp_path):
    files = ["a.csv", "x/y/z/_h.csv", "x/.d/b.parquet", "x/_d/e/c.CSV", "x/k=_1/_p=2/d.csv", "x/w/.t.txt", "é ü/%41.csv"]
    for name in files:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name in ("a.csv", "x/_d/e/c.CSV", "é ü/%41.csv") else "a,b\n1,2\n")
    (tmp_path / "x/none").mkdir()
    hidden, empty = "hidden from Spark's readers by its name", "No columns to parse from file"
    expected = {
        "x/y/z/_h.csv": hidden, "x/.d/b.parquet": hidden, "x/_d/e/c.CSV": hidden, "a.csv": empty, "é ü/%41.csv": empty,
    }
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        found = discovery.unlisted(spark, folder).collect()
        assert {r.file_path: r.reason for r in found} == {f"{tmp_path}/{name}": reason for name, reason in expected.items()}
        assert all(r.file_path.endswith("/" + r.file_name) for r in found) and len(found) == len(expected)
    assert discovery.unlisted(spark, f"{tmp_path}/x/y/z/_h.csv").count() == 0
    unknown = discovery.unlisted(spark, "nowhere://host/lake").collect()
    assert [(r.file_name, r.reason.startswith("hidden and empty files are not listed")) for r in unknown] == [("lake", True)]
