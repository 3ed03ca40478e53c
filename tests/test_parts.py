"""Profiles per part: only changed parts are read again, and united sketches stay near the exact counts."""

import os

import pandas as pd
import pytest

from colscope.sources import discovery, scan
from colscope.sources.part_store import PartStore


@pytest.fixture
def lake(tmp_path):
    def write(name, first, last, **extra):
        path = tmp_path / "lake" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        ids = list(range(first, last))
        frame = pd.DataFrame({"id": ids, "word": [f"w{i % 700}" if i % 5 else None for i in ids], "half": [i / 2 for i in ids]} | extra)
        frame.to_parquet(path) if name.endswith("parquet") else frame.to_csv(path, index=False)
        return path

    write.root = str(tmp_path / "lake")
    write.store = str(tmp_path / "store")
    return write


def rows_of(frame):
    return {(r.file_name, r.column_name): r for r in frame.collect()}


def agrees(united, exact):
    united, exact = rows_of(united), rows_of(exact)
    assert united.keys() == exact.keys()
    for key, row in exact.items():
        found = united[key]
        same = ["file_path", "data_type", "null_count", "total_rows", "file_size_mb"]
        assert [found[c] for c in same] == [row[c] for c in same], key
        assert abs(found.unique_count - row.unique_count) <= max(0.08 * row.unique_count, 1), key


def test_united_parts_agree_with_a_scan_of_folders(spark, lake):
    for i in range(4):
        lake(f"typed/p={i}/a.parquet", 3_000 * i, 3_000 * i + 5_000)
        lake(f"cells/{i}.csv", 2_000 * i, 2_000 * i + 4_000)
    store = PartStore(spark, lake.store, lake.root)
    assert store.refresh().rejected.count() == 0
    agrees(store.tables().schema_info, scan.scan_folder(spark, lake.root, layout=discovery.TABLE_PER_FOLDER).schema_info)
    agrees(store.tables(discovery.TABLE_PER_FILE).schema_info, scan.scan_folder(spark, lake.root).schema_info)
    again = store.compacted(lake.store + "-compact").tables().schema_info
    agrees(again, scan.scan_folder(spark, lake.root, layout=discovery.TABLE_PER_FOLDER).schema_info)


def test_only_changed_parts_are_read(spark, lake):
    for i in range(3):
        lake(f"t/{i}.parquet", 1_000 * i, 1_000 * i + 1_000)
    store = PartStore(spark, lake.store, lake.root)
    assert {r.file_name for r in store.refresh().schema_info.collect()} == {"0.parquet", "1.parquet", "2.parquet"}
    assert store.refresh().schema_info.count() == 0
    lake("t/1.parquet", 5_000, 5_500)
    lake("t/3.parquet", 9_000, 9_100)
    os.remove(lake.root + "/t/0.parquet")
    assert {r.file_name for r in store.refresh().schema_info.collect()} == {"1.parquet", "3.parquet"}
    found = store.tables().schema_info
    agrees(found, scan.scan_folder(spark, lake.root, layout=discovery.TABLE_PER_FOLDER).schema_info)
    assert rows_of(found)["t", "id"].total_rows == 1_600


def test_kinds_and_missing_columns_of_parts_are_united(spark, lake):
    lake("t/0.csv", 0, 10)
    lake("t/1.csv", 10, 20, id=["x"] * 10, more=[True] * 10)
    store = PartStore(spark, lake.store, lake.root)
    store.refresh()
    found = rows_of(store.tables().schema_info)
    assert (found["t", "id"].data_type, found["t", "id"].unique_count) == ("string", 11)
    assert (found["t", "more"].data_type, found["t", "more"].null_count, found["t", "more"].unique_count) == ("boolean", 10, 1)


def test_clashing_damaged_empty_and_no_parts(spark, lake):
    os.makedirs(lake.root)
    store = PartStore(spark, lake.store, lake.root)
    assert store.refresh().schema_info.count() == 0 and store.tables().schema_info.count() == 0
    lake("clash/0.parquet", 0, 10)
    lake("clash/1.parquet", 0, 10, id=["a"] * 10)
    lake("none/0.parquet", 0, 0)
    lake("none/1.csv", 0, 0)
    good = lake("good/0.parquet", 0, 10)
    store.refresh()
    tables = store.tables()
    assert [(r.file_name, r.reason) for r in tables.rejected.collect()] == [("clash", "parts clash: id is integer and string")]
    found = rows_of(tables.schema_info)
    assert found["good", "id"].unique_count == 10 and {k[0] for k in found} == {"good", "none"}
    assert {r.total_rows for k, r in found.items() if k[0] == "none"} == {0}
    good.write_bytes(b"PAR1 no longer")
    assert [r.file_name for r in store.refresh().rejected.collect()] == ["0.parquet"]
    assert ("good", "id") not in rows_of(store.tables().schema_info)
    lake("good/0.parquet", 0, 20)
    store.refresh()
    assert rows_of(store.tables().schema_info)["good", "id"].total_rows == 20
