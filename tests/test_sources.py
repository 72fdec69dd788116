import functools
import gzip
import hashlib
import io
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tributary import session
from tributary.sources import accounts, ranges
from tributary.sources import fingerprint as fp
from tributary.sources import tables as t


@pytest.fixture()
def folder(spark, tmp_path):
    root = tmp_path / "data"
    df = spark.range(30).select("id", F.concat(F.lit('say "x", '), F.col("id").cast("string")).alias("name"))
    df.repartition(3).write.parquet(str(root / "people"))
    t.write_csv(df.limit(5), str(root / "notes"))
    df.coalesce(1).toPandas().to_parquet(root / "shops-2024.parquet")
    return str(root)


def test_tables_are_named_by_folder_or_file(spark, folder):
    found = {r["table"]: r["files"] for r in t.table_summary(spark, folder).collect()}
    assert found == {"people": 3, "notes": found["notes"], "shops": 1}
    tables = t.read_folder(spark, folder)
    assert {n: df.count() for n, df in tables.items()} == {"people": 30, "notes": 5, "shops": 30}
    assert tables["notes"].schema["id"].dataType.simpleString() in ("int", "bigint")
    assert tables["notes"].orderBy("id").first()["name"] == 'say "x", 0'


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        t.discover_tables(spark, str(tmp_path))


def test_corrupt_files_are_skipped_on_request(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "bad.parquet").write_bytes(b"nothing")
    schema = spark.range(1).schema
    assert t.read_table(spark, str(tmp_path / "t"), schema=schema, skip_corrupt=True).count() == 5
    with pytest.raises(Exception):
        t.read_table(spark, str(tmp_path / "t"), schema=schema).count()


def test_sample_does_not_depend_on_layout(spark):
    df = spark.range(500)
    first = sorted(r[0] for r in t.sample_rows(df, 20, "id").collect())
    assert first == sorted(r[0] for r in t.sample_rows(df.repartition(13), 20, "id").collect())
    assert first != list(range(20))
    assert t.sample_rows(df, 0, "id") is df


def test_row_guard(spark):
    assert t.row_guard(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError):
        t.row_guard(spark.range(11), 10)


def test_union_fills_absent_columns(spark):
    a, b = spark.range(1).withColumn("x", F.lit("q")), spark.range(2)
    assert [tuple(r) for r in t.union_rows(a, b, b).orderBy("id", "x").collect()][0] == (0, None)
    assert t.union_rows(a, b, b).count() == 5


@pytest.mark.parametrize("block", [8 << 20, 2])
def test_data_fingerprint_follows_contents(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(fp, "file_tokens", functools.partial(fp.file_tokens, block_bytes=block))
    for name in ("one", "two"):
        (tmp_path / name / "t").mkdir(parents=True)
        (tmp_path / name / "t" / "a.txt").write_text("same\nline")
        (tmp_path / name / "t" / "b.txt").write_text("")
    digest = lambda root, token="sha256": fp.data_fingerprint(spark, str(root), token).first()["fingerprint"]
    assert digest(tmp_path / "one") == digest(tmp_path / "two")  # relative paths
    (tmp_path / "two" / "t" / "a.txt").write_text("diff\nline")
    assert digest(tmp_path / "one") != digest(tmp_path / "two")
    assert digest(tmp_path / "one", token="size") == digest(tmp_path / "two", token="size")
    os.utime(tmp_path / "two" / "t" / "a.txt", (1, 1))
    assert digest(tmp_path / "one", token="stat") != digest(tmp_path / "two", token="stat")


def test_manifest_equals_hashlib(spark, folder):
    found = {r["table"]: r for r in fp.file_manifest(spark, folder, "sha256").collect()}
    for table, row in found.items():
        root = Path(folder)
        at_root = [p for p in root.glob("*.parquet") if p.name.startswith(table)]
        files = at_root or [p for p in (root / table).rglob("*") if p.name[0] not in "._"]
        entries = [f"{p.relative_to(root)}:{hashlib.sha256(p.read_bytes()).hexdigest()}:{p.stat().st_size}" for p in files]
        hashes = [hashlib.md5(e.encode()).hexdigest() for e in entries]
        sums = [len(hashes), *(sum(int(h[i : i + 8], 16) for h in hashes) for i in (0, 8, 16, 24))]
        assert row["fingerprint"] == hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()
        assert (row["files"], row["bytes"]) == (len(files), sum(p.stat().st_size for p in files))


def slow_tree(data, block, fan):
    nodes = [hashlib.sha256(data[i : i + block]).digest() for i in range(0, max(len(data), 1), block)]
    while len(nodes) > 1:
        nodes = [hashlib.sha256(b"".join(nodes[i : i + fan])).digest() for i in range(0, len(nodes), fan)]
    return nodes[0].hex()


@pytest.mark.parametrize("schemes", [ranges.SCHEMES, {}])
def test_content_digests_equal_hashlib_on_blocks(spark, tmp_path, monkeypatch, schemes):
    """Read by the tasks themselves, and by Spark where tasks know no way to a file."""
    monkeypatch.setattr(ranges, "SCHEMES", schemes)
    rng = random.Random(1)
    contents = {f"t/{n} ä+%.bin": rng.randbytes(n) for n in (1, 99, 100, 101, 300, 400, 1_000, 5_321)}
    (tmp_path / "t").mkdir()
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = t.discover_tables(spark, str(tmp_path))
    found = fp.content_digests(spark, str(tmp_path), files.select("path", "length"), block_bytes=100, fan_out=3)
    got = {r["relative_path"]: r["digest"] for r in files.join(found, "path").collect()}
    assert got == {name: slow_tree(data, 100, 3) for name, data in contents.items()}


def test_digest_sees_order_at_any_length(spark, tmp_path):
    for name, lines in (("one", ["a", "b", "c"]), ("two", ["b", "a", "c"])):
        (tmp_path / name / "t").mkdir(parents=True)
        (tmp_path / name / "t" / "x.txt").write_text("\n".join(lines * 1_000))
    tokens = [fp.file_tokens(spark, str(tmp_path / n), "sha256", block_bytes=b).first()["token"] for n in ("one", "two") for b in (64, 1 << 20)]
    assert len(set(tokens)) == 4


def test_no_task_reads_a_whole_large_file(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.bin").write_bytes(bytes(10_000))
    files = t.discover_tables(spark, str(tmp_path)).select("path", "length")
    sizes = [len(r["blocks"]) for r in ranges.all_blocks(files, 100).collect()]
    assert sum(sizes) == 100 and max(sizes) == ranges.AT_ONCE


@pytest.fixture()
def damaged(spark, tmp_path):
    """A folder with whole, empty, cut and broken files."""
    root = tmp_path / "in"
    spark.range(40).selectExpr("id", "cast(id * 7 as string) AS name").repartition(2).write.parquet(str(root / "facts"))
    spark.range(0).selectExpr("id", "cast(id AS string) AS name").coalesce(1).write.parquet(str(root / "none"))
    (root / "facts" / "bad one.parquet").write_bytes(b"nothing at all")
    whole = next((root / "facts").glob("part-*.parquet")).read_bytes()
    (root / "facts" / "half.parquet").write_bytes(whole[: len(whole) // 2])
    # The footer is whole, the pages are not.
    spoilt = bytearray(whole)
    spoilt[4:60] = b"\xff" * 56
    (root / "facts" / "spoilt.parquet").write_bytes(bytes(spoilt))
    (root / "notes.csv").write_text("k,v\n1,x\n2,y\n")
    (root / "head.csv").write_text("k,v\n")
    (root / "zero.csv").write_text("")  # Spark lists no files without bytes
    (root / "cut.csv.gz").write_bytes(gzip.compress(b"k,v\n" + b"1,x\n" * 1_000)[:30])
    return str(root)


def test_broken_files_are_named(spark, damaged):
    found = {r["relative_path"]: r for r in accounts.account_files(spark, damaged).collect()}
    status = {n: r["status"] for n, r in found.items()}
    parts = [n for n in status if "part-" in n]
    assert {status[n] for n in parts if n.startswith("facts")} == {"read"} and sum(found[n]["rows"] for n in parts) == 40
    assert [status[n] for n in parts if n.startswith("none")] == ["empty"]
    odd = {n: s for n, s in status.items() if n not in parts}
    assert odd == {
        "facts/bad one.parquet": "unreadable", "facts/half.parquet": "unreadable", "facts/spoilt.parquet": "cut short",
        "notes.csv": "read", "head.csv": "empty", "cut.csv.gz": "unreadable",
    }
    assert "Parquet" in found["facts/half.parquet"]["reason"]


@pytest.mark.parametrize(("schemes", "whole", "longest"), [(("file",), 64 << 20, 13), ((), 64 << 20, 2**31 - 1), ((), 13, 13)])
def test_no_whole_contents_of_long_files_are_read(spark, damaged, monkeypatch, schemes, whole, longest):
    """By tasks; on other stores by Spark, short ones whole and long ones by its readers. ``longest`` stands for Spark's 2 GiB."""
    (Path(damaged) / "facts" / "odd [1] {a,b}*+%.parquet").write_bytes(b"nothing at all")
    monkeypatch.setattr(accounts, "OPENED", schemes)
    monkeypatch.setattr(accounts, "WHOLE_BYTES", whole)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", longest)
    try:
        found = {r["relative_path"]: r for r in accounts.account_files(spark, damaged).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    status = {n: r["status"] for n, r in found.items() if "part-" not in n}
    assert status == {
        "facts/bad one.parquet": "unreadable", "facts/odd [1] {a,b}*+%.parquet": "unreadable", "facts/half.parquet": "unreadable",
        "facts/spoilt.parquet": "cut short", "notes.csv": "read", "head.csv": "empty", "cut.csv.gz": "unreadable",
    }
    parts = [found[n] for n in found if "part-" in n]
    assert sorted(r["status"] for r in parts) == ["empty", "read", "read"] and sum(r["rows"] for r in parts) == 40
    assert {n for n, r in found.items() if r["reason"]} == {n for n, s in status.items() if s == "unreadable"}


def test_only_files_without_rows_are_opened(spark, damaged, monkeypatch):
    seen = []
    monkeypatch.setattr(accounts, "OPENED", ())
    monkeypatch.setattr(accounts, "_read_by_spark", lambda s, files, read=accounts._read_by_spark: seen.extend(files) or read(s, files))
    accounts.account_files(spark, damaged).collect()
    names = {Path(r["path"]).name for r in seen}
    assert {n for n in names if "part-" not in n} == {"bad one.parquet", "half.parquet", "spoilt.parquet", "head.csv", "cut.csv.gz"}
    assert [Path(r["path"]).parent.name for r in seen if "part-" in r["path"]] == ["none"]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_ends_of_zipped_text_are_found_in_pieces(monkeypatch, chunk):
    monkeypatch.setattr(accounts, "CHUNK", chunk)
    for text in (b"", b"k,v\n", b"1,x\n" * 5_000, random.Random(3).randbytes(2_000)):
        data = gzip.compress(text)
        assert not accounts._ends_early(io.BytesIO(data))
        assert all(accounts._ends_early(io.BytesIO(data[:n])) for n in (0, 2, len(data) // 2, len(data) - 8, len(data) - 1))


def test_reading_a_damaged_folder_warns_and_keeps_the_rest(spark, damaged):
    with pytest.warns(UserWarning) as told:
        tables, report = accounts.read_folder_checked(spark, damaged, schemas={"cut": t.T.StructType.fromDDL("k int, v string")})
    said = " ".join(str(w.message) for w in told)
    assert all(n in said for n in ("bad one.parquet", "half.parquet", "spoilt.parquet", "cut.csv.gz")) and "notes" not in said
    assert tables["facts"].count() >= 40 and report.where("status = 'read'").count() == 3


def test_rows_are_estimated_without_a_scan(spark, tmp_path):
    rng = random.Random(2)
    spark.range(1_234).repartition(3).write.parquet(str(tmp_path / "facts"))
    for part in range(3):
        lines = "".join(f"{i},{'v' * rng.randint(1, 60)}\n" for i in range(20_000))
        (tmp_path / f"long_{part}").mkdir(exist_ok=True)
        (tmp_path / f"long_{part}" / "a.csv").write_text("k,v\n" + lines)
    (tmp_path / "small.csv").write_text("k,v\n1,2\n3,4")
    with gzip.open(tmp_path / "zipped.json.gz", "wt") as f:
        f.write("{}\n")
    found = {r["table"]: r for r in accounts.estimate_rows(spark, str(tmp_path), sample_bytes=100_000, block_bytes=4_096).collect()}
    assert (found["facts"]["rows"], found["facts"]["method"]) == (1_234, "footers")
    assert (found["small"]["rows"], found["small"]["method"]) == (2, "lines")
    assert (found["zipped"]["rows"], found["zipped"]["method"]) == (None, "unknown")
    for part in range(3):
        r = found[f"long_{part}"]
        assert r["method"] == "sample" and r["low"] <= 20_000 <= r["high"] and r["high"] < 1.2 * r["rows"]


def test_load_guard_names_tables(spark):
    rows = spark.createDataFrame([("a", 10, 8), ("b", 30, 25)], "table string, rows long, low long")
    assert accounts.load_guard(rows, 25) is rows
    with pytest.raises(ValueError, match=r"b \(30\)$"):
        accounts.load_guard(rows, 20)


def test_partitioned_compressed_and_odd_files(spark, tmp_path, monkeypatch):
    spark.range(6).selectExpr("id", "id % 2 AS day").write.partitionBy("day").parquet(str(tmp_path / "in" / "facts"))
    (tmp_path / "in" / "zipped").mkdir()
    with gzip.open(tmp_path / "in" / "zipped" / "a.csv.gz", "wt") as f:
        f.write("k,v\n1,x\n2,y\n")
    spark.range(3).toPandas().to_parquet(tmp_path / "in" / "UP.PARQUET")
    (tmp_path / "in" / "zipped" / "notes.doc").write_text("?")
    with pytest.warns(UserWarning, match="1 files of zipped"):
        tables = t.read_folder(spark, str(tmp_path / "in"))
    assert {n: d.count() for n, d in tables.items()} == {"facts": 6, "zipped": 2, "UP": 3}
    assert sorted(tables["facts"].columns) == ["day", "id"]
    assert tables["facts"].where("day = 1").count() == 3


def test_relative_root(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "in" / "facts"))
    relative = os.path.relpath(tmp_path / "in")
    assert [r["table"] for r in t.table_summary(spark, relative).collect()] == ["facts"]


def test_content_fingerprint_ignores_order_but_not_copies(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 3 == 0, F.col("id")))
    digest = lambda d: fp.content_fingerprint(d).first()["fingerprint"]
    assert digest(df) == digest(df.repartition(9).select("x", "id"))
    assert digest(df) != digest(df.unionAll(df))
    assert digest(df) != digest(df.withColumn("x", F.col("x") + 1))


def test_durable_uses_the_configured_folder(spark):
    out = session.durable(spark.range(3), "check")
    assert spark.conf.get("spark.checkpoint.dir") in out.inputFiles()[0]
    assert out.count() == 3
