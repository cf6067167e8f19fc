"""The jobs: runs over growing copies of the given tables, runs that are repeated or broken off, odd rows, command lines."""

from __future__ import annotations

import datetime
import json
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import archive_bulletins, common, follow_scans, queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(frame):
    return Counter(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())


def twin(sql, **tables):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name, path in tables.items():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return Counter(tuple(r[i] for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    tables = {n.removesuffix(".parquet"): f"{SF}/{n}" for n in os.listdir(SF)}
    settings = lambda: [spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")]
    before = settings()
    assert rows(queries.QUERIES[name](spark, SF)) == twin(queries.ORACLES[name], **tables)
    assert settings() == before


def add(spark, table, folder, part, keep):
    """A further file of a growing table, appended by Spark."""
    table.filter(keep).coalesce(1).write.mode("append").parquet(folder)


def test_only_new_notices_are_taken(spark, tmp_path):
    events, folder = spark.read.parquet(f"{SF}/events.parquet"), str(tmp_path / "events.parquet")
    config = follow_scans.Config(folder, str(tmp_path / "out"), str(tmp_path / "mark"), max_files=2)
    day = F.col("ts") < F.lit(datetime.datetime(2024, 1, 11, 12))
    add(spark, events, folder, 0, day & (F.col("event_id") % 5 > 0))
    first = follow_scans.follow(spark, config)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/hours").rglob("*.parquet")}
    assert first["notices"] == events.filter(day & (F.col("event_id") % 5 > 0)).count() and first["batches"] == 1
    # late notices of old days, then newer ones, in three files
    add(spark, events, folder, 1, ~day & (F.col("event_id") % 2 == 0))
    add(spark, events, folder, 2, ~day & (F.col("event_id") % 2 == 1))
    add(spark, events, folder, 3, (F.col("ts") < F.lit(datetime.datetime(2024, 1, 4))) & (F.col("event_id") % 5 == 0))
    add(spark, events, folder, 4, day & (F.col("ts") >= F.lit(datetime.datetime(2024, 1, 4))) & (F.col("event_id") % 5 == 0) & (F.col("ts") < F.lit(datetime.datetime(2024, 1, 5))))
    second = follow_scans.follow(spark, config)
    assert second["batches"] == 2
    assert rows(follow_scans.inventory(spark, config.output)) == twin(follow_scans.ORACLE, events=f"{folder}/*.parquet")
    # days that nothing new touched are the same files
    same = {p for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert {p.parent.name for p in same} == {f"day=2024-01-{d:02d}" for d in range(6, 11)}
    third = follow_scans.follow(spark, config)
    assert third["batches"] == third["notices"] == 0


def test_a_broken_batch_is_taken_again(spark, tmp_path):
    events, folder = spark.read.parquet(f"{SF}/events.parquet"), str(tmp_path / "events.parquet")
    config = follow_scans.Config(folder, str(tmp_path / "out"), str(tmp_path / "mark"))
    add(spark, events, folder, 0, F.col("event_id") % 2 == 0)
    follow_scans.follow(spark, config)
    add(spark, events, folder, 1, F.col("event_id") % 2 == 1)
    follow_scans.follow(spark, config)
    want = rows(follow_scans.inventory(spark, config.output))
    assert want == twin(follow_scans.ORACLE, events=f"{folder}/*.parquet")
    # the last batch wrote, but its commit was lost
    for p in (tmp_path / "mark/commits").glob("*1*"):
        p.unlink()
    again = follow_scans.follow(spark, config)
    assert again["batches"] == 1 and rows(follow_scans.inventory(spark, config.output)) == want
    assert spark.read.parquet(f"{config.output}/catalogue").count() == events.count()
    # the mark was lost: all is read again, and the result is the same
    anew = follow_scans.Config(folder, config.output, str(tmp_path / "mark2"))
    assert follow_scans.follow(spark, anew)["notices"] == events.count()
    assert rows(follow_scans.inventory(spark, config.output)) == want


def test_odd_notices(spark, tmp_path):
    at = lambda d, h, m=0: datetime.datetime(2024, 2, d, h, m)
    said = [(1, at(1, 23, 50), 0, "a", 1.0, ""), (2, at(2, 0, 5), 0, "a", 2.0, ""), (3, at(2, 0, 5), 0, "a", 9.0, ""), (3, at(2, 0, 5), 0, "a", 9.0, ""), (4, None, 0, "a", 1.0, ""), (5, at(5, 1), 0, "a", 1.0, ""), (6, at(5, 1), 0, None, 1.5, ""), (7, at(5, 1, 59), 0, None, None, ""), (8, at(7, 2), 0, None, 1.0, "")]
    folder = str(tmp_path / "events.parquet")
    spark.createDataFrame(said, EVENTS).withColumns({"site": F.lit(1), "gap": F.lit(2), "batch": F.lit("x")}).write.parquet(folder)
    config = follow_scans.Config(folder, str(tmp_path / "out"), str(tmp_path / "mark"))
    done = follow_scans.follow(spark, config)
    assert (done["notices"], done["without_time"], done["scans"]) == (9, 1, 6)
    got = rows(follow_scans.inventory(spark, config.output))
    assert got == twin(follow_scans.ORACLE, events=f"{folder}/*.parquet")
    by = {(r["day"], r["site"]): r for r in follow_scans.inventory(spark, config.output).collect()}
    assert by["2024-02-02", "a"]["longest_gap_us"] == 900_000_000 and by["2024-02-02", "a"]["loops"] == 0 and by["2024-02-02", "a"]["bytes"] == 900
    assert by["2024-02-05", "a"]["longest_gap_us"] is None and by["2024-02-05", None]["loops"] == 2


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    config = follow_scans.Config(str(tmp_path / "events.parquet"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert follow_scans.follow(spark, config)["scans"] == 0 and follow_scans.inventory(spark, config.output).collect() == []
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    other = archive_bulletins.Config(str(tmp_path / "documents.parquet"), str(tmp_path / "kept"))
    assert archive_bulletins.archive(spark, other)["read"] == 0 and archive_bulletins.manifest(spark, other.output).collect() == []


def test_bulletins_with_odd_rows(spark, tmp_path):
    said = [(i, f"text {i % 40} " + "x" * (i % 8), "en", f"s{i % 3}", 0) for i in range(400)]
    said += [(7, "another text of one id", "en", "s1", 0), (7, "another text of one id", "en", "s1", 0), (8, None, None, None, None), (9, "", None, "", None), (None, "text 3", "en", "s1", 0), (None, "without an id", "en", None, 0), (500, "y" * 300_000, "fr", "s4", 1), (600, "text 3", "fr", "s9", 1)]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(said, DOCS).withColumns({"bytes": F.lit(1), "sha256": F.lit("x"), "outcome": F.lit(0)}).repartition(3).write.parquet(folder)
    config = archive_bulletins.Config(folder, str(tmp_path / "out"))
    first = archive_bulletins.archive(spark, config)
    got = rows(archive_bulletins.manifest(spark, config.output))
    assert got == twin(archive_bulletins.ORACLE, documents=f"{folder}/*.parquet")
    assert archive_bulletins.archive(spark, config) == first and rows(archive_bulletins.manifest(spark, config.output)) == got
    texts = spark.read.schema(archive_bulletins.ARCHIVE).parquet(f"{config.output}/archive").collect()
    assert len(texts) == first["kept"] == len({r["sha256"] for r in texts}) and first["copy"] > 300


@pytest.mark.parametrize(("share", "newest"), [(0.5, 20), (0.0, 5), (1.0, 0)])
def test_quota_holds(spark, tmp_path, share, newest):
    config = archive_bulletins.Config(f"{SF}/documents.parquet", str(tmp_path / "out"), share, newest)
    done = archive_bulletins.archive(spark, config)
    out = archive_bulletins.manifest(spark, config.output)
    docs = {r["doc_id"]: r for r in spark.read.parquet(config.documents).collect()}
    seen, kept, pruned = {}, {}, []
    for i in sorted(docs):
        seen.setdefault(docs[i]["text"], i)
    size = lambda i: len((docs[i]["text"] or "").encode())
    firsts = sorted(seen.values())
    total = sum(map(size, firsts))
    last = {docs[i]["source"]: i for i in firsts}
    left = total
    for i in firsts:
        if left > int(total * share) and i != last[docs[i]["source"]] and i <= max(firsts) - newest:
            pruned.append(i)
            left -= size(i)
        else:
            kept[i] = size(i)
    assert sorted(r["doc_id"] for r in out.filter("outcome = 'pruned'").collect()) == pruned
    assert sorted(r["doc_id"] for r in out.filter("stored").collect()) == sorted(kept) and done["kept_bytes"] == sum(kept.values())


def test_command_line(tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"documents": f"{SF}/documents.parquet", "quota_share": 0.5}))
    command = [sys.executable, "-m", "jobs.archive_bulletins", "--config", str(config), "--output", str(tmp_path / "out"), "--keep-newest", "7"]
    ran = subprocess.run(command, cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300, check=True)
    assert "jobs.archive_bulletins" in ran.stderr and "pruned" in ran.stderr or "__main__" in ran.stderr
    assert list((tmp_path / "out/archive").rglob("source=*/lang=*/*.parquet"))


def test_configs():
    for name, module in (("follow_scans", follow_scans), ("archive_bulletins", archive_bulletins)):
        held = json.loads((ROOT / f"jobs/{name}.json").read_text())
        paths = {"input": "i", "output": "o", "checkpoint": "c"} if name == "follow_scans" else {"documents": "d", "output": "o"}
        assert common.config_of(module.Config, str(ROOT / f"jobs/{name}.json"), paths) == module.Config(**paths, **held)
    with pytest.raises(ValueError, match="unknown settings: no"):
        common.config_of(follow_scans.Config, None, {"no": 1})
