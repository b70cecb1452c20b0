import json
import os
import random
import subprocess
import sys
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlloom.__main__ import main
from crawlloom.plans import golden
from crawlloom.plans.project import Project, SiteError
from crawlloom.plans.queries import QUERIES, SQL
from crawlloom.sources.config import Config, ConfigError


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_agrees_with_sql(spark, sf_dir, tables, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), tables.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators():
    code = "import sys; sys.modules['crawlloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.REPO)


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"base_url": "https://h/docs/", "max_pages": 5, "exclude_patterns": ["x+"]}))
    config = Config.load(file, max_pages=None, delay=0)
    assert (config.max_pages, config.delay, config.scope.path_prefix, config.limits().max_pages) == (5, 0, "/docs/", 5)
    for bad in ({"max_page": 1}, {"delay": -1}, {"max_pages": True}, {"max_attempts": 0}, {"keep_query": 1}, {"exclude_patterns": ["("]}, {"base_url": "ftp://h"}, {"exclude_patterns": "x"}, {"max_consecutive_failures": 0}):
        with pytest.raises(ConfigError):
            Config.of(bad)
    with pytest.raises(ConfigError, match="max_pages"):
        Config.of({"max_pagse": 1})
    with pytest.raises(ConfigError):
        Config.load(tmp_path / "none.json")


def test_project(spark, tmp_path):
    project, log = Project(spark, str(tmp_path / "sites")), golden.fetches(spark).drop("site")
    config = Config.of({"base_url": golden.BASE + "index.html", "max_attempts": 1, "delay": 0, "restrict_to_path": False, "max_pages": 3})
    run = project.new(config, log)
    assert (run.site, run.stop_reason, run.exit_code, run.counts["visited"]) == ("site.test", "max-pages", 0, 3)
    with pytest.raises(SiteError):
        project.new(config, log)
    more = Config.of({"base_url": golden.BASE + "index.html", "max_attempts": 1, "delay": 0})
    assert project.update(more, log).stop_reason == "frontier-empty"
    got = {(r.url.removeprefix(golden.BASE[:-1]), r.status, r.depth, r.attempts, r.link_count) for r in project.state("site.test").collect()}
    assert got == set(golden.STATE)
    assert project.update(more, log) is None
    out = project.export(more, str(tmp_path / "sitemap.xml"), lastmod="2024-05-06")
    assert out.url_count == 9 and "2024-05-06" in (tmp_path / "sitemap.xml").read_text()
    assert "failed: 1" in project.status(more) and [tuple(r) for r in project.sites().collect()] == [("site.test", 9, 0)]
    with pytest.raises(SiteError):
        project.new(Config.of({"base_url": "https://other.test/"}), log, name="site.test", discard=True)


def test_commands(spark, tmp_path, capsys):
    golden.fetches(spark).drop("site").write.parquet(str(tmp_path / "log"))
    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow: /products/\n")
    where = ["--sites-dir", str(tmp_path / "sites")]
    url = ["--url", golden.BASE]
    assert main(["new", *url, *where, "--log", str(tmp_path / "log"), "--delay", "0"], spark) == 1  # the base page isn't in the log
    assert main(["new", *url, *where, "--log", str(tmp_path / "log")], spark) == 2
    start = ["--url", golden.BASE + "index.html"]
    assert main(["new", *start, *where, "--log", str(tmp_path / "log"), "--robots", str(tmp_path / "robots.txt"), "--delay", "0", "--max-attempts", "1", "--yes"], spark) == 0
    assert main(["export", *where, "--output", str(tmp_path / "out.xml"), "--lastmod", "today"], spark) == 0
    assert date.today().isoformat() in (tmp_path / "out.xml").read_text() and "products/a" not in (tmp_path / "out.xml").read_text()
    assert main(["status", *where], spark) == 0 and main(["sites", *where], spark) == 0
    assert "disallowed by robots.txt" in capsys.readouterr().out
    assert main(["export", *where, "--lastmod", "someday"], spark) == 2 and main(["status", "--url", "https://none.test/", *where], spark) == 2


def test_stream_follows_batches(spark, tmp_path):
    from crawlloom.streaming import retries

    session = retries.stream_session(spark)
    rows = [("a", 1, "2024-01-01 00:00:00", False, True), ("a", 2, "2024-01-01 00:00:05", False, True), ("b", 1, "2024-01-01 00:00:00", False, False), ("c", 1, "2024-01-01 00:00:00", True, True)]
    schema = "url string, seq long, at string, ok boolean, retryable boolean"
    session.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = session.readStream.schema("url string, seq long, at timestamp, ok boolean, retryable boolean").parquet(str(tmp_path / "in"))
    out = retries.drain(session, retries.retry_states(stream), str(tmp_path))
    got = {(r.url, r.seq): (r.status, r.attempts, str(r.next_attempt_at)) for r in out.collect()}
    assert got == {("a", 1): ("queued", 1, "2024-01-01 00:00:02"), ("a", 2): ("queued", 2, "2024-01-01 00:00:13"), ("b", 1): ("failed", 1, "None"), ("c", 1): ("done", 1, "None")}


def test_stream_keeps_each_url_of_a_group(spark, tmp_path, monkeypatch):
    """A group holds several URLs, over two batches; the states are those of a plain fold."""
    from crawlloom.streaming import retries

    monkeypatch.setattr(retries, "GROUPS", 3)
    session = retries.stream_session(spark)
    r = random.Random(3)
    rows = [(None if k % 13 == 0 else f"u{r.randrange(30)}", k, r.randrange(40), r.random() < 0.2, r.random() < 0.9) for k in range(160)]
    schema = "url string, seq long, at string, ok boolean, retryable boolean"
    for batch in (0, 1):
        part = [(u, k, f"2024-01-0{1 + batch} 00:00:{at:02}", ok, again) for u, k, at, ok, again in rows if (k >= 80) == batch]
        session.createDataFrame(part, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = session.readStream.schema("url string, seq long, at timestamp, ok boolean, retryable boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = retries.drain(session, retries.retry_states(stream), str(tmp_path)).withColumn("wait", F.unix_timestamp("next_attempt_at") - F.unix_timestamp("at")).collect()
    state, want = {}, {}
    for u, k, _, ok, again in sorted(rows, key=lambda x: (x[1] >= 80, x[2], x[1])):
        n, status, _ = state.get(u, (0, "queued", None))
        if status == "queued":
            n += 1
            status = "done" if ok else "queued" if again and n < 3 else "failed"
        state[u] = want[u, k] = (n, status, {1: 2, 2: 8}[n] if status == "queued" else None)
    assert {(x.url, x.seq): (x.attempts, x.status, x.wait) for x in out} == want and len(out) == 160
