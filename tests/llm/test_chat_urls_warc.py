import hashlib
import re
import time

from pyspark.sql import functions as F

from crawlloom.llm import chat, queries, urlrules, warc
from crawlloom.llm.common import Workspace


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def formatted(spark, rows, **kinds):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: r for r in chat.render(chat.messages(chat.log_of(turns))).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learnt", chat.masked(F.col("formatted"), F.col("loss"))).collect()}


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b", "\\", "<s>", "[/INST]\n", "<\\s>", "é" * 1500 + "😀" * 700, "", None, "$1 \\1", "</s", "<"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, None, "x"), (2, 0, "user", "y"), (None, None, "assistant", "z")]
    got = formatted(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(texts)]
    assert got[1].learnt == "".join(t or "" for t in texts[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x"), ("", "x"), ("user", "y")]
    assert got[None].learnt == "z" and len(got) == 3


def test_chat_events(spark):
    log = [
        (1, 1, 10, "open", "user", None), (1, 2, 10, "delta", None, "Hel"), (1, 3, 10, "delta", None, "lo"), (1, 4, 11, "open", "assistant", None), (1, 5, 11, "delta", None, "bad"),
        (1, 6, 11, "regenerate", None, None), (1, 8, 11, "delta", None, "d"), (1, 7, 11, "delta", None, "goo"), (1, 9, 10, "edit", None, "Hi"), (1, 10, 10, "delta", None, "!"), (1, 11, 12, "delta", None, "lost"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string")
    final = chat.messages(events).orderBy("place").collect()
    assert [(r.message_id, r.role, r.text) for r in final] == [(10, "user", "Hi!"), (11, "assistant", "good"), (12, None, "lost")]
    assert chat.render(chat.messages(events.limit(0))).count() == 0


def test_op8_against_plain_python(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.PROBE
    got = {r.conv_id: r for r in queries.op8_chat(spark, sf_dir).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        want.setdefault(r[0], []).append((r[2], r[3] or ""))
    assert set(got) == set(want)
    for k, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
        assert got[k].formatted_chars > sum(len(r) + len(t) for r, t in turns)


def test_url_rules(spark):
    urls = {
        "http://A.Example.COM/en/71?x#y": ("allow", "example.com/en/7"), "http://example.com/en/81": ("block", "com/en/"), "ftp://com/en/": ("block", "com/en/"), "http://xcom/en/": ("allow", None),
        "https://www.example.net/de/8": ("block", "example.net/de/8"), "https://www.example.net/de/9": ("allow", "net/de/"), "http://q.org/es/": ("block", "org/es/"), "http://q.org/es": ("allow", None), "http://q.org?/es/": ("allow", None),
        "http://m.casino-win.example.org/fr/1": ("block", None), "http://casino-law.org/fr": ("allow", None), "http://x.io/a/banner/7/z.html": ("block", None), "http://x.io/about/banner7.html": ("allow", None),
        "nothing": ("allow", None), "": ("allow", None), None: ("allow", None), "://com/en/": ("block", "com/en/"), "http://a://com/en/": ("allow", None), "http://y.com/EN/": ("allow", None),
    }
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate([*urls, *urls])], "page_id long, url string, verdict string")
    rows = urlrules.judge(pages).collect()
    assert len(rows) == 2 * len(urls) and {r.url: (r.verdict, r.rule) for r in rows} == urls
    assert {(r.host, r.path) for r in rows if not r.url or r.url == "nothing"} == {("", "")}
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_url_rules_in_blocks_agree_with_trying_every_rule(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example.{t}/{p}/{k}/about" if k % 3 else f"http://casino-{k}.{t}/{p}/") for k, (t, p) in enumerate((t, p) for t in ("com", "net", "org") for p in ("en", "de", "es"))], "page_id long, url string")
    rules = [*urlrules.HOST_RULES, *urlrules.PATTERNS]
    want = {}
    for r in pages.select("page_id", urlrules.host_of(F.col("url")).alias("h"), urlrules.path_of(F.col("url")).alias("p")).collect():
        want[r.page_id] = urlrules.decide([x for x in rules if re.match(x.regex, r.h + r.p)])[1:]
    for size in (100, 2, 1):
        monkeypatch.setattr(urlrules, "BLOCK_RULES", size)
        assert {r.page_id: (r.verdict, r.rule, r.pattern) for r in urlrules.judge(pages, rules).collect()} == want


def test_rules_with_capitals():
    rule = urlrules.Rule("block", "h.com", "/aEN/b/")
    index = urlrules.RuleIndex([rule], {})
    assert rule.tokens == ("h", "com", "aen", "b") and index.fitting("h.com", "/aEN/b/c") == [rule] and not index.fitting("h.com", "/aen/b/c")


def pages_of(spark, n, body=lambda k: "x" * (k * 37 % 5000) + "é\r\n\r\nWARC/1.1\r\n"):
    return spark.createDataFrame([(k, f"http://h/{k}", body(k), 1) for k in range(n)] + [(None, None, None, 1), (7, "http://h/7", None, 1), (7, "http://h/7", None, 1), (n + 1, "u", "", 1)], "page_id long, url string, html string, offset int")


def test_warc_round_trip(spark):
    pages, ws = pages_of(spark, 300), Workspace(spark, "test")
    warc.write_warc(pages, ws.at("a"))
    a = ws.save(warc.read_warc(spark, ws.at("a")), "r-a")
    want = sorted(sha(r.x) for r in pages.select(warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("x")).collect())
    rows = a.orderBy("file", "offset").collect()
    assert sorted(r.sha256 for r in rows) == want and [r.page_id for r in rows] == [None, *sorted([*range(300), 7, 7, 301])]
    assert all(y.offset == x.offset + x.stored for x, y in zip(rows, rows[1:]) if x.file == y.file)
    warc.copy_replica(spark, ws.at("a"), ws.at("b"))
    b = ws.save(warc.read_warc(spark, ws.at("b")), "r-b")
    assert warc.audit(a, b, Workspace(spark, "same")).count() == 0
    assert warc.audit(a.limit(0), a.limit(0), Workspace(spark, "none")).count() == 0
    assert {r.status for r in warc.audit(a, a.limit(0), Workspace(spark, "gone")).collect()} == {"missing"}
    warc.write_warc(pages.limit(0), ws.at("empty"))
    assert warc.read_warc(spark, ws.at("empty")).count() == 0


def test_a_record_of_many_megabytes():
    import random

    r = random.Random(1)
    big = warc.VERSION.encode() + b"\r\n" + r.randbytes((1 << 24) + 5)
    small = warc.VERSION.encode() + b"\r\nsmall"
    assert warc.member_of(big).endswith(warc._EMPTY) and warc.member_of(small)[-1] == 0
    content = warc.member_of(small) + warc.member_of(big) + warc.member_of(small)
    assert [x[2] for x in warc.records_of(content)] == [small, big, small]


def test_damage_stays_in_its_record():
    own = [warc.VERSION.encode() + b"\r\n" + bytes([65 + k % 26]) * 300 + str(k).encode() * 40 for k in range(40)]
    members = [warc.member_of(x) for x in own]
    content = b"".join(members)
    starts = [sum(map(len, members[:k])) for k in range(41)]
    for k in range(0, 40, 3):
        for at in (starts[k], starts[k] + 1, (starts[k] + starts[k + 1]) // 2, starts[k + 1] - 3):
            bad = bytearray(content)
            bad[at] ^= 0x10
            found = list(warc.records_of(bytes(bad)))
            assert [(x, y) for x, y, _ in found] == list(zip(starts, starts[1:])) and [j for j, x in enumerate(found) if x[2] != own[j]] in ([k], [])


def test_audit_finds_just_what_is_changed(spark, monkeypatch):
    """Changed, dropped and added records, in several files and over levels of the tree; what a shift has moved is sound."""
    pages = pages_of(spark, 3000, lambda k: f"{k} " * (k % 50))
    monkeypatch.setattr(warc, "FILE_BYTES", 60_000)
    ws = Workspace(spark, "test")
    warc.write_warc(pages, ws.at("a"))
    a = ws.save(warc.read_warc(spark, ws.at("a")), "r-a")
    assert a.select("file").distinct().count() > 4

    def change(content):
        out = []
        for at, end, own in warc.records_of(content):
            page, raw = warc.page_of(own), content[at:end]
            if page == 1000:
                continue
            if page in (55, 2001):
                raw = bytearray(raw)
                raw[len(raw) // 2] ^= 1
            out.append(bytes(raw))
            if page == 2500:
                out.append(warc.member_of(own.replace(b"page:2500", b"page:9999")))
        return b"".join(out)

    warc.copy_replica(spark, ws.at("a"), ws.at("b"), change)
    b = ws.save(warc.read_warc(spark, ws.at("b")), "r-b")
    found = warc.audit(a, b, Workspace(spark, "differ")).collect()
    place = {(r.file, r.offset): r.page_id for r in a.collect()}
    assert sorted((place.get((r.file, r.left_offset), r.page_id), r.status) for r in found) == [(55, "corrupt"), (1000, "missing"), (2001, "corrupt"), (9999, "extra")]


def test_op3_marks_what_is_planted_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = spark.range(100_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("<p>"), F.sha2(F.col("id").cast("string"), 256)).alias("html"))
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    out = queries.op3_warc_audit(spark, str(tmp_path))
    got = {r.page_id: r.n for r in out.where("status <> 'intact'").groupBy("page_id").agg(F.count_if(F.col("status") == "corrupt").alias("n")).collect()}
    assert got == dict.fromkeys(range(0, 100_000, queries.ROT), 1) and out.count() == 100_000


def test_a_long_conversation_in_proportion(spark):
    """Time grows with the turns, not with their square; columns with clashing names are ignored."""
    took = {}
    for n in (4_000, 32_000):
        turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("é"), F.repeat(F.lit("x</s>"), 20), "id").alias("text"), F.lit("k").alias("kind"), F.lit(0).alias("seq"), F.lit("m").alias("message_id"))
        began = time.perf_counter()
        rows = chat.render(chat.messages(chat.log_of(turns, revised=True)))
        rows = rows.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learnt", chat.masked(F.col("formatted"), F.col("loss")))
        r = rows.select(F.size("turns").alias("n"), F.sha2("learnt", 256).alias("learnt")).first()
        took[n] = time.perf_counter() - began
        assert (r.n, r.learnt) == (n, sha("".join("é" + "x</s>" * 20 + str(k) for k in range(1, n, 2))))
    assert took[32_000] < 8 * took[4_000] + 5


def test_many_rules_in_proportion(spark):
    rules = [urlrules.Rule("block", pattern=f"||ad{k}-server.") for k in range(30_000)] + [urlrules.Rule("allow", "h7.test", "/en/")]
    pages = spark.range(5000).select("id", F.concat(F.lit("http://x.ad"), F.col("id") * 7, F.lit("-server.h7.test/"), F.when(F.col("id") % 2 == 0, "en").otherwise("de"), F.lit("/")).alias("url"))
    rows = urlrules.judge(pages, rules).collect()
    for r in rows:
        assert r.verdict == ("allow" if r.id % 2 == 0 or r.id * 7 >= 30_000 else "block") and r.pattern == (f"||ad{r.id * 7}-server." if r.verdict == "block" else None)


def test_a_list_of_rules():
    text = ["! a comment", "", "||ads.", "@@||ads.ok.", "Example.com/en/7", "@@net/de/", "/banner*.html", "^about^"]
    got = [(r.verdict, r.host, r.path if r.host else r.pattern) for r in urlrules.parse_rules(text)]
    assert got == [("block", None, "||ads."), ("allow", None, "||ads.ok."), ("block", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", None, "/banner*.html"), ("block", None, "^about^")]
