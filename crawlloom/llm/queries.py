"""The queries opN_<name> over the training-data tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, packing, quality, simhash, suffix_dedup, tokenbin, urlrules, warc
from .common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.selected(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round(F.element_at("tails", 1), 6).alias("p_above_0"), F.round(F.element_at("tails", 2), 6).alias("p_above_1"), "selected")


#: One record in so many of the audited replica has a stored byte changed.
ROT = 97


def _rot(content: bytes) -> bytes:
    """An archive file with damage in the middle of some records: those of pages whose number ROT divides and whose body
    begins with an ASCII character other than ~."""
    data = bytearray(content)
    for at, end, own in warc.records_of(content):
        page, body = warc.page_of(own), own.partition(b"\r\n\r\n")[2]
        if page is not None and page % ROT == 0 and body and body[0] < 128 and body[:1] != b"~":
            data[(at + end) // 2] ^= 0x20
    return bytes(data)


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are written to an archive, which is copied byte for byte but for planted damage to stored bytes; both
    are read back and audited. Every record with its length, its digest in the sound replica, and whether the audit has
    found it damaged in the other (extra: a record that only that one has)."""
    ws = Workspace(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), ws.at("a"))
    ws.release()
    warc.copy_replica(spark, ws.at("a"), ws.at("b"), _rot)
    left, right = (ws.save(warc.read_warc(spark, ws.at(x)), f"records-{x}") for x in "ab")
    ws.drop("a", "b")
    damage = ws.save(warc.audit(left, right, ws), "damage")
    of = lambda rows, at, kind: rows.join(damage.select("file", F.col(at).alias("offset"), "status"), ["file", "offset"], kind)
    every = of(left, "left_offset", "left").unionByName(of(right, "right_offset", "inner").where("status = 'extra'"))
    return every.select("page_id", F.col("length").alias("n_bytes"), F.col("sha256").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_orc(_table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "pattern", "verdict")


#: A conversation whose texts hold the template's own control strings, formatted beside those of the table.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    ws = Workspace(spark, "chat")
    rows = ws.save(chat.render(chat.messages(chat.log_of(turns, revised=True))), "formatted")
    rows = rows.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learnt", chat.masked(F.col("formatted"), F.col("loss")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_warc_audit": op3_warc_audit,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_token_orc": op6_token_orc,
    "op7_url_rules": op7_url_rules,
    "op8_chat": op8_chat,
    "op9_decontam": op9_decontam,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL: dict[str, str] = {
    "op3_warc_audit": """
        WITH r AS (
          SELECT page_id, coalesce(html, '') AS html,
                 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                 || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
                 || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
                 || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') || chr(13) || chr(10)
                 || 'Content-Type: text/html' || chr(13) || chr(10)
                 || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                 || coalesce(html, '') AS record
          FROM pages)
        SELECT page_id, strlen(record) AS n_bytes, sha256(record) AS record_sha256,
               CASE WHEN page_id % 97 = 0 AND html <> '' AND ascii(html) < 128 AND html[1] <> '~' THEN 'corrupt' ELSE 'intact' END AS status
        FROM r""",
    "op7_url_rules": r"""
        WITH a AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
          SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                 translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
          FROM a),
        rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        patterns(pattern, regex, verdict) AS (VALUES
          ('||casino-', '^(?:[^/]*\.)?casino-', 'block'), ('||cheap-pills.', '^(?:[^/]*\.)?cheap-pills\.', 'block'),
          ('||free-bets.', '^(?:[^/]*\.)?free-bets\.', 'block'), ('||ads-track.', '^(?:[^/]*\.)?ads-track\.', 'block'),
          ('/adserver^', '/adserver(?:[^a-z0-9]|$)', 'block'), ('/banner*.html', '(?s)/banner.*\.html', 'block'),
          ('||casino-law.', '^(?:[^/]*\.)?casino-law\.', 'allow'), ('^about^', '(?:[^a-z0-9])about(?:[^a-z0-9]|$)', 'allow')),
        r AS (
          SELECT p.page_id, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
                 arg_max(rules.verdict, length(rules.host || rules.path)) AS verdict
          FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY 1),
        q AS (
          SELECT p.page_id, arg_min(pattern, verdict || pattern) AS pattern, min(verdict) AS verdict
          FROM p JOIN patterns ON regexp_matches(p.host || p.path, regex) GROUP BY 1)
        SELECT p.page_id, p.host, p.path, r.rule, CASE WHEN r.rule IS NULL THEN q.pattern END AS pattern,
               coalesce(r.verdict, q.verdict, 'allow') AS verdict
        FROM p LEFT JOIN r USING (page_id) LEFT JOIN q USING (page_id)""",
    "op8_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, role AS raw, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL
          SELECT -7, turn, role, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) p(turn, role)),
        e AS (
          SELECT *, '<s>[INST] ' || replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') || ' [/INST]'
                 || replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') || '</s>' AS own
          FROM t),
        c AS (
          SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw NULLS FIRST, text) AS turns,
                 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, raw NULLS FIRST, text) FILTER (raw = 'assistant'), '') AS learnt,
                 string_agg(own, '' ORDER BY turn NULLS FIRST, raw NULLS FIRST, text) AS formatted
          FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, length(formatted) AS formatted_chars FROM c""",
    "op10_exact_dedup": """
        WITH d AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
