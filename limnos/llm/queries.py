"""Each corpus operator applied to the whole ``documents`` table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.common import documents
from limnos.llm.exact_dedup import mark_copies
from limnos.llm.html_extract import extract
from limnos.llm.near_dedup import near_components
from limnos.llm import license_scan, pii, secret_scan, segment, toxicity
from limnos.llm.packing import pack
from limnos.llm.periodic_runs import find_runs, with_planted_runs
from limnos.llm.prefix_trie import digest_turns, rebuilt, trie
from limnos.llm.quality import judge
from limnos.llm.token_count import count_tokens

#: The tokenizer of the token queries, and the longest input of a model.
MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("blocks")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), percent=85, shingle_words=3)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "deviation",
        "spell_bits", "spell_deviation")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_strings(pii.scan(documents(spark, sf_dir))).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op9_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = segment.sample_segmentations(documents(spark, sf_dir), public_tokenizers.path(MODEL))
    return drawn.select("doc_id", "sample", F.size("ids").cast("long").alias("n_tokens"), "log_prob", "perturbed", "log_inclusion",
                        "ids", "round_trip")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path(MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(digest_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(documents(spark, sf_dir)))
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint, length:bigint, period:bigint>),
                     (b, r) -> if(b is null or r.length > b.length, r, b))""")  # runs are in order of start and period
    found = found.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_segmentations": op9_segmentations,
    "op10_token_counts": op10_token_counts,
    "op11_html_text": op11_html_text,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

#: The table of the crc32 polynomial, and the crc32 of a decimal number by it.
_CRC_TABLE = """crc_step AS (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
            FROM range(256) t(i)),
        crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_step)"""


def _crc32(column: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({column}::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
               lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295::BIGINT)"""


ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op12_prefix_trie": f"""
        WITH {_CRC_TABLE},
        turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                   {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT conv_id, list(t ORDER BY pos) AS ts, {_crc32('conv_id')} % 9 AS h
            FROM turns, crc_table GROUP BY conv_id, tab),
        rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts
            FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
        paths AS (SELECT conv_id, d, ts[1:d] AS node, len(ts) = d AS ends FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt)),
        nodes AS (
            SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   CASE WHEN d > 0 THEN (count(*) - 1) * strlen(node[d].text) ELSE 0 END AS own,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM paths GROUP BY node, d),
        kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        leaves AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node),
        above AS (SELECT node[1:a] AS node, own, n_children FROM (SELECT node, own, n_children, unnest(range(depth + 1)) AS a FROM leaves)),
        below AS (SELECT node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY node)
        SELECT l.conv_id, l.depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, b.n_leaves, b.saved_tokens, l.ends_sha256
        FROM leaves l JOIN below b ON b.node = l.node LEFT JOIN leaves p ON l.depth > 0 AND p.node = l.node[1:l.depth - 1]""",
    "op13_periodic_runs": rf"""
        WITH {_CRC_TABLE},
        docs AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                   {_crc32('doc_id')} AS h
            FROM documents, crc_table),
        drawn AS (SELECT doc_id, ws, len(ws) AS n, h, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS p FROM docs),
        texts AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM drawn),
        words AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS w FROM texts),
        -- a run holds each of its words four times: split twice at words that are rarer
        often AS (SELECT doc_id, i, w FROM words QUALIFY count(*) OVER (PARTITION BY doc_id, w) >= 4),
        parts AS (SELECT doc_id, i, w, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part FROM often),
        often2 AS (SELECT doc_id, i, w FROM parts QUALIFY count(*) OVER (PARTITION BY doc_id, part, w) >= 4),
        parts2 AS (SELECT doc_id, i, w, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part FROM often2),
        kept AS (SELECT *, count(*) OVER (PARTITION BY doc_id, part) AS size FROM parts2),
        pairs AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM kept x JOIN kept y
            ON x.doc_id = y.doc_id AND x.part = y.part AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.size),
        stretches AS (
            SELECT doc_id, q, min(i) AS s, count(*) + q AS len
            FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g
            HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretches GROUP BY doc_id, s, len),
        by_doc AS (
            SELECT doc_id, count(*) AS n_runs, arg_min([s, len, q], [-len, s, q]) AS best,
                   string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines
            FROM runs GROUP BY doc_id),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
        left_over AS (
            SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS txt FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
        SELECT t.doc_id, t.n AS n_words, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
               1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
        FROM texts t LEFT JOIN by_doc USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
}
