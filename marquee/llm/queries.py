"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .jaccard_join import jaccard_join
from .license_scan import TEMPLATES, license_scan, shingles_of
from .resampling import resample
from .scratch import shared_dir
from .sentencepiece_codec import encode_decode
from .sharding import shard
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_alignment import align_tokens
from .toxicity import toxicity
from .warc import read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> str:
    return vocabulary("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return rows.select("doc_id", "run", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")
    return read_archives(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), piece_model())


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_sentencepiece, op4_jaccard_join, op5_substring_dedup, op6_decontaminate, op7_html_text, op8_toxicity, op9_suffix_dedup, op10_sharding, op11_resampling, op12_warc, op13_token_alignment)}

_TEMPLATE_ROWS = ", ".join("('{}', {}, '{}')".format(name, len(set(shingles_of(text))), s) for name, text in TEMPLATES.items() for s in sorted(set(shingles_of(text))))

def _half_byte(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ 0xEDB88320 * (x & 1)
    return x


_CRC32 = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(k)), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: strpos('123456789ABCDEF', c)::BIGINT)),
            lambda c, x: xor(c >> 4, list_extract({[_half_byte(x) for x in range(16)]}::BIGINT[], xor(c & 15, x) + 1))))"""

SQL = {
    "op12_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f""",
    "op11_resampling": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        f AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS k FROM w, range(1, 4) r(n), range(1, len(w) - n + 2) s(i) WHERE len(w) >= n),
        g AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS k FROM b, range(1, 4) r(n), range(1, len(w) - n + 2) s(i) WHERE len(w) >= n),
        crc AS (SELECT k, {_CRC32} % 10000 AS bucket FROM (SELECT k FROM f UNION SELECT k FROM g)),
        s AS (SELECT bucket, count(*) AS s FROM f JOIN crc USING (k) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM g JOIN crc USING (k) GROUP BY bucket),
        gain AS (SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE)))::BIGINT AS gain
                 FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        weight AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM f JOIN crc USING (k) JOIN gain USING (bucket) GROUP BY doc_id),
        score AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN weight USING (doc_id)),
        place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM score WHERE words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM place) // 100 THEN rank END AS rank FROM score LEFT JOIN place USING (doc_id)""",
    "op2_license_scan": rf"""
        WITH t(template, n, s) AS (VALUES {_TEMPLATE_ROWS}),
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents),
        d AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM w, range(0, len(w) - 4) r(i) WHERE len(w) >= 5),
        m AS (SELECT doc_id, template, n, s, i // n AS k FROM d JOIN t USING (s)),
        g AS (SELECT doc_id, template, n, s, k FROM m UNION SELECT doc_id, template, n, s, k - 1 FROM m WHERE k > 0),
        c AS (SELECT doc_id, template, n, k, count(DISTINCT s) AS c FROM g GROUP BY ALL)
        SELECT doc_id, template, max(c)::BIGINT AS n_shared, n::BIGINT AS n_shingles, round(max(c) / n, 6) AS containment FROM c GROUP BY doc_id, template, n HAVING 5 * max(c) >= 4 * n""",
    "op9_suffix_dedup": r"""
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, j, h[400 * j + 1:400 * j + 498] AS c FROM h, range(0, length(h) // 400 + 1) r(j) WHERE length(h) >= 100),
        s AS (SELECT doc_id, 200 * j + o AS i, c[2 * o + 1:2 * o + 100] AS k FROM c, range(0, 200) r(o) WHERE length(c) >= 2 * o + 100),
        m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
        t AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 THEN 1 ELSE 0 END AS new FROM s JOIN m USING (k) WHERE doc_id > least WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        u AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t),
        v AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM u GROUP BY doc_id, run),
        p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM v),
        g AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS n, max(b) AS last, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS kept FROM p JOIN h USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256 FROM h LEFT JOIN g USING (doc_id)""",
    "op10_sharding": r"""
        SELECT doc_id, CASE WHEN doc_id % 8 < 4 THEN 'a0000-a0003' ELSE 'a0004-a0007' END AS run, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        k AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM w, range(1, greatest(len(w) - 5, 0) + 2) r(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)""",
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM w, range(1, len(w) - 11) r(i) WHERE len(w) >= 13),
        m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
        g AS (SELECT DISTINCT doc_id, j FROM s JOIN m USING (k), range(i, i + 13) r(j) WHERE doc_id > least),
        l AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(w[j], ' ' ORDER BY j) FROM range(1, len(w) + 1) r(j) WHERE NOT list_contains(gone, j)), '') END) AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id)""",
    "op6_decontaminate": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        p AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM bw, range(1, greatest(len(w) - 10, 0) + 2) r(i) WHERE len(w) > 0),
        lengths AS (SELECT DISTINCT n FROM p),
        s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw, lengths, range(1, len(w) - n + 2) r(i) WHERE len(w) >= n),
        m AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p USING (n, k)),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM m, range(m.i, m.i + m.n) r(j) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
