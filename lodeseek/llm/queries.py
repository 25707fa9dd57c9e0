"""The registered queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import table


def op3_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.licenses import license_scan

    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.packing import pack

    found = pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.quality import graded, scored, train

    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, graded(table(spark, sf_dir, "labels"))))
    return found.select("row.doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_tail", 6).alias("p_tail"), "keep")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids, "contaminated")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.secrets import BASE, secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *count, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def _only(kind: str):
    return lambda k: F.when(k == kind, k)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.urlfilter import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"))


def _license_sql() -> str:
    """The sentence lookup and the ordered rules, one subquery a rule."""
    from lodeseek.llm.licenses import GRANT, HINT, RULES, SENTENCES

    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    norm = f"regexp_replace(trim(regexp_replace({low.format('{}')}, '[^a-z0-9]+', ' ', 'g')), '{GRANT}', 'under ')"
    sql = f"""
        WITH known(s, i) AS (VALUES {known}),
        d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        s AS (
            SELECT r, j, p[j] AS s FROM (SELECT r, p, unnest(range(1, len(p) + 1)) AS j FROM (
                SELECT r, string_split(regexp_replace(text, '[.!?:]+([ \t\r\n]|\\z)|\n[ \t\r]*\n', chr(1), 'g'), chr(1)) AS p FROM d WHERE regexp_matches({low.format('text')}, '{HINT}')))
        ), h AS (SELECT r, j, x.s AS s, known.i AS whole FROM (SELECT r, j, s, {norm.format('s')} AS n FROM s WHERE regexp_matches({low.format('s')}, '{HINT}')) x LEFT JOIN known ON known.s = n),
        l AS (
            SELECT r, j, k, known.i AS i FROM (SELECT r, j, k, {norm.format('p[k]')} AS n FROM (SELECT r, j, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT r, j, string_split(s, chr(10)) AS p FROM h WHERE whole IS NULL))) x
            JOIN known ON known.s = n
        ), ids AS (
            SELECT r, string_agg(i, ',' ORDER BY j, k) AS ids FROM (SELECT r, j, 0 AS k, whole AS i FROM h WHERE whole IS NOT NULL UNION ALL SELECT r, j, k, i FROM l) GROUP BY r
        ), r0 AS (SELECT doc_id, coalesce(ids, '') AS sentence_ids, CASE WHEN ids IS NULL THEN '' ELSE ',' || replace(ids, ',', ',,') || ',' END AS rest, CAST([] AS VARCHAR[]) AS found FROM d LEFT JOIN ids USING (r))"""
    for n, (name, run) in enumerate(RULES):
        want = "".join(f",{i}," for i in run)
        sql += f""",
        r{n + 1} AS (SELECT doc_id, sentence_ids, replace(rest, '{want}', '|') AS rest, CASE WHEN contains(rest, '{want}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM r{n})"""
    return sql + f"\n        SELECT doc_id, sentence_ids, array_to_string(found, ',') AS licenses FROM r{len(RULES)}"


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_packing": op2_packing,
    "op3_tokencount": op3_tokencount,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_secrets": op8_secrets,
    "op9_urlfilter": op9_urlfilter,
    "op10_maxscore": op10_maxscore,
}

ORACLES = {
    "op1_licenses": _license_sql(),
    "op6_decontaminate": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), bw AS (
            SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)
        ), lens AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
        ), hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
    """,
    "op10_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
