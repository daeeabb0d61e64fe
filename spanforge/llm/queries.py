"""Registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import content_sort, conversation_repair, decontaminate, embedding_dedup, fill_middle, jaccard_join, kn_quality, language_id, lm_score, packing, paragraph_dedup, secret_scan, url_filter
from spanforge.llm.stage import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN ['short ' || array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked documents by 4-word shingles at 85 %."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, RANKS, public_tokenizers.PATTERN)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: sequences of 1024 tokens."""
    return packing.pack(docs, TOKENIZER, RANKS, public_tokenizers.PATTERN)


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op3_url_filter", url_filter.judge_sql(URL_RULES))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and models over every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they leak."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a main language."""
    return language_id.keep_identified(docs, language_id.fit(docs))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("text_hash")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets replaced by a mark."""
    return secret_scan.redact(docs)


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked embeddings of equal label at cosine 0.98."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of them."""
    held_out = fold(F.col("doc_id"), 5) == 1
    found = lm_score.score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of those labelled good."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    small = labels.count() <= 2_000_000  # ids of 16 MB; beyond that a shuffle
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.join(F.broadcast(labels) if small else labels, "doc_id", "left")
    return kn_quality.judge(docs, F.col("quality") == 1)


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of 50 words or more that occur again."""
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies (five words, 80 %)."""
    return jaccard_join.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t
      WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""


@query("op11_content_sort", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents equal but for white space, and the one that stays."""
    return content_sort.copies(table(spark, sf_dir, "documents")).drop("text_hash")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || h[8 * k - 7:8 * k] AS BIGINT) FOR k IN [1, 2, 3, 4]] AS h FROM d),
f AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
           WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT doc_id, n, form, t, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
      coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at two lines and put together anew."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(back, 256)}).drop("output")


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations that op13 repairs: rows dropped (`there` false), emptied, without stops, repeated, or of another role."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("again"),
    )
    return rows.drop("again")


_CRC_STEP = "list_reduce(list_concat([{}], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
OP13_SQL = (
    r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: """
    + _CRC_STEP.format("i")
    + r""") AS c),
keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
sums AS (SELECT k, xor(list_reduce(list_concat([4294967295], [CAST(ascii(substr(k, CAST(i AS INT), 1)) AS BIGINT) FOR i IN range(1, length(k) + 1)]),
                lambda x, b: xor(x >> 8, c[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS h FROM keys, crc),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, h FROM conversations
        JOIN sums ON k = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again
         FROM raw WHERE h <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM hurt),
marked AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS stop, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS seen,
           lag(role) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM ord),
rows AS (SELECT conv_id, rn, turn, role, text, CASE WHEN stop = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN stop NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
         before IS NOT NULL AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal FROM marked),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
          count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS rows FROM rows GROUP BY conv_id),
ins(p, q, w, e) AS (VALUES ('0', '0', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('0', 'u', 3, 'I'), ('0', 'a', 6, 'II'), ('s', 'u', 3, 'I'),
    ('s', 'a', 6, 'II'), ('u', 'a', 3, 'I'), ('a', 'u', 3, 'I')),
nxt(p, q) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edit AS (SELECT r.conv_id, r.rn, x.p, x.p AS q, 4 AS w, 'D' AS e FROM rows r, (SELECT DISTINCT p FROM ins) x
  UNION ALL SELECT r.conv_id, r.rn, p, q, CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'K' FROM rows r JOIN nxt ON r.role[1:1] = q WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT r.conv_id, r.rn, p, q, CASE WHEN fault = 't' THEN 6 ELSE 3 END, 'R' FROM rows r JOIN nxt ON q <> 's' WHERE fault NOT IN ('b', 'd')),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS rn, q, CAST(w AS BIGINT) AS w, e FROM (SELECT DISTINCT conv_id FROM rows) c, ins WHERE p = '0'
  UNION ALL
  SELECT conv_id, rn, q, w, e FROM (
    SELECT dp.conv_id, dp.rn + 1 AS rn, ins.q, dp.w + edit.w + ins.w AS w, dp.e || edit.e || ins.e AS e,
      row_number() OVER (PARTITION BY dp.conv_id, ins.q ORDER BY dp.w + edit.w + ins.w, dp.e || edit.e || ins.e) AS k
    FROM dp JOIN edit ON edit.conv_id IS NOT DISTINCT FROM dp.conv_id AND edit.rn = dp.rn + 1 AND edit.p = dp.q JOIN ins ON ins.p = edit.q) WHERE k = 1),
best AS (SELECT dp.conv_id, arg_min(w, (w, e)) AS cost, arg_min(e, (w, e)) AS audit FROM dp JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.rows = dp.rn
         WHERE q IN ('0', 'a') GROUP BY dp.conv_id),
steps AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS e FROM best),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS rn FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
said AS (SELECT p.conv_id, pos, e, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, e = 'K' AND role[1:1] = 's' AS sys
         FROM placed p LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.rn = p.rn WHERE e <> 'D'),
roles AS (SELECT *, count(*) FILTER (NOT sys) OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM said),
body AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS body FROM roles GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN body ON body.conv_id IS NOT DISTINCT FROM c.conv_id
"""
)


@query("op13_conversation_repair", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and its cheapest repair."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    found = conversation_repair.repair(rows, F.col("there"))
    digests = conversation_repair.digests(found).withColumnRenamed("conv_id", "id")
    return found.conversations.join(digests, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
