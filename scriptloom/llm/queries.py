"""One query per operator over its whole table, with the columns that its contract asks for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import encode_texts
from .decontaminate import find_contamination
from .language import identify_language
from .overlap import jaccard_groups
from .phrases import collocations
from .quality import score_quality
from .repeats import spans_by_document
from .secrets import find_secrets
from .simhash import near_duplicate_groups
from .toxicity import score_toxicity
from .trie import conversation_trie
from .urls import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: 3-word shingles, 3 bits."""
    groups = near_duplicate_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten benchmark words, by winnowing."""
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s
        FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))
), dw AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.r, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines and sentences of 8 words or more that repeat an earlier one."""
    found = spans_by_document(_table(spark, sf_dir, "documents"))
    text = F.transform("spans", lambda s: F.concat(s["level"], F.lit(":"), s["start"], F.lit("-"), s["end"], F.lit("="), s["first_id"], F.lit("@"), s["first_start"]))
    chars = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + F.when(s["level"] == "line", s["end"] - s["start"]).otherwise(0))
    return found.select(
        "doc_id",
        F.size("spans").cast("bigint").alias("n_removed"),
        chars.alias("line_chars"),
        F.sha2(F.array_join(F.array_sort(text), ","), 256).alias("spans_sha256"),
    )


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''
), cut AS (
  SELECT doc_id, 'line' AS level, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS p FROM t
  UNION ALL
  SELECT doc_id, 'sentence', regexp_extract_all(text, '[^.!?\n]+[.!?]*[ \t]*\n?|[.!?\n]+[ \t]*') FROM t
), pieces AS (
  SELECT doc_id, level, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cut
), placed AS (
  SELECT doc_id, level, piece,
         CAST(sum(length(piece)) OVER (PARTITION BY doc_id, level ORDER BY i) AS BIGINT) AS e
  FROM pieces
), units AS (
  SELECT doc_id, level, e - length(piece) AS s, e,
         trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM placed
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_id, first_value(s) OVER w AS first_s
  FROM units WHERE len(string_split(norm, ' ')) >= 8
  WINDOW w AS (PARTITION BY level, norm ORDER BY doc_id, s)
), spans AS (
  SELECT DISTINCT doc_id, level, e - s AS n, level || ':' || s || '-' || e || '=' || first_id || '@' || first_s AS x
  FROM ranked WHERE doc_id <> first_id OR s <> first_s
), own AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN level = 'line' THEN n ELSE 0 END) AS chars, string_agg(x, ',' ORDER BY x) AS x
  FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS line_chars,
       sha256(coalesce(x, '')) AS spans_sha256
FROM documents LEFT JOIN own USING (doc_id)
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's candidates for secrets, and the spans that the forest takes for secrets."""
    found = find_secrets(_table(spark, sf_dir, "documents"))
    secrets = F.filter("findings", lambda f: f["secret"])
    spans = F.transform(secrets, lambda f: F.concat(f["start"], F.lit("-"), f["end"]))
    return found.select(
        "doc_id",
        F.size("findings").cast("bigint").alias("n_candidates"),
        F.size(secrets).cast("bigint").alias("n_secrets"),
        F.array_join(spans, ",").alias("secret_spans"),
        F.array_max(F.transform("findings", lambda f: f["score"])).alias("top_score"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by positive-unlabelled learning; predicted at 0.7."""
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages; predicted at 0.5."""
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for each whose vec_id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, k=5)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; nothing is rejected but texts without letters."""
    return identify_language(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_texts(_table(spark, sf_dir, "documents"), path, keep_ids=False)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rule or by the model."""
    return judge_urls(_table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best collocations of two to four words in ``documents``."""
    return collocations(_table(spark, sf_dir, "documents"), least=30, top=2000)


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT lang, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(m) WHERE len(w) >= m)
), f AS MATERIALIZED (
  SELECT lang, m, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, m, g HAVING count(*) >= 30
), n AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), cut AS (
  SELECT lang, g, f AS a, k, array_to_string(string_split(g, ' ')[: k], ' ') AS x, array_to_string(string_split(g, ' ')[k + 1 :], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)
), scored AS (
  SELECT cut.lang, cut.g, cut.a, k, l.f AS l, r.f AS r, (2000000 * cut.a) // (l.f + r.f) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.g = x JOIN f AS r ON r.lang = cut.lang AND r.g = y
), best AS (
  SELECT lang, g, any_value(a) AS a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS c FROM scored GROUP BY lang, g
), inner_parts AS (
  SELECT DISTINCT lang, f, array_to_string(string_split(g, ' ')[i : i + m - 1], ' ') AS g
  FROM (SELECT f.lang, f.f, f.g, f.m AS whole, t.m, unnest(range(1, f.m - t.m + 2)) AS i FROM f, (VALUES (2), (3)) AS t(m) WHERE t.m < f.m)
), kept AS (
  SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM inner_parts AS i WHERE i.lang = best.lang AND i.g = best.g AND 100 * i.f >= 80 * best.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, g) AS rank FROM kept
)
SELECT lang, rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(c.l AS BIGINT) AS l, CAST(c.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(c.score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 5-word shingles of ``documents`` that are 0.8 alike, by T-occurrence search."""
    return jaccard_groups(_table(spark, sf_dir, "documents"), shingle=5, percent=80)


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, CAST(greatest(len(w) - 4, 1) + 1 AS BIGINT))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), link AS (
  SELECT a, b FROM common JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT r, r AS m FROM d UNION SELECT e.a, reach.m FROM reach JOIN edge AS e ON e.b = reach.r
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d AS o ON o.r = reach.m GROUP BY d.r, d.doc_id
"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt ``conversations``."""
    return conversation_trie(_table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'id': id, 'w': w} ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id
), h AS (  -- CRC-32 of the decimal id, bit by bit
  SELECT conv_id, turns, xor(list_reduce(
           flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
           lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1 : a.h], a.turns[a.h + 1 :]) AS turns
  FROM h AS a LEFT JOIN own AS b ON b.conv_id = a.conv_id - a.conv_id % 20
), member AS (
  SELECT conv_id, d, len(turns) = d AS ends, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w,
         md5(array_to_string(list_transform(turns[1 : d], lambda x: x.id), ',')) || d AS p
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT p, d, min(conv_id) AS first, count(*) AS n, any_value(w) AS w,
         sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends
  FROM member GROUP BY p, d
), up AS (
  SELECT c.p, m.p AS above, q.first AS above_first FROM node AS c JOIN member AS m ON m.conv_id = c.first AND m.d = c.d - 1 JOIN node AS q ON q.p = m.p
), kids AS (
  SELECT above AS p, count(*) AS k FROM up GROUP BY above
), sums AS (  -- what every node gives to itself and to those above it
  SELECT m.p, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN v.d > 0 THEN (v.n - 1) * v.w ELSE 0 END) AS saved
  FROM node AS v LEFT JOIN kids USING (p) JOIN member AS m ON m.conv_id = v.first AND m.d <= v.d GROUP BY m.p
)
SELECT first AS conv_id, d AS depth, above_first AS parent_conv_id, n AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM node JOIN sums USING (p) LEFT JOIN up USING (p) LEFT JOIN kids USING (p)
"""


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_decontaminate": op2_decontaminate,
        "op3_repeats": op3_repeats,
        "op4_secrets": op4_secrets,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_neighbours": op7_neighbours,
        "op8_language": op8_language,
        "op9_bpe": op9_bpe,
        "op10_urls": op10_urls,
        "op11_phrases": op11_phrases,
        "op12_jaccard": op12_jaccard,
        "op13_trie": op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_repeats": OP3_SQL, "op11_phrases": OP11_SQL, "op12_jaccard": OP12_SQL, "op13_trie": OP13_SQL}
