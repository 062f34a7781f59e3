"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_compression, decontaminate, exact_dedup, langid, lexical_search, line_dedup, mixture, ngram_join, quality, secrets, substring_dedup, token_shards, url_filter

#: The rules of op2_url_filter, as (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(_documents(spark, sf_dir), tokenizer_path(), end_id=1)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir), width=4, share=85)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_lines(_documents(spark, sf_dir))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1,
    "op2_url_filter": op2,
    "op3_decontaminate": op3,
    "op4_secret_scan": op4,
    "op5_language_id": op5,
    "op6_substring_dedup": op6,
    "op7_exact_dedup": op7,
    "op8_token_shards": op8,
    "op9_ngram_jaccard_join": op9,
    "op10_line_dedup": op10,
    "op11_lexical_search": op11,
    "op12_code_compression": op12,
    "op13_quality_rules": op13,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _compression_sql() -> str:
    """The four rounds, one after the other."""
    last = code_compression.ROUNDS
    steps = [r"""
kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
         FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
b0 AS (SELECT p, r - 1 AS e, x AS y FROM cut WHERE r <= 256)"""]
    for k in range(last + 1):
        steps.append(f"""
d{k} AS (SELECT c.r, c.p, b.e, list_sum(list_transform(list_zip(c.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut c JOIN b{k} b USING (p)),
a{k} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'e': e}}) AS m FROM d{k} GROUP BY r, p)""")
        if k < last:
            steps.append(f"""
s{k} AS (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM
  (SELECT c.p, a.m.e AS e, unnest(c.x) AS x, unnest(generate_series(1, len(c.x))) AS i FROM cut c JOIN a{k} a USING (r, p)) GROUP BY p, e, i),
n{k} AS (SELECT p, e, list(y ORDER BY i) AS y FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.y, b.y) AS y FROM b{k} b LEFT JOIN n{k} n USING (p, e))""")
    steps.append(f"""
book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last}),
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), book""")
    return "WITH " + ",".join(steps)


ORACLE: dict[str, str] = {
    "op11_lexical_search": rf"""
WITH it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS ts FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(total.n) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * total.n) // total.l)))) AS BIGINT) AS score
           FROM it JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
""",
    "op12_code_compression": _compression_sql(),
    "op2_url_filter": r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT s.page_id, r.rule, r.verdict FROM split s JOIN rules r
        ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
        AND starts_with(s.path, substr(r.rule, strpos(r.rule, '/')))),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY page_id)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM split s LEFT JOIN best b USING (page_id)
""",
    "op6_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
win AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50),
hashed AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM win),
first AS (SELECT h, min(doc_id) AS owner FROM hashed GROUP BY h),
gone AS (SELECT DISTINCT doc_id, place FROM (SELECT x.doc_id, unnest(generate_series(x.i, x.i + 49)) AS place FROM hashed x JOIN first f USING (h) WHERE f.owner < x.doc_id)),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS place FROM w),
kept AS (SELECT f.doc_id, count(*) AS n, string_agg(f.word, ' ' ORDER BY f.place) AS t FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.place = g.place GROUP BY f.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
""",
    "op9_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(generate_series(1, len(words) - 3), lambda i: array_to_string(words[i:i + 3], ' '))) AS g FROM w WHERE len(words) >= 4
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 3)),
sized AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN twoway l ON l.a = r.other)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN sized s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
""",
}
