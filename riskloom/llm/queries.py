"""The registered queries of this subpackage, with the SQL they must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    bpe_automaton,
    cotraining,
    cutting_stock,
    dual_tree_codes,
    license_scan,
    mixing_coder,
    rule_forest,
    secret_scan,
    tensored_minhash,
    token_alignment,
    toxicity_chain,
    url_reputation,
    voronoi_knn,
)
from riskloom.llm.common import table


def op8_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url; the outcome of a page is the quality label of its id."""
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_reputation.judge(table(spark, folder, "pages"), outcomes)
    return judged.withColumns({"mean": F.round("mean", 6), "bound": F.round("bound", 6)})


OP8_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
rules(rule, rhost, rpath, said) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
hits AS (SELECT DISTINCT host, path, rule, said FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) = 1),
d2 AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM p)),
names AS (SELECT host, CASE WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
  CASE WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM d2),
h AS (SELECT host, suffix, domain, coalesce(sum(quality), 0)::DOUBLE AS good, count(quality) - coalesce(sum(quality), 0)::DOUBLE AS bad
  FROM p LEFT JOIN labels ON doc_id = page_id JOIN names USING (host) GROUP BY 1, 2, 3),
s AS (SELECT suffix, sum(good) AS good, sum(bad) AS bad, (SELECT (sum(good) + 1) / (sum(good + bad) + 2) FROM h) AS m FROM h GROUP BY 1),
sr AS (SELECT sum((good + bad) * (good / (good + bad) - m) ^ 2 - m * (1 - m)) AS e, sum((good + bad - 1) * m * (1 - m)) AS c FROM s WHERE good + bad > 0),
sw AS (SELECT coalesce(least(greatest(CASE WHEN c IS NULL OR c <= 0 THEN 10 WHEN e / c <= 0 THEN 1000 ELSE c / e - 1 END, 1), 1000), 10) AS w FROM sr),
sm AS (SELECT suffix, (good + w * m) / (good + bad + w) AS m FROM s, sw),
d AS (SELECT domain, sum(good) AS good, sum(bad) AS bad, any_value(m) AS m FROM h JOIN sm USING (suffix) GROUP BY 1),
dr AS (SELECT sum((good + bad) * (good / (good + bad) - m) ^ 2 - m * (1 - m)) AS e, sum((good + bad - 1) * m * (1 - m)) AS c FROM d WHERE good + bad > 0),
dw AS (SELECT coalesce(least(greatest(CASE WHEN c IS NULL OR c <= 0 THEN 10 WHEN e / c <= 0 THEN 1000 ELSE c / e - 1 END, 1), 1000), 10) AS w FROM dr),
dm AS (SELECT domain, (good + w * m) / (good + bad + w) AS m FROM d, dw),
g AS (SELECT host, good, bad, m FROM h JOIN dm USING (domain)),
hr AS (SELECT sum((good + bad) * (good / (good + bad) - m) ^ 2 - m * (1 - m)) AS e, sum((good + bad - 1) * m * (1 - m)) AS c FROM g WHERE good + bad > 0),
hw AS (SELECT coalesce(least(greatest(CASE WHEN c IS NULL OR c <= 0 THEN 10 WHEN e / c <= 0 THEN 1000 ELSE c / e - 1 END, 1), 1000), 10) AS w FROM hr),
ab AS (SELECT host, good + w * m AS a, bad + w * (1 - m) AS b FROM g, hw),
r AS (SELECT host, a / (a + b) AS mean, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, p.host, p.path, rule, coalesce(said, CASE WHEN bound >= 0.8 THEN 'allow' ELSE 'block' END) AS verdict, round(mean, 6) AS mean, round(bound, 6) AS bound
FROM p JOIN r USING (host) LEFT JOIN hits ON hits.host = p.host AND hits.path = p.path"""


def op1_voronoi_knn(spark: SparkSession, folder: str) -> DataFrame:
    vectors = voronoi_knn.whole_vectors(table(spark, folder, "embeddings"))
    return voronoi_knn.search(vectors.withColumn("is_query", F.col("vec_id") % 20 == 0))


OP1_SQL = """
WITH w AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id AS query_id, unnest(v) AS a, unnest(range(len(v))) AS i FROM w WHERE vec_id % 20 = 0),
d AS (SELECT vec_id, unnest(v) AS b, unnest(range(len(v))) AS i FROM w),
s AS (SELECT query_id, vec_id, sum(a * b)::BIGINT AS score FROM q JOIN d USING (i) WHERE query_id <> vec_id GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def op2_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    setting = toxicity_chain.ChainSetting()
    chain = toxicity_chain.train(toxicity_chain.categories_of(labels, documents, setting), setting=setting)
    scored = toxicity_chain.score(documents, chain)
    rounded = {f"p_{c}": F.round(f"p_{c}", 6) for c in chain.categories}
    return scored.withColumns({**rounded, "kept": ~F.col("toxic")})


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents")).drop("places")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = secret_scan.train(secret_scan.samples(documents), documents=documents)
    found = secret_scan.scan(documents.select("doc_id", "text"), model)
    counts = [secret_scan.number_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in secret_scan.PATTERNS]
    digest = F.sha2(secret_scan.listing(F.col("base_spans")), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secret_scan.listing(F.col("spans")).alias("spans"))


def op5_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("good"))
    model = cotraining.train(documents, labels)
    return cotraining.score(documents, model).withColumn("quality", F.round("quality", 6))


def op6_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return tensored_minhash.near_duplicates(table(spark, folder, "documents"), tensored_minhash.MinHashSetting(words=2))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN [t[1]] ELSE list_distinct([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
hits AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT u, v FROM hits WHERE 100 * k >= 80 * (n + m - k)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.v, r.c FROM reach r JOIN both_ways b ON b.u = r.u)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept FROM s JOIN reach ON u = doc_id GROUP BY s.doc_id, len(s)"""


def op7_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_automaton.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_cutting_stock(spark: SparkSession, folder: str) -> DataFrame:
    return cutting_stock.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_rule_forest(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("good"))
    judged = rule_forest.judge(table(spark, folder, "documents"), labels)
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*base, F.round("score", 6).alias("score"))


def op11_dual_tree_codes(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree_codes.compress(table(spark, folder, "embeddings"))


def lloyd_sql(rounds: int = 6) -> str:
    """Lloyd's rounds one after the other: parts with their nearest entries, then floors of the means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, p, s, min_by(e, (dist, e)) AS e, min(dist) AS dist FROM (SELECT vec_id, parts.p, s, e,
  list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts JOIN c{r} ON parts.p = c{r}.p) GROUP BY 1, 2, 3)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM
  (SELECT p, e, unnest(s) AS x, unnest(range(len(s))) AS i FROM a{r}) GROUP BY 1, 2, 3),
c{r + 1} AS (SELECT c{r}.p, c{r}.e, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT p, e, list(y::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY 1, 2) n USING (p, e))""")
    return f"""WITH w AS (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS s FROM w, range(8) AS r(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s AS c FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16),
{", ".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM w JOIN codes USING (vec_id) GROUP BY 1)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM w JOIN codes USING (vec_id) JOIN sums ON sums.label IS NOT DISTINCT FROM w.label, books"""


def op12_mixing_coder(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_coder.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.compare(table(spark, folder, "documents"), *paths)


QUERIES = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_cotraining": op5_cotraining,
    "op6_tensored_minhash": op6_tensored_minhash,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_url_reputation": op8_url_reputation,
    "op9_cutting_stock": op9_cutting_stock,
    "op10_rule_forest": op10_rule_forest,
    "op11_dual_tree_codes": op11_dual_tree_codes,
    "op12_mixing_coder": op12_mixing_coder,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE = {"op1_voronoi_knn": OP1_SQL, "op6_tensored_minhash": OP6_SQL, "op8_url_reputation": OP8_SQL, "op11_dual_tree_codes": lloyd_sql()}
