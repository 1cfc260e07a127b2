"""Registered queries of this package and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm import decontaminate, licenses, pieces
from tidebar.llm.centroid_clusters import centroid_clusters
from tidebar.llm.circulant_minhash import circulant_components
from tidebar.llm.conversation_trie import conversation_trie
from tidebar.llm.exact_dedup import exact_dedup
from tidebar.llm.jaccard_join import jaccard_components
from tidebar.llm.lm_score import lm_scores
from tidebar.llm.substring_dedup import substring_dedup
from tidebar.llm.suffix_dedup import suffix_dedup
from tidebar.llm.token_counts import count_tokens
from tidebar.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op8_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


DUCK_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_benchmark_decontamination",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all({DUCK_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({DUCK_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS p
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a FROM i WHERE len(w) > 0)),
places AS (SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM runs) WHERE len(w) >= k)),
found AS (SELECT doc_id, a, k, item_id FROM places JOIN runs USING (p, k)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(a, a + k)) AS x FROM (SELECT DISTINCT doc_id, a, k FROM found)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_sentencepiece_nbest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text, and whether the best one decodes to it."""
    return pieces.round_trip(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole."""
    return count_tokens(table(spark, sf_dir, "documents"))


def _components_sql(k: int, share: int, last: str = "") -> str:
    """Sets of k-word shingles, links by their exact similarity, the smallest doc_id reachable."""
    return rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({DUCK_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {k - 1}], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {share} * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id{last}
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""


@query("op10_ngram_jaccard_join", _components_sql(5, 75))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query(
    "op1_substring_dedup",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM runs) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM again),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT word.doc_id, count(gone.k) AS n, string_agg(word, ' ' ORDER BY word.k) FILTER (gone.k IS NULL) AS s
  FROM word LEFT JOIN gone USING (doc_id, k) GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(kept.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in sorted(licenses.TEMPLATES.items()))
DUCK_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


@query(
    "op5_license_scans",
    rf"""WITH template AS (SELECT * FROM (VALUES {TEMPLATE_ROWS}) t(licence, text)),
doc AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, CASE WHEN doc_id % 97 > 0 THEN lang END,
  CASE WHEN doc_id % 97 > 0 AND doc_id % 13 > 0 THEN 'part' || (doc_id // 1000) END) AS dir FROM documents),
notice AS (SELECT doc_id, dir, line FROM (SELECT doc_id, dir, unnest(string_split(text, chr(10))) AS line FROM doc) WHERE regexp_matches(line, '{licenses.NOTICE}')),
both_ AS (SELECT line FROM notice UNION ALL SELECT text FROM template),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({DUCK_TERMS.format('line')})) AS term FROM both_) GROUP BY term),
idf AS (SELECT term, ln(((SELECT count(*) FROM both_) + 1) / (df + 1)) + 1 AS idf FROM df),
t AS (SELECT licence, term, count(*) * any_value(idf) AS w FROM (SELECT licence, unnest({DUCK_TERMS.format('text')}) AS term FROM template) JOIN idf USING (term) GROUP BY ALL),
l AS (SELECT line, term, count(*) * any_value(idf) AS w FROM (SELECT line, unnest({DUCK_TERMS.format('line')}) AS term FROM (SELECT DISTINCT line FROM notice)) JOIN idf USING (term) GROUP BY ALL),
tn AS (SELECT licence, sqrt(sum(w * w)) AS n FROM t GROUP BY licence), ln_ AS (SELECT line, sqrt(sum(w * w)) AS n FROM l GROUP BY line),
score AS (SELECT line, licence, round(sum(l.w * t.w) / (any_value(ln_.n) * any_value(tn.n)), 6) AS score
  FROM l JOIN t USING (term) JOIN tn USING (licence) JOIN ln_ USING (line) GROUP BY line, licence),
best AS (SELECT line, licence, score FROM score QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, licence) = 1),
own AS (SELECT doc_id, dir, arg_min(licence, (-score, licence)) AS licence, max(score) AS score, count(DISTINCT line) AS n FROM notice JOIN best USING (line) WHERE score >= {licenses.LEAST} GROUP BY doc_id, dir),
file AS (SELECT dir, arg_min(licence, doc_id) AS licence FROM own GROUP BY dir),
near AS (SELECT d.dir, arg_max(file.dir, length(file.dir)) AS above, arg_max(file.licence, length(file.dir)) AS licence
  FROM (SELECT DISTINCT dir FROM doc) d JOIN file ON d.dir = file.dir OR starts_with(d.dir, file.dir || '/') GROUP BY d.dir)
SELECT doc.doc_id, coalesce(own.licence, near.licence) AS licence, own.score, CASE WHEN own.licence IS NOT NULL THEN 'notice' WHEN near.licence IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN own.licence IS NULL THEN near.above END AS licence_dir, coalesce(own.n, 0) AS n_notices
FROM doc LEFT JOIN own USING (doc_id) LEFT JOIN near ON doc.dir = near.dir""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no path: one is made from source, language and number, on three levels."""
    docs = table(spark, sf_dir, "documents")
    level = F.when(F.col("doc_id") % 97 > 0, F.col("lang"))
    part = F.when((F.col("doc_id") % 97 > 0) & (F.col("doc_id") % 13 > 0), F.concat(F.lit("part"), F.expr("doc_id div 1000").cast("string")))
    return licenses.license_scan(docs, F.concat_ws("/", "source", level, part, F.col("doc_id").cast("string")))


@query("op11_circulant_minhash", _components_sql(3, 85, ", coalesce(component_id, d.doc_id) = d.doc_id AS kept"))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_components(table(spark, sf_dir, "documents"))


def _rounds_sql() -> str:
    """Three rounds of moved centroids (c1 to c3) from c0, and the last assignment."""
    steps = []
    for i in range(4):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT row, vec_id, x, least.d AS distance, least.j AS cluster FROM (SELECT row, any_value(vec_id) AS vec_id, any_value(v.x) AS x,
  min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT, 'j': c.j}}) AS least FROM v, c{i} c GROUP BY row))""")
        if i < 3:
            steps.append(f"""m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY p) AS x
  FROM (SELECT cluster, p, sum(x[p])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) r(p) GROUP BY cluster, p) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON cluster = j)""")
    return ",\n".join(steps)


@query(
    "op12_centroid_clusters",
    f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h, x LIMIT 16)),
{_rounds_sql()}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON j = cluster""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("scans")


@query(
    "op13_conversation_trie",
    """WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
  lambda r, b: list_reduce(list_concat([xor(r, b)], list_transform(range(8), lambda i: 0::UBIGINT)),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 6 AS h FROM own),
path AS (SELECT own.conv_id, list_concat(coalesce(list_slice(head.t, 1, h), []), list_slice(own.t, h + 1, len(own.t))) AS p
  FROM own JOIN crc USING (conv_id) LEFT JOIN own head ON head.conv_id = own.conv_id - own.conv_id % 100),
step AS (SELECT conv_id, p, len(p) AS n, unnest(range(0, len(p) + 1)) AS d FROM path),
node AS (SELECT d, list_slice(p, 1, d) AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM step GROUP BY d, k),
full_ AS (SELECT node.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM node c WHERE c.d = node.d + 1 AND list_slice(c.k, 1, node.d) = node.k) AS n_children
  FROM node LEFT JOIN node up ON up.d = node.d - 1 AND up.k = list_slice(node.k, 1, node.d - 1)),
spread AS (SELECT unnest(range(0, d + 1)) AS a, k, n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].text) END AS saved FROM full_),
below AS (SELECT a AS d, list_slice(k, 1, a) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM spread GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN below USING (d, k)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
