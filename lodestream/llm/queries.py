"""The registered queries of this subpackage: thin views of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.common import Scratch, table


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.html_template import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.quality import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.token_store import token_index, write_tokens

    path = Scratch(spark, "tokens").path("orc")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.pieces import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_template, op2_minhash_near_dedup, op3_embedding_near_dedup, op4_weak_label_quality, op5_best_fit_packing, op6_spaced_seed_decontamination, op7_language_id, op8_kneser_ney, op9_token_store, op10_pii, op11_prefix_trie, op12_piece_encoding, op13_collocations)}

NEAR_TEXTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(r.y) AS component_id, min(r.y) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
    THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.b FROM reach r JOIN link e ON r.y = e.a),
deg AS (SELECT a, count(*) AS d FROM link GROUP BY a)
SELECT v.vec_id, any_value(coalesce(d, 0))::BIGINT AS n_links, min(r.y) AS component_id, min(r.y) = v.vec_id AS kept
FROM v JOIN reach r ON r.x = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id GROUP BY v.vec_id
"""

LEAKS = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09-\x0D\x20]+', ' ', 'g')), ' ') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, t, len(t) AS n, row_number() OVER () AS version FROM (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(text), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09-\x0D\x20]+', ' ', 'g')), ' ') AS t
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE t <> ['']),
dt AS (SELECT DISTINCT doc_id, unnest(t) AS w, unnest(range(0, len(t))) AS i FROM d),
bt AS (SELECT item_id, version, n, unnest(t) AS w, unnest(range(0, n)) AS k FROM b),
diagonals AS (SELECT doc_id, item_id, version, any_value(n) AS n, i - k AS start, count(*) AS n_match, list(k ORDER BY k) AS places
  FROM dt JOIN bt USING (w) GROUP BY doc_id, item_id, version, i - k HAVING count(*) >= least(any_value(n), 7))
SELECT doc_id, item_id, max(n_match)::BIGINT AS n_match, max(n)::BIGINT AS n_words, min(start)::BIGINT AS first_at FROM diagonals
WHERE n_match >= ceil(0.6 * n) OR len(list_filter(range(1, len(places) - 15), lambda j: places[j + 16] - places[j] < 24)) > 0
GROUP BY doc_id, item_id
"""

TRIE = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT c.conv_id, 0 AS own, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.donor AND t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
lists AS (SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY own, k) FILTER (r.conv_id IS NOT NULL), []) AS l FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, len(l) AS size, unnest(range(len(l) + 1)) AS depth, l FROM lists),
nodes AS (SELECT depth, l[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth) AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(l[1:depth][depth].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS n_words FROM prefixes GROUP BY depth, l[1:depth]),
named AS (SELECT n.*, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes m ON m.depth = n.depth - 1 AND m.p = n.p[1:n.depth - 1]),
kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM named WHERE depth > 0 GROUP BY 1, 2),
leaf AS (SELECT n.p, n.depth FROM named n LEFT JOIN kids k ON k.depth = n.depth AND k.conv_id = n.conv_id WHERE k.n IS NULL),
leaves AS (SELECT p[1:d] AS p, d AS depth, count(*) AS n FROM (SELECT p, unnest(range(depth + 1)) AS d FROM leaf) GROUP BY 1, 2),
savings AS (SELECT p[1:d] AS p, d AS depth, sum(s) AS saved FROM (SELECT p, (n_convs - 1) * n_words AS s, unnest(range(depth + 1)) AS d FROM nodes) GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, l.n::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM named n LEFT JOIN kids k ON k.depth = n.depth AND k.conv_id = n.conv_id JOIN leaves l ON l.depth = n.depth AND l.p = n.p JOIN savings s ON s.depth = n.depth AND s.p = n.p
"""

PHRASES = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS t FROM pieces),
total AS (SELECT lang, sum(len(t))::HUGEINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(t[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM w, range(1, 6) AS ks(k))),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*)::HUGEINT AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
inside AS (SELECT DISTINCT g.lang, g.phrase FROM (SELECT lang, a, k, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) AS phrase FROM f WHERE k > 2) g JOIN f ON f.lang = g.lang AND f.phrase = g.phrase AND 100 * g.a >= 100 * f.a),
cuts AS (SELECT f.lang, f.phrase, f.a, unnest(range(1, k)) AS cut, string_split(f.phrase, ' ') AS t, k FROM f ANTI JOIN inside USING (lang, phrase) WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score, cut FROM cuts c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(t[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(t[cut + 1:c.k], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM weakest QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op6_spaced_seed_decontamination": LEAKS, "op2_minhash_near_dedup": NEAR_TEXTS, "op3_embedding_near_dedup": NEAR_VECTORS, "op11_prefix_trie": TRIE, "op13_collocations": PHRASES}
