"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, decontamination, language_id, licences, media, mixing, near_dedup, private_data, quality, simhash, spelling, token_counts, vector_codes
from .store import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("near_ids", F.array_join("near_ids", ",")).drop("item_ids", "hit_at")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("row")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(read_table(spark, sf_dir, "documents"), token_counts.planned_edits())


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(read_table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(read_table(spark, sf_dir, "documents"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_data(read_table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(read_table(spark, sf_dir, "documents")).drop("places")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_decontamination,
        op3_quality_classifier,
        op4_language_id,
        op5_source_mixing,
        op6_token_counts,
        op7_class_lm,
        op8_media_columns,
        op9_private_data,
        op10_licence_scan,
        op11_spelling_variants,
        op12_simhash_near_dedup,
        op13_vector_codes,
    )
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _vector_nearest(n: int, book: str) -> str:
    """a<n>: the nearest entry i of each distinct part, ties to the lower, and its squared distance e."""
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(d.v, b.v)])"
    return f"a{n} AS (SELECT q, v, n, min((e, i))[2] AS i, min((e, i))[1] AS e FROM (SELECT d.q, d.v, n, CAST({gap} AS BIGINT) AS e, i FROM d JOIN {book} b USING (q)) GROUP BY ALL)"


def _vector_round(n: int) -> str:
    """b<n>: the codebook after one more round."""
    floored = "CAST(floor(sum(n * x) / sum(n)) AS BIGINT)"
    means = f"SELECT q, i, list(f ORDER BY j) AS v FROM (SELECT q, i, j, {floored} AS f FROM (SELECT q, i, n, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{n}) GROUP BY ALL) GROUP BY ALL"
    return f"{_vector_nearest(n, f'b{n - 1}')}, m{n} AS ({means}), b{n} AS (SELECT q, i, coalesce(m.v, b.v) AS v FROM b{n - 1} b LEFT JOIN m{n} m USING (q, i)),\n"


#: only what SQL can express; the others are tested against brute-force versions
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
    "op2_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT r, i, k, item FROM dw JOIN bw USING (k, g)),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS q FROM h) GROUP BY 1),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY 1),
tk AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
df AS (SELECT term, count(*) AS n FROM tk GROUP BY 1),
bp AS (SELECT row_number() OVER () AS pid, w FROM (SELECT DISTINCT w FROM b WHERE len(w) > 0)),
bc AS (SELECT pid, term, off, n FROM (SELECT pid, unnest(w) AS term, unnest(range(len(w))) AS off FROM bp) JOIN df USING (term)),
bs AS (SELECT pid, s, least(13, len(w)) AS k FROM (SELECT pid, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS s FROM bp)),
pk AS (SELECT pid, s, term, off, row_number() OVER (PARTITION BY pid, s ORDER BY n, term, off) AS rank FROM bs JOIN bc USING (pid) WHERE off >= s AND off < s + k QUALIFY rank <= 3),
pm AS (SELECT DISTINCT pid, s, rank, r, pos - off AS start FROM pk JOIN tk USING (term)),
ps AS (SELECT pid, s, max(rank) AS size FROM pk GROUP BY ALL),
pf AS (SELECT x.pid, x.s, x.r, x.start, count(DISTINCT y.rank) AS got FROM pm x JOIN pm y ON x.pid = y.pid AND x.s = y.s AND x.r = y.r AND x.rank = 1 AND (y.rank = 1 AND y.start = x.start OR y.rank > 1 AND abs(y.start - x.start) <= 4) GROUP BY ALL),
pn AS (SELECT DISTINCT r, b.item FROM pf JOIN ps USING (pid, s) JOIN bp USING (pid) JOIN b ON b.w = bp.w WHERE got = size AND b.item IS NOT NULL),
nr AS (SELECT r, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_ids FROM (SELECT r, item FROM pn EXCEPT SELECT r, item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_ids, '') AS near_ids
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r) LEFT JOIN nr USING (r)""",
    # crc32 by its table of 256 entries, made by the polynomial's rule
    "op11_spelling_variants": f"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
u AS (SELECT r, d, w, count(*) AS n FROM (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({_FOLD}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
b AS (SELECT w, n, [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(x) // 2)] AS b FROM (SELECT w, n, hex(d || ':' || w) AS x FROM u)),
h AS (SELECT w, n, xor(list_reduce([4294967295] || b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, t),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
o AS (SELECT DISTINCT x.word, x.n, v.word AS shorter, v.n AS m FROM x JOIN v ON x.rest = v.word),
e AS (SELECT y.word, z.word AS near, z.n FROM x y JOIN x z USING (i, rest) WHERE y.word <> z.word UNION ALL SELECT word, shorter, m FROM o UNION ALL SELECT shorter, word, n FROM o),
f AS (SELECT word, count(*) AS n_near, -min((-n, near))[1] AS m, min((-n, near))[2] AS near FROM e GROUP BY 1),
g AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN f USING (word)),
c(word, root) AS (SELECT word, word FROM g UNION SELECT c.word, g.form FROM c JOIN g ON c.root = g.word WHERE g.form IS NOT NULL)
SELECT g.word, n, n_near, form, form_n, c.root FROM g JOIN c USING (word) JOIN (SELECT word AS w FROM g WHERE form IS NULL) q ON q.w = c.root""",
    "op13_vector_codes": f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
 WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT max(len(c)) // 16 AS s FROM k),
p AS (SELECT r, q, c[q * s + 1:q * s + s] AS v FROM k, s, range(16) AS t(q)),
d AS (SELECT q, v, count(*) AS n FROM p GROUP BY ALL),
b0 AS (SELECT q, CAST(i AS BIGINT) AS i, v FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, c) - 1 AS i FROM k QUALIFY i < 64) USING (r)),
{"".join(_vector_round(n) for n in (1, 2))}{_vector_nearest(3, "b2")},
w AS (SELECT r, vec_id, label, string_agg(format('{{:02x}}', i), '' ORDER BY q) AS code, CAST(sum(e) AS BIGINT) AS error FROM k JOIN p USING (r) JOIN a3 USING (q, v) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY q, i)) FROM b2) AS codebooks_sha256 FROM w""",
}
