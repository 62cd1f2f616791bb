"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import exact, licences, lines, minhash, mixing, pieces, pii, quality, sharding, sketch_search, token_counts, toxicity, whitening
from sievework.plans.registry import literal, query
from sievework.session import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", pieces.encode(F.col("text"), piece_model()).alias("ids"))
    return docs.withColumn("decoded", pieces.decode(F.col("ids"), piece_model())).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


BLANKS_SQL = r"[\x20\x09-\x0D]"

OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, pos, ls[pos] AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.UPPER}', '{lines.LOWER}') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.without_lines(docs, lines.dropped_bitmaps(docs, min_docs=10, min_chars=1), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANKS_SQL}+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""


@query("op7_exact_dedup", OP7_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


OP9_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
often AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN often USING (h)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM y a JOIN y b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 85 * (na.n + nb.n - same)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


@query("op9_minhash", OP9_SQL)
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, rows=7)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, 17

OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS place FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS words,
    [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY words / w, source NULLS LAST) AS i, sum(words) OVER () AS total FROM t),
lv AS (
  SELECT *, total * {SHARE} - {MOST} * coalesce(sum(words) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM r),
firsts AS (SELECT min(i) AS i FROM lv WHERE NOT (remaining * w / weight > {MOST} * words)),
g AS (
  SELECT lv.source, lv.words, CASE WHEN f.i IS NULL OR lv.i < f.i THEN ({MOST} * lv.words)::DOUBLE
    ELSE (nx.remaining * lv.w / nx.weight)::DOUBLE END AS target
  FROM lv CROSS JOIN firsts f LEFT JOIN lv nx ON nx.i = f.i),
k AS (
  SELECT *, CASE WHEN words = 0 THEN 0 ELSE floor(target / words) END AS passes FROM g),
o AS (
  SELECT d.*, k.words, k.target, k.passes, k.target - k.passes * k.words AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS up_to
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
e AS (
  SELECT *, rest > 0 AND (up_to < rest OR (up_to - size < rest AND abs(up_to - rest) < abs(up_to - size - rest))) AS more FROM o)
SELECT doc_id, size, words AS source_size, target, (size * (passes + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""


@query("op5_mixing", OP5_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    draws, sources = mixing.mix(sizes, WEIGHTS, SHARE, MOST, SEED)
    keys = ["doc_id", "source", "mark"]  # rows that are equal in these are drawn together: each as often as the others
    times = draws.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.max("copy") + 1).alias("times"))
    named = sources.withColumnRenamed("source", "named")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return (
        sizes.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("named")))
        .join(times, same, "left")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    )


def _licence_sql() -> str:
    names = ", ".join(f"({literal(words)}, {literal(name)})" for name, words in licences.SENTENCES)
    # an identifier is enclosed in blanks, others may stand between those of a rule
    pattern = lambda ids: "( [^ ]+ )*".join(" " + x.replace(".", "[.]") + " " for x in ids)
    rules = ", ".join(f"CASE WHEN regexp_matches(line, {literal(pattern(ids))}) THEN {literal(name)} END" for name, ids in licences.RULES)
    hidden = " OR ".join(f"(x IN ({', '.join(map(literal, less))}) AND list_contains(found, {literal(name)}))" for name, less in licences.HIDES.items())
    return f"""
WITH names(words, name) AS (VALUES {names}),
s AS (
  SELECT doc_id, i, trim(regexp_replace(ss[i], '[^a-z0-9]+', ' ', 'g')) AS words FROM (
    SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '{licences.SENTENCE_END}') AS ss FROM documents))),
f AS (SELECT doc_id, list(name ORDER BY i) AS ids FROM s JOIN names USING (words) GROUP BY doc_id),
l AS (SELECT *, ' ' || array_to_string(ids, '  ') || ' ' AS line FROM f),
h AS (SELECT doc_id, ids, list_filter([{rules}], lambda x: x IS NOT NULL) AS found FROM l),
u AS (SELECT doc_id, ids, list_filter(found, lambda x, i: list_position(found, x) = i AND NOT ({hidden})) AS held FROM h)
SELECT d.doc_id, coalesce(array_to_string(u.ids, ' '), '') AS sentence_ids, coalesce(array_to_string(u.held, ' '), '') AS licences
FROM documents d LEFT JOIN u USING (doc_id)
"""


@query("op8_licences", _licence_sql())
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document: the document is encoded whole, crossing tokens go by most of their bytes."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("sections", token_counts.lines(F.col("text")))
    counts = token_counts.token_counts(F.col("text"), F.col("sections"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = docs.select("doc_id", "sections", counts.alias("counts"))
    return both.select("doc_id", F.posexplode(F.arrays_zip("sections", "counts")).alias("section", "s")).select(
        "doc_id", "section", (F.col("s.sections.end") - F.col("s.sections.start")).alias("n_chars"), F.col("s.counts").alias("n_tokens")
    )


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.outliers(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


TOXIC_FROM = 0.3


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.spans(F.col("text"), pii.fit(docs)).alias("found"))

    def written(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["base"])
    counts = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


@query("op11_hilbert")
def op11_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of equal numbers of rows along a curve through source, language and size; equal texts of a cell are neighbours."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    dealt = sharding.hilbert_shards(docs, ["source", "lang", "size"], shards=16, law="rows", ties=["text_crc32", "doc_id"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


#: Terms of op12, as DuckDB finds them.
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}'), '{TERM_SQL}') AS ws FROM documents),
h AS (SELECT doc_id, ws, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
tot AS (SELECT count(*)::BIGINT AS total_docs, sum(n)::BIGINT AS total_terms FROM h),
tf AS (SELECT doc_id, n, word, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ws) AS word FROM h) GROUP BY ALL),
df AS (SELECT word, count(*)::BIGINT AS df FROM tf GROUP BY word),
q AS (SELECT item_id, word, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}'), '{TERM_SQL}')) AS word FROM benchmark) GROUP BY ALL),
w AS (SELECT word, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, tot),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total_docs) // total_terms))))::BIGINT AS score
  FROM q JOIN w USING (word) JOIN tf USING (word), tot GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query("op12_max_sketches", OP12_SQL)
def op12_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, length = whitening.usable(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    return whitening.whiten(rows, "vec_id", whitening.fit(rows, length))
