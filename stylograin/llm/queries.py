"""The registered queries of this package over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograin.llm import decontaminate, kneser_ney, merkle, near_dup, pieces, quality, secrets, set_join, shards, spelling, suffixes, token_counts, warc
from stylograin.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def joined(strings) -> F.Column:
    """SHA-256 of the strings joined by commas."""
    return F.sha2(F.concat_ws(",", strings).cast("binary"), 256)


@query("op7_benchmark_decontamination", sql=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), spread AS (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM spread
), sizes AS (
  SELECT DISTINCT n FROM windows
), runs AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT r.doc_id, r.n, r.i, x.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM runs) r
  JOIN windows x ON r.n = x.n AND r.g = x.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside any 10-word window of a benchmark item, and the items."""
    docs = documents(spark, folder).select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        joined(F.sort_array(F.col("hit_items").cast("array<string>"))).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document under a public byte-level BPE."""
    docs = documents(spark, folder).select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of each document; the rules are learned from the labels."""
    found = quality.judged(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in each document: fixed patterns, and formats learned from what they find."""
    docs = documents(spark, folder).select("doc_id", "text")
    found = secrets.with_secrets(docs, secrets.learned(docs))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != secrets.FORMAT)
    return found.select("doc_id", *[number(k) for k in secrets.KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


@query("op3_piece_encoding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each document under a public piece vocabulary, and whether they decode to the text."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = documents(spark, folder).select("doc_id", "text")
    found = pieces.decoded(pieces.encoded(docs, model), model)
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        F.size("ids").cast("long").alias("n_ids"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


@query("op9_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The component of each document under links of 0.8 similarity on four-word shingles."""
    return near_dup.near_duplicates(documents(spark, folder), size=4, similarity=0.8)


@query("op1_archive_conversion", sql=r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), hashed AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i: translate(to_base(CAST('0x' || substr(hex, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT), 32, 4),
                      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM hashed""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC and read back: what each page's record says."""
    arc, converted = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(spark.read.parquet(f"{folder}/pages.parquet"), arc)
    warc.convert(spark, arc, converted, min_bytes=0)
    return warc.read_warc(spark, converted).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                                   F.col("refers_to_key").alias("refers_to"))


@query("op6_training_order")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus as fixed-stride shards in a keyed order, read back: each slot's sequence, shard, place and digest."""
    import public_tokenizers

    shard_records = 8192
    meta = shards.write_shards(documents(spark, folder), scratch_path(spark, "shards"), tokenizer_path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN, seed=20240229, length=2048, shard_records=shard_records)
    shard = F.floor(F.col("slot") / shard_records)
    return shards.read_records(spark, meta).select(
        "slot", "sequence", shard.alias("shard"), ((F.col("slot") - shard * shard_records) * (2 * meta["length"] + 2)).alias("byte_offset"),
        F.sha2("ids", 256).alias("sha256"))


@query("op8_language_model")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document under a model of three words of the documents that are not held out."""
    docs = documents(spark, folder).select("doc_id", "text").withColumn("held_out", kneser_ney.held_out("doc_id"))
    model = kneser_ney.train(docs.where("NOT held_out"), order=3)
    return kneser_ney.with_scores(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                                                      "base_score", "score")


@query("op2_repeated_strings")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without the 50-byte strings of earlier ones."""
    found = suffixes.without_repeats(documents(spark, folder).select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_removed.alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: CRC-32 for DuckDB: a table of one row with the 256 steps of the polynomial, and the sum over a list of bytes.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps"""


def crc_sql(data: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), "
            "lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)")


def field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW_SQL = " || ".join(field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
SHOWN_SQL = " || ".join(field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", f"translate(text, '{UPPER}', '{LOWER}')"))


@query("op11_merkle_manifest", sql=f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), d AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS grp, sha256({ROW_SQL}) AS leaf,
         CASE WHEN {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 3 = 0
              THEN sha256({SHOWN_SQL}) ELSE sha256({ROW_SQL}) END AS shown
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS pos,
         count(*) OVER (PARTITION BY grp) AS n FROM d
), up AS (
  SELECT grp, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 8, any_value(n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY grp, level, pos // 8
), subroots AS (
  SELECT grp, level, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, place AS pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, any_value(n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1
  GROUP BY level, pos // 8
), nodes AS (
  SELECT grp, level, pos, n, digest FROM up UNION ALL SELECT '', level, pos, n, digest FROM top
), sides AS (
  SELECT grp, level, pos,
         coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1
), fold AS (
  SELECT id, grp, 0 AS level, pos, shown AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT id, f.grp, f.level + 1, f.pos // 8, sha256(l || digest || r), proof || l || r FROM fold f JOIN sides s ON f.grp = s.grp AND f.level = s.level AND f.pos = s.pos
), on_top AS (
  SELECT id, '' AS grp, 0 AS level, place AS pos, f.digest, proof FROM fold f JOIN subroots USING (grp, level)
  UNION ALL
  SELECT id, f.grp, f.level + 1, f.pos // 8, sha256(l || digest || r), proof || l || r FROM on_top f JOIN sides s ON f.grp = s.grp AND f.level = s.level AND f.pos = s.pos
)
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256, o.digest AS folded_root, o.digest = top.digest AS verified
FROM leaves JOIN subroots USING (grp) JOIN on_top o ON o.id = leaves.id JOIN top ON o.level = top.level AND top.n = 1""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle leaf, subroot, root and proof of each document; a third of them are shown lower-cased and must fail if that changes them."""
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    shown = {"text": F.when(tampered, F.translate(text, UPPER, LOWER)).otherwise(text)}
    found = merkle.with_proofs(documents(spark, folder), fields=["doc_id", "source", "lang", "n_chars", "text"], shown=shown)
    proof = F.concat_ws("", F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


BYTES_SQL = """flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128
  THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))"""


@query("op13_spelling_variants", sql=f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents
), counted AS (
  SELECT doc_id, w, length(w) AS size, count(*) AS k FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w
), hashed AS (
  SELECT w, size, k, CASE WHEN doc_id IS NOT NULL THEN {crc_sql(BYTES_SQL)} END AS h FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % size) || substr(w, h % size + 2) ELSE w END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), near AS (
  SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 10 * w.n THEN other END AS form, CASE WHEN x.n >= 10 * w.n THEN x.n END AS form_n
  FROM words w LEFT JOIN near x ON x.word = w.word AND place = 1
), follow AS (
  SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT f.word, g.form, step + 1 FROM follow f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Words of seven letters or more, some with a letter dropped by a rule, and the more frequent words one edit away."""
    def one_letter_dropped(run):
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), run).cast("binary"))
        at = (h % F.char_length(run)).cast("int")
        return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)

    words = spelling.vocabulary(documents(spark, folder), least_length=7, least_count=2, altered=one_letter_dropped)
    return spelling.spelling_variants(words, ratio=10)


def components_sql(percent: int, more: str) -> str:
    """Components of documents linked by four-word shingles; copies are one row until the end."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM d
), classes AS (
  SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (
  SELECT id, n, unnest(s) AS g FROM classes
), linked AS (
  SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id AND a.n * 100 >= {percent} * b.n AND b.n * 100 >= {percent} * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
  SELECT id, id AS other FROM classes
  UNION
  SELECT r.id, b FROM reach r JOIN linked ON r.other = a
), least AS (
  SELECT id, min(other) AS component FROM reach GROUP BY id
)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id{more}
FROM sets LEFT JOIN classes USING (s) LEFT JOIN least USING (id)"""


@query("op12_ngram_jaccard_join", sql=components_sql(85, ""))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The component of each document under links of 0.85 Jaccard similarity on four-word shingles."""
    return set_join.jaccard_components(documents(spark, folder), size=4, percent=85)


SQL["op9_near_duplicates"] = components_sql(80, ", coalesce(component, doc_id) = doc_id AS kept")
