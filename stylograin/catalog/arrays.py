"""Id sequences and score arrays. The ids of a document's words are the word lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.joins import TOKENS_SQL, tokens
from stylograin.catalog.registry import query
from stylograin.catalog.tables import DOCS_SQL, Tables
from stylograin.functions import arrays as a

IDS_SQL = f"ids AS (SELECT sample_id, list_transform({TOKENS_SQL}, lambda w: length(w)) AS v FROM docs)"


def text_of(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


def lengths():
    return F.transform(tokens(), lambda w: F.length(w))


def ids(t: Tables):
    return t.documents().select("sample_id", lengths().alias("v"))


MERGED_SQL = """CASE WHEN len(v) <= 510 THEN [101] || v || [102]
  ELSE [101] || v[1:255] || v[len(v) - 254:] || [102] END"""


@query("ar1_head", f"WITH {DOCS_SQL}, {IDS_SQL} SELECT sample_id, array_to_string(v[1:512], ' ') AS head FROM ids")
def head(t: Tables):
    return ids(t).select("sample_id", a.head(F.col("v")).alias("head")).select("sample_id", text_of("head"))


@query("ar2_head_and_tail", f"""WITH {DOCS_SQL}, {IDS_SQL} SELECT sample_id,
  array_to_string({MERGED_SQL}, ' ') AS merged FROM ids""")
def head_and_tail(t: Tables):
    merged = a.head_and_tail(F.col("v"), F.lit(101), F.lit(102))
    return ids(t).select("sample_id", merged.alias("merged")).select("sample_id", text_of("merged"))


@query("ar3_padded_and_mask", f"""WITH {DOCS_SQL}, {IDS_SQL}, x AS (SELECT sample_id, {MERGED_SQL} AS m FROM ids)
  SELECT sample_id, array_to_string(m || list_transform(range(512 - len(m)), lambda i: 1), ' ') AS padded,
  repeat('1', len(m)) || repeat('0', 512 - len(m)) AS mask FROM x""")
def padded_and_mask(t: Tables):
    merged = ids(t).select("sample_id", a.head_and_tail(F.col("v"), F.lit(101), F.lit(102)).alias("m"))
    out = merged.select("sample_id", a.padded(F.col("m"), F.lit(512), F.lit(1)).alias("padded"),
                        a.attention_mask(F.col("m"), F.lit(512)).alias("mask"))
    return out.select("sample_id", text_of("padded"), F.array_join(
        F.transform("mask", lambda x: x.cast("string")), "").alias("mask"))


@query("ar4_padded_to_batch", f"""WITH {DOCS_SQL}, {IDS_SQL}, x AS (SELECT sample_id, sample_id // 32 AS batch, v[1:512] AS v FROM ids),
  b AS (SELECT *, max(len(v)) OVER (PARTITION BY batch) AS n FROM x)
  SELECT sample_id, batch, n AS batch_length, array_to_string(v || list_transform(range(n - len(v)), lambda i: 0), ' ') AS v FROM b""")
def padded_to_batch(t: Tables):
    rows = t.documents().select("sample_id", F.floor(F.col("sample_id") / 32).alias("batch"), a.head(lengths()).alias("v"))
    out = a.padded_to_batch(rows, "batch", "v", F.lit(0))
    return out.select("sample_id", "batch", F.col("batch_length").cast("bigint").alias("batch_length"), text_of("v"))


SEGMENTS_SQL = f"""{IDS_SQL}, seg AS (SELECT sample_id, v AS a, list_distinct_first AS b FROM (SELECT sample_id, v,
    list_transform(list_filter(v, lambda x, i: list_position(v, x) = i), lambda x: x)[1:64] AS list_distinct_first FROM ids))"""


@query("ar5_two_segments", f"""WITH {DOCS_SQL}, {SEGMENTS_SQL}, j AS (SELECT sample_id,
    [0] || a[1:509 - len(b)] || [2] || b || [2] AS s FROM seg)
  SELECT sample_id, array_to_string(s, ' ') AS ids, array_to_string(range(len(s)), ' ') AS position_idx FROM j""")
def two_segments(t: Tables):
    seg = ids(t).select("sample_id", F.col("v").alias("a"), a.first_distinct(F.col("v"), 64).alias("b"))
    out = seg.select("sample_id", a.two_segments(F.col("a"), F.col("b"), F.lit(0), F.lit(2)).alias("ids"))
    return out.withColumn("position_idx", a.positions(F.col("ids"))).select(
        "sample_id", text_of("ids"), text_of("position_idx"))


@query("ar6_clamped_positions", f"""WITH {DOCS_SQL}, {IDS_SQL} SELECT sample_id,
  array_to_string(list_transform(v, lambda x: 1 + least(x, 5 - 1)), ' ') AS mapped FROM ids""")
def clamped_positions(t: Tables):
    return ids(t).select("sample_id", a.clamped_positions(F.col("v"), F.lit(5)).alias("mapped")).select(
        "sample_id", text_of("mapped"))


@query("ar7_argmax", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings""")
def argmax(t: Tables):
    return t.table("embeddings").select("vec_id", a.argmax(F.col("embedding")).alias("pred"))


@query("ar8_softmax", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding)::DOUBLE AS top FROM embeddings),
  p AS (SELECT vec_id, list_transform(v, lambda x: exp(x - top)) AS w FROM e),
  u AS (SELECT vec_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS class, list_sum(w) AS s FROM p)
  SELECT vec_id, class::INTEGER AS class, round(w / s, 6) AS share FROM u""")
def softmax(t: Tables):
    return t.table("embeddings").select("vec_id", F.posexplode(a.softmax(F.col("embedding"))).alias("class", "share"))
