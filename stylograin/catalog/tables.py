"""The given tables seen as samples, predictions and trees, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograin.functions.labels import correct, rule_prediction
from stylograin.functions.text import word_count
from stylograin.operators.trees import markup_marks, nest
from stylograin.sources.readers import read_texts

# Stand-ins for the parameters of the library, chosen for the given tables.
SEEN = ["en", "fr"]
LANGS = ["de", "en", "es", "fr"]
MARKERS = ["ionen", "elle"]
GROUPS_SEEN = [0, 1, 2, 3]
CUT = 34.59


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def texts(self, name: str, key: str) -> DataFrame:
        return read_texts(self.spark, self.path(name), key)

    def labels(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), "toxic")

    def listing(self) -> DataFrame:
        """Documents as samples, without their text."""
        return as_samples(self.table("documents")).drop("code")

    def documents(self) -> DataFrame:
        """Documents as samples."""
        return as_samples(self.texts("documents", "doc_id"))

    def with_labels(self, rows: DataFrame) -> DataFrame:
        """The labelled ones among ``rows``. What a text yields is best computed before this
        join, so that the text itself stays out of the shuffle."""
        return rows.join(self.labels(), "sample_id").where(F.col("label").isNotNull())

    def labelled(self) -> DataFrame:
        return self.with_labels(self.documents())

    def labelled_listing(self) -> DataFrame:
        return self.with_labels(self.listing())

    def all_listing(self) -> DataFrame:
        """All samples without their text; the label is null where there is none."""
        return self.listing().join(self.labels(), "sample_id", "left")

    def judged(self) -> DataFrame:
        """Labelled samples with a rule prediction, ``correct`` and the word count."""
        docs = self.documents().withColumns({
            "pred": rule_prediction(F.col("code"), MARKERS),
            "words": word_count(F.col("code"))}).drop("code")
        return self.with_labels(docs).withColumn("correct", correct(F.col("label"), F.col("pred")))

    def scored(self) -> DataFrame:
        """Events as a prediction set."""
        return self.table("events").select(
            F.col("event_id").alias("sample_id"),
            (F.col("event_type") == "purchase").cast("int").alias("y"),
            F.col("value").alias("score"), (F.col("value") >= CUT).cast("int").alias("pred"),
            (F.col("user_id") % 8).cast("int").alias("grp"))

    def pages(self) -> DataFrame:
        """Pages as samples: language from the markup, label = the address has a query part."""
        language = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
        step = F.col("sample_id") % 10
        split = (F.when(F.col("language").isin("de", "es") | (step == 9), "ood")
                 .when(step.isin(7, 8), "val").otherwise("train"))
        return self.texts("pages", "page_id").select(
            F.col("page_id").alias("sample_id"), F.col("html").alias("code"), language.alias("language"),
            F.contains("url", F.lit("?")).cast("int").alias("label")).withColumn("split", split)

    def nodes(self) -> DataFrame:
        """The nesting tree of the pages."""
        pages = self.texts("pages", "page_id").select(F.col("page_id").alias("sample_id"), "html")
        return nest(markup_marks(pages, "html"))


def as_samples(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("code"), F.col("lang").alias("language"),
        F.col("source").alias("generator"), "n_chars", split_of(F.col("doc_id"), F.col("lang")).alias("split"))


def split_of(key: Column, language: Column) -> Column:
    step = F.floor(key / 20) % 10
    return (F.when(language.isin("de", "es") | (step == 9), "ood")
            .when(step.isin(7, 8), "val").otherwise("train"))


SPLIT_SQL = """CASE WHEN lang IN ('de', 'es') OR (doc_id // 20) % 10 = 9 THEN 'ood'
    WHEN (doc_id // 20) % 10 IN (7, 8) THEN 'val' ELSE 'train' END"""

DOCS_SQL = f"""docs AS (SELECT doc_id AS sample_id, text AS code, lang AS language,
  source AS generator, n_chars, {SPLIT_SQL} AS split FROM documents)"""

SAMPLES_SQL = f"""{DOCS_SQL}, samples AS (SELECT docs.*, l.quality AS label, l.toxic
  FROM docs LEFT JOIN labels l ON l.doc_id = docs.sample_id)"""

WORDS_SQL = r"len(list_filter(regexp_split_to_array(code, '\s+'), lambda w: w <> ''))"

RULE_SQL = "CAST(contains(code, '{}') OR contains(code, '{}') AS INTEGER)".format(*MARKERS)

JUDGED_SQL = f"""{SAMPLES_SQL}, judged AS (SELECT *, CAST(pred = label AS INTEGER) AS correct FROM
  (SELECT *, {RULE_SQL} AS pred, {WORDS_SQL} AS words FROM samples WHERE label IS NOT NULL))"""

SCORED_SQL = f"""scored AS (SELECT event_id AS sample_id, CAST(event_type = 'purchase' AS INTEGER) AS y,
  value AS score, CAST(value >= {CUT} AS INTEGER) AS pred, CAST(user_id % 8 AS INTEGER) AS grp
  FROM events)"""

PAGES_SQL = r"""page_samples AS (SELECT page_id AS sample_id, language, label,
  CASE WHEN language IN ('de', 'es') OR page_id % 10 = 9 THEN 'ood' WHEN page_id % 10 IN (7, 8) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT page_id, CAST(contains(url, '?') AS INTEGER) AS label, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language FROM pages))"""

# Depth by running sum; parent by the last opener one level up (a different route than
# the runs used in Spark).
NODES_SQL = r"""tags AS (SELECT page_id AS sample_id, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(
    regexp_replace(regexp_replace(html, '<script\b.*?</script>', '', 'gis'), '<style\b.*?</style>', '', 'gis'),
    '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS t FROM pages)),
marks AS (SELECT sample_id, pos, lower(ltrim(tag, '/')) AS type, CASE WHEN tag LIKE '/%' THEN -1
  WHEN lower(tag) IN ('br', 'meta', 'img', 'hr', 'input', 'link') THEN 0 ELSE 1 END AS step FROM tags),
placed AS (SELECT *, CAST(sum(step) OVER (PARTITION BY sample_id ORDER BY pos) AS BIGINT)
  - CASE WHEN step = 1 THEN 1 ELSE 0 END AS depth FROM marks),
both_ends AS (SELECT sample_id, pos, type, depth, depth AS lvl, type AS up, pos AS up_pos
    FROM placed WHERE step = 1
  UNION ALL SELECT sample_id, pos, type, depth, depth - 1, NULL, NULL FROM placed WHERE step >= 0),
linked AS (SELECT *, last_value(up IGNORE NULLS) OVER w AS parent_type,
    last_value(up_pos IGNORE NULLS) OVER w AS parent_id FROM both_ends
  WINDOW w AS (PARTITION BY sample_id, lvl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
childs AS (SELECT * FROM linked WHERE up_pos IS NULL),
kids AS (SELECT sample_id, parent_id AS node_id, count(*) AS n_children FROM childs
  WHERE parent_id IS NOT NULL GROUP BY ALL),
nodes AS (SELECT c.sample_id, c.pos AS node_id, c.parent_id, c.depth, c.type, c.parent_type,
    coalesce(k.n_children, 0) AS n_children
  FROM childs c LEFT JOIN kids k ON k.sample_id = c.sample_id AND k.node_id = c.pos)"""
