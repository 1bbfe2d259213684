"""Feature stages for Spark ML pipelines: TF-IDF vectors and scaled columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.operators.profile import standard_scales
from stylograin.operators.terms import limit_vocabulary, term_totals, with_idf
from stylograin.session import stored_vectors


def with_log_counts(df: DataFrame, column: str) -> DataFrame:
    """A column of sparse counts as 1 + ln(count), for the terms present.

    Spark ML has no stage for it, and an expression can open a vector but not close it. The
    opened vectors are written to the shared folder and read back as vectors: no Python, and
    the texts before them are not computed again.
    """
    inside = F.unwrap_udt(column)
    opened = F.struct(*[inside[f].alias(f) for f in ("type", "size", "indices")],
                      F.transform(inside["values"], lambda n: 1.0 + F.log(n)).alias("values"))
    return stored_vectors(df.withColumn(column, opened), df.schema)


class TfidfVectors(Estimator):
    """TF-IDF vectors of a token column; the vocabulary is bounded by ``max_features``."""

    def __init__(self, tokens: str, output: str, max_features: int, min_df: int = 1,
                 sublinear: bool = False, scaled: bool = False):
        super().__init__()
        self.tokens, self.output = tokens, output
        self.max_features, self.min_df = max_features, min_df
        self.sublinear, self.scaled = sublinear, scaled

    def totals(self, df: DataFrame) -> DataFrame:
        return term_totals(df, F.col(self.tokens))

    @property
    def weigher(self) -> type:
        return TfidfVectorsModel

    def _fit(self, df: DataFrame) -> TfidfVectorsModel:
        vocab = with_idf(limit_vocabulary(self.totals(df), self.min_df, self.max_features), df)
        rows = vocab.orderBy("term").select("term", "idf").collect()
        model = self.weigher(self.tokens, self.output, [r.term for r in rows], [r.idf for r in rows], self.sublinear)
        if self.scaled:
            vectors = model.transform(df)
            row = vectors.agg(Summarizer.std(F.col(self.output)).alias("std"),
                              F.count(F.lit(1)).alias("n")).first()
            # The population deviation; a constant feature stays as it is.
            spread = row["std"].toArray() * np.sqrt((row["n"] - 1) / row["n"])
            model.factors = [1.0 / s if s > 0 else 1.0 for s in spread]
        return model


class TfidfVectorsModel(Model):
    """Row-wise: nothing is shuffled to weigh a sample."""

    def __init__(self, tokens: str, output: str, terms: Sequence[str], idf: Sequence[float],
                 sublinear: bool, factors: Sequence[float] | None = None):
        super().__init__()
        self.tokens, self.output, self.terms, self.idf = tokens, output, list(terms), list(idf)
        self.sublinear, self.factors = sublinear, factors

    def _transform(self, df: DataFrame) -> DataFrame:
        # A fit on samples without any known term still needs one slot.
        terms, idf = (self.terms, self.idf) if self.terms else ([""], [1.0])
        out = CountVectorizerModel.from_vocabulary(terms, self.tokens, "_tf").transform(df)
        if self.sublinear:
            out = with_log_counts(out.drop(self.tokens), "_tf")
        weighed = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w")
        last = "_n" if self.factors else self.output
        out = Normalizer(p=2.0, inputCol="_w", outputCol=last).transform(weighed.transform(out))
        if self.factors:
            stage = ElementwiseProduct(scalingVec=Vectors.dense(self.factors), inputCol="_n",
                                       outputCol=self.output)
            out = stage.transform(out).drop("_n")
        return out.drop("_tf", "_w")


class ScaledColumns(Estimator):
    """Standardise named columns with mean and population deviation, then assemble them."""

    def __init__(self, columns: Sequence[str], output: str):
        super().__init__()
        self.columns, self.output = list(columns), output

    def _fit(self, df: DataFrame) -> ScaledColumnsModel:
        return ScaledColumnsModel(self.columns, self.output, standard_scales(df, self.columns))


class ScaledColumnsModel(Model):
    def __init__(self, columns: Sequence[str], output: str, scales):
        super().__init__()
        self.columns, self.output, self.scales = list(columns), output, dict(scales)

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = {f"_z_{c}": (F.col(c) - self.scales[c][0]) / self.scales[c][1] for c in self.columns}
        assembler = VectorAssembler(inputCols=list(scaled), outputCol=self.output)
        return assembler.transform(df.withColumns(scaled)).drop(*scaled)


def assembled(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """One vector of several columns or vectors."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)
