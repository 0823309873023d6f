"""Operators as pyspark.ml stages."""

from __future__ import annotations

import posixpath

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators import features as feats
from logweave.operators import vocab as voc
from logweave.operators.sessions import gap_chunk_sessions
from logweave.operators.windows import frame_windows, sliding_windows
from logweave.runtime import broadcast_if_small, materialize


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class FirstSeenIndexer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Ids by first occurrence, from 1 or continuing a prior mapping."""

    orderCol = _param("orderCol", "line order column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="template", outputCol="ID", orderCol="line_id"):
        super().__init__()
        self._setDefault(inputCol="template", outputCol="ID", orderCol="line_id")
        self._set(**self._input_kwargs)
        self._mapping: DataFrame | None = None

    def setMapping(self, mapping: DataFrame | None) -> FirstSeenIndexer:
        """Prior mapping as a table ``inputCol, outputCol``; it is not saved with the stage."""
        self._mapping = mapping
        return self

    def mapping(self, df: DataFrame) -> DataFrame:
        return voc.first_seen_ids(
            df, self.getInputCol(), self.getOutputCol(), self.getOrDefault(self.orderCol), self._mapping
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        ids = voc.stored(self.mapping(df))
        return df.join(voc.broadcast_if_small(ids), self.getInputCol(), "left")


class GapChunkSessionizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Gap and fixed-chunk session ids from a timestamp column."""

    interval = _param("interval", "gap and chunk length in seconds", TypeConverters.toInt)
    partitionCols = _param("partitionCols", "columns with their own sessions", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="ts", outputCol="session_id", interval=0, partitionCols=()):
        super().__init__()
        self._setDefault(inputCol="ts", outputCol="session_id", interval=0, partitionCols=[])
        self._set(**self._input_kwargs)

    def setInterval(self, value: int) -> GapChunkSessionizer:
        return self._set(interval=value)

    def _transform(self, df: DataFrame) -> DataFrame:
        return gap_chunk_sessions(
            df, self.getOrDefault(self.interval), self.getInputCol(), self.getOutputCol(),
            self.getOrDefault(self.partitionCols),
        )


class FrameWindower(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fixed-size frames per group."""

    windowSize = _param("windowSize", "rows per frame", TypeConverters.toInt)
    stride = _param("stride", "rows between frame starts", TypeConverters.toInt)
    groupCol = _param("groupCol", "group column", TypeConverters.toString)
    labelCol = _param("labelCol", "label column", TypeConverters.toString)
    orderCol = _param("orderCol", "row order inside a group", TypeConverters.toString)
    compat = _param("compat", "only starts among the first rows of a group", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="ID", outputCol="window", windowSize=10, stride=1, groupCol="group",
                 labelCol="label", orderCol="line_id", compat=False):
        super().__init__()
        self._setDefault(inputCol="ID", outputCol="window", windowSize=10, stride=1, groupCol="group",
                         labelCol="label", orderCol="line_id", compat=False)
        self._set(**self._input_kwargs)

    def setWindowSize(self, value: int) -> FrameWindower:
        return self._set(windowSize=value)

    def setStride(self, value: int) -> FrameWindower:
        return self._set(stride=value)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = lambda name: self.getOrDefault(self.getParam(name))
        made = frame_windows(
            df, self.getInputCol(), get("labelCol"), get("groupCol"), get("orderCol"),
            get("windowSize"), get("stride"), get("compat"),
        )
        return made.withColumnRenamed("window", self.getOutputCol())


class _ExtractorParams(Params):
    labelType = _param("labelType", "next_log, anomaly or none", TypeConverters.toString)
    featureType = _param("featureType", "sequentials, semantics or quantitatives", TypeConverters.toString)
    windowSize = _param("windowSize", "lines per window", TypeConverters.toInt)
    stride = _param("stride", "lines between window starts", TypeConverters.toInt)
    maxTokenLen = _param("maxTokenLen", "tokens kept per template; all of them when unset", TypeConverters.toInt)
    minTokenCount = _param("minTokenCount", "smallest count of a vocabulary token", TypeConverters.toInt)
    useTfidf = _param("useTfidf", "tf-idf rows instead of token ids", TypeConverters.toBoolean)
    lowerFirst = _param("lowerFirst", "lower-case before tf-idf tokenizing", TypeConverters.toBoolean)

    DEFAULTS = dict(labelType="next_log", featureType="sequentials", windowSize=10, stride=1, maxTokenLen=None,
                    minTokenCount=1, useTfidf=False, lowerFirst=False)

    def _get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class LogFeatureExtractor(Estimator, _ExtractorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Vocabularies from training lines; the model turns lines into windows with features.

    Lines need ``session_id, pos, line_id, template, label``.
    """

    @keyword_only
    def __init__(self, *, labelType="next_log", featureType="sequentials", windowSize=10, stride=1,
                 maxTokenLen=None, minTokenCount=1, useTfidf=False, lowerFirst=False):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, lines: DataFrame) -> LogFeatureModel:
        templates = voc.stored(voc.template_vocabulary(lines))
        tokens = idf = None
        if self._get("featureType") == "semantics":
            tokens = voc.stored(voc.token_vocabulary(templates, self._get("minTokenCount")))
            if self._get("useTfidf"):
                idf = voc.stored(feats.idf(lines, self._get("lowerFirst")))
        model = LogFeatureModel(templates, tokens, idf)
        return self._copyValues(model)


class LogFeatureModel(Model, _ExtractorParams, MLReadable, MLWritable):
    """Fitted vocabularies."""

    def __init__(self, templates: DataFrame, tokens: DataFrame | None = None, idf: DataFrame | None = None):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self.templates, self.tokens, self.idf = templates, tokens, idf

    def metadata(self) -> DataFrame:
        return voc.metadata(self._get("labelType"), self._get("featureType"), self.templates, self.tokens)

    def vocab_size(self) -> int:
        return self.metadata().first()["vocab_size"]

    def _transform(self, lines: DataFrame) -> DataFrame:
        kind, size, stride = self._get("featureType"), self._get("windowSize"), self._get("stride")
        encoded = voc.encode_templates(lines, self.templates)
        if kind == "sequentials":
            return feats.sequential(sliding_windows(encoded, size, stride))
        if kind == "quantitatives":
            return feats.quantitative(sliding_windows(encoded, size, stride), self.vocab_size())
        if kind != "semantics":
            raise ValueError(f"unknown feature type {kind!r}")
        distinct = voc.distinct_templates(encoded)
        if self._get("useTfidf"):
            dim = self.vocab_size()
            weights = feats.tfidf_from_idf(distinct, self.idf, self.tokens, self._get("lowerFirst"))
            table = feats.dense_tfidf(weights, dim)
            filler = F.array_repeat(F.lit(0.0), dim)
        else:
            length = self._get("maxTokenLen")
            table = feats.template_token_ids(distinct, self.tokens, length).withColumnRenamed("token_ids", "features")
            # Windows of whole templates are filled with empty ones.
            filler = F.array_repeat(F.lit(0), length or 0)
        featured = feats.attach_template_features(encoded, voc.stored(table))
        featured = featured.withColumn("features", F.coalesce("features", filler))
        return sliding_windows(featured, size, stride, carry={"features": filler})

    def transform_late(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Windows with tf-idf features that are looked up, not carried: ``windows`` with ``feature_ids``, one number per line (-1 as
        filler), and the ``dictionary`` of the lines' distinct templates by ``feature_id`` (``features.tfidf_dictionary``).

        A window is as long as its lines, whatever the vocabulary; ``features.window_tfidf`` and the like bring the two together.
        """
        # The text meets the vocabulary once; afterwards only lines of unseen templates carry it.
        unseen = F.col("template_id") == voc.OOV_ID
        encoded = voc.encode_templates(lines, self.templates).withColumn("template", F.when(unseen, F.col("template")))
        encoded = materialize(encoded, "zstd")
        old = self.templates.select("template", F.col("template_id").cast("long").alias(voc.NUMBER))
        count, top = old.agg(F.count(F.lit(1)), F.coalesce(F.max(voc.NUMBER), F.lit(voc.OOV_ID))).first()
        used = encoded.where(~unseen).select(F.col("template_id").cast("long").alias(voc.NUMBER)).distinct()
        if used.count() < count:
            old = old.join(broadcast_if_small(materialize(used)), voc.NUMBER, "left_semi")
        new = voc.numbered_templates(encoded.where(unseen)).select("template", (F.col(voc.NUMBER) + (top + 1)).alias(voc.NUMBER))
        dictionary = feats.tfidf_dictionary(old.unionByName(new), self.idf, self.tokens, self._get("lowerFirst"))
        known = encoded.where(~unseen).withColumn("feature_id", F.col("template_id").cast("long")).unionByName(
            encoded.where(unseen).join(broadcast_if_small(new.withColumnRenamed(voc.NUMBER, "feature_id")), "template", "left"))
        made = sliding_windows(known, self._get("windowSize"), self._get("stride"), carry={"feature_id": F.lit(-1).cast("long")})
        return made.withColumnRenamed("feature_id", "feature_ids"), dictionary

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: LogFeatureModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name in ("templates", "tokens", "idf"):
            table = getattr(self.model, name)
            if table is not None:
                table.write.parquet(posixpath.join(path, name))


class _ModelReader(MLReader):
    def load(self, path: str) -> LogFeatureModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        params = {**_ExtractorParams.DEFAULTS, **meta["paramMap"]}
        semantic = params["featureType"] == "semantics"
        read = lambda name: spark.read.parquet(posixpath.join(path, name))
        model = LogFeatureModel(
            read("templates"), read("tokens") if semantic else None,
            read("idf") if semantic and params["useTfidf"] else None,
        )
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
