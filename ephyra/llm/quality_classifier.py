"""Quality by perplexity under a Kneser-Ney model of trusted text, against quantiles of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_checked, materialize, quantiles, quantized, sketch, table, without
from .kneser_ney import MODEL_ROWS, UNIT, Model, with_fold

#: A language's limit on the information per byte of text (thousandths of a nat): this quantile of its trusted texts.
LIMIT_AT = 0.99
#: Languages with fewer trusted texts use the quantile of all.
LEAST = 200
#: A table of trusted ids with up to so many rows is broadcast.
ID_ROWS = 1_000_000


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose id is labelled of good quality."""
    ids = materialize(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    return join_checked(docs, ids, "doc_id", "left_semi", ID_ROWS)


def scored(docs: DataFrame, model: Model, model_rows: int = MODEL_ROWS) -> DataFrame:
    rate = F.when(F.col("n_bytes") > 0, F.floor(F.col("nll") * 1000 / UNIT / F.col("n_bytes"))).otherwise(0).cast("long")
    return model.score(with_fold(without(docs, "millinats", "perplexity", "__fold__")), model_rows).drop("__fold__").withColumn("millinats", rate).withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(F.col("nll") / UNIT / F.col("n_bytes"))))


def limits(trusted: DataFrame) -> DataFrame:
    """(__lang__, __most__): the quantile LIMIT_AT of the scores of trusted texts, by mergeable sketches; the row with `_all` is that of
    all languages. The scores are held out: no text is scored by a model that has counted it or a copy."""
    sk = materialize(sketch(trusted.where("n_bytes > 0"), ["lang"], ["millinats"]))
    probs = {"__most__": LIMIT_AT}
    own = quantiles(sk, ["lang"], probs).where(F.col("total") >= LEAST).select(F.col("lang").alias("__lang__"), "__most__", F.lit(False).alias("_all"))
    every = quantiles(sk.groupBy("metric", "v").agg(F.sum("n").alias("n")), [], probs).select(F.lit(None).cast("string").alias("__lang__"), "__most__", F.lit(True).alias("_all"))
    return own.unionByName(every)


def verdicts(rows: DataFrame, lim: DataFrame) -> DataFrame:
    every = lim.where("_all").first()
    fallback = F.lit(every["__most__"] if every else None).cast("long")
    own = lim.where(~F.col("_all")).drop("_all")
    judged = join_checked(rows, own, F.col("lang").eqNullSafe(F.col("__lang__"))).withColumn("max_millinats", F.coalesce("__most__", fallback)).drop("__lang__", "__most__")
    return judged.withColumn("kept", F.coalesce(quantized(F.col("millinats")) <= F.col("max_millinats"), F.lit(True)))


def quality_classifier(docs: DataFrame, trusted: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """docs with n_bytes, nll, millinats (a byte), perplexity (a byte's), max_millinats (of the language) and kept.

    All trusted text is counted, by two models: texts fall in two folds by their hash, each fold's trusted texts make a model, and
    every text, trusted or not, is scored by the model of the other fold, which has counted neither it nor a copy of it. There is
    no cap; the models' size follows the text. One pass counts trusted text, one scores it for the quantiles, one scores docs; no
    shuffle of texts while the models fit `model_rows`.
    Null or empty texts have no perplexity and are kept (this operator has nothing against them). A score in the limit's own
    bucket of the sketch is kept. A null language is one of its own; languages with few trusted texts take the quantiles of all. Without
    trusted text everything is kept. Repeated rows are judged each, clashing columns replaced.
    """
    model = Model.train(with_fold(trusted))
    lim = materialize(limits(scored(trusted.select("text", "lang"), model, model_rows)))
    return verdicts(scored(without(docs, "max_millinats", "kept", "__lang__", "__most__"), model, model_rows), lim)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_classifier(docs, trusted_rows(docs, table(spark, sf_dir, "labels")))
    return out.drop("text")
