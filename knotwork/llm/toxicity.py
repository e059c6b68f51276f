"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of insults from a fixed list and from a lexicon
learned here, closeness of hits to second-person words, rates of capitals,
punctuation and obfuscated spellings, and length. The learned lexicon holds
words and word beginnings (four letters, so that inflected forms count) whose
share of toxic documents is far above chance. Labels of at most ``MOST_ROWS``
rows (a hash sample of the training fold, the bound on what is broadcast) are
used, in three disjoint parts: one for the lexicon, one for the trees, one for
the calibration, so no part is fitted on what an earlier one has seen.

Scoring is narrow: no shuffle, each text is read once. The learned lexicon is
bounded by ``LEXICON`` entries.

Results: scores lie in 0..1; null and empty texts get the score of their (empty)
features; labels with a null doc_id or value are ignored, and of several labels
of one doc_id the greatest counts; without labels of both kinds every score is
the known share of toxic rows, or 0. Repeated rows get repeated scores; an empty
table gives an empty table; other columns are passed on untouched, whatever
their names.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

MOST_ROWS, LEXICON, PREFIX, THRESHOLD = 24_000, 3_000, 4, 0.7
#: Standard deviations above chance, and toxic documents, that a lexicon entry needs.
LEAST_Z, LEAST_DOCS = 5.0, 3

#: Common insults, and second-person words, in four languages.
INSULTS = {*"idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb fool jerk creep freak garbage filth vermin pig ugly liar bastard idiota estúpido imbécil tonto basura asqueroso inútil payaso imbécile stupide débile ordure minable dégoûtant nul crétin dumm blöd trottel abschaum müll wertlos ekelhaft versager depp".split()}
SECOND_PERSON = {*"you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()}
LEET = str.maketrans("013457@$!", "oieastasi")

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
NAMES = ["insult_density", "lexicon_density", "lexicon_count", "lexicon_weight", "distinct_hits", "near_second_person", "second_person_density", "capitals", "capital_words", "exclamations", "questions", "other_punctuation", "obfuscated", "repeated_letters", "log_words"]

LEX, INSULT, YOU, CAPS, ODD, RUN = (1 << i for i in range(6))


def plain(word: str) -> tuple[str, bool]:
    """The word's letters in lower case, and whether it was spelled with signs in between."""
    core = EDGES.sub("", word.lower())
    if core.isalpha() or not core:
        return core, False
    read = re.sub(r"[\W_]", "", core.translate(LEET))
    odd = read.isalpha() and sum(c.isalpha() for c in core) * 2 >= len(core) and not re.fullmatch(r"\w+(?:[-'’]\w+)*", core.rstrip("0123456789"))
    odd |= read.isalpha() and bool(re.fullmatch(r"[^\W_]+", core)) and bool(re.search(r"[^\W\d_]\d+[^\W\d_]", core))
    return (read if odd else core), bool(odd)


def entries(word: str) -> list[str]:
    """The word and its beginning, as the lexicon names them."""
    return [word, word[:PREFIX] + "*"] if len(word) > PREFIX else [word] if word else []


class Features:
    """Feature rows of texts, under one lexicon (entry: weight)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memo = W.WordMemo(self.codes)

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(len(words), np.uint32)
        for i, raw in enumerate(words):
            word = raw.decode("utf-8", "replace")
            core, odd = plain(word)
            weight = max((self.lexicon.get(e, 0.0) for e in entries(core)), default=0.0)
            code = (LEX if weight > 0 else 0) | (INSULT if core in INSULTS else 0) | (YOU if core in SECOND_PERSON else 0)
            code |= (CAPS if len(core) > 1 and word.isupper() else 0) | (ODD if odd else 0) | (RUN if re.search(r"([^\W\d_])\1\1", core) else 0)
            out[i] = code | min(int(weight * 256), 0xFFFF) << 16
        return out, np.ones(len(words), np.int64)

    def rows(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        rows = self.memo.lookup(list(chain.from_iterable(split)))
        code = self.memo.flat[rows]
        doc = np.repeat(np.arange(len(texts)), size)
        n = np.maximum(size, 1)

        def count(flag: int) -> np.ndarray:
            return np.bincount(doc[(code & flag) > 0], minlength=len(texts)).astype(float)

        hit = (code & (LEX | INSULT)) > 0
        # Places with a gap between texts, so that no word is near one of another text.
        place = np.arange(len(doc)) + 10 * doc
        you = place[(code & YOU) > 0]
        at = place[hit]
        near = np.zeros(len(at), bool)
        if len(you):
            k = np.searchsorted(you, at)
            near = (np.abs(you[np.minimum(k, len(you) - 1)] - at) <= 5) | (np.abs(you[np.maximum(k - 1, 0)] - at) <= 5)
        pairs = np.unique(np.stack([doc[hit], rows[hit]], 1), axis=0) if hit.any() else np.empty((0, 2), np.int64)
        chars = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)

        def among(signs: bytes) -> np.ndarray:
            return np.array([len(t) - len(t.translate(None, signs)) for t in texts], float) / chars

        lex = count(LEX)
        columns = [
            count(INSULT) / n, lex / n, np.log1p(lex), np.bincount(doc, code >> 16, len(texts)) / 256 / n,
            np.log1p(np.bincount(pairs[:, 0], minlength=len(texts))), np.bincount(doc[hit][near], minlength=len(texts)) / n, count(YOU) / n,
            among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(CAPS) / n, among(b"!"), among(b"?"), among(b"#$%&*+/<=>@\\^_`{|}~"), count(ODD) / n, count(RUN) / n, np.log1p(size),
        ]
        return np.stack(columns, 1)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def sample_labels(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, part) of about ``most`` training rows at most, the same whenever it is asked for."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = rows.where(~F.coalesce(held_out(F.col("label_id")), F.lit(False)))
    every = max(1, -(-rows.count() // most))
    chosen = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(every)) == 0).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    # Sixths: three for the lexicon, two for the trees, one for the calibration.
    sixth = F.pmod(F.xxhash64("label_id", F.lit("part")), F.lit(6))
    return chosen.withColumn("part", F.when(sixth < 3, 0).when(sixth < 5, 1).otherwise(2))


def learn_lexicon(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """rows: (text, toxic) of the lexicon's part."""
    out = pa.schema([("entry", pa.string()), ("toxic", pa.int32())])

    def run(batches):
        for batch in batches:
            for text, label in zip(W.texts_of(batch["text"]), batch["toxic"].to_pylist(), strict=True):
                found = {e for w in {*text.decode("utf-8", "replace").split()} for e in entries(plain(w)[0]) if len(e) <= 40}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([label] * len(found), pa.int32())], schema=out)

    counts = rows.mapInArrow(run, "entry string, toxic int").groupBy("entry").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    expected = F.col("n") * (toxic / (toxic + clean))
    z = (F.col("t") - expected) / F.sqrt(expected)
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    best = counts.where((F.col("t") >= LEAST_DOCS) & (z >= LEAST_Z)).select("entry", weight.alias("weight"), z.alias("z"))
    return {r.entry: r.weight for r in best.where("weight > 0").orderBy(F.desc("z"), "entry").limit(LEXICON).collect()}


class Model:
    """Lexicon, trees and calibration; or only a share where labels of both kinds are lacking."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_ROWS):
        chosen = sample_labels(labels, most)
        rows = W.id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "toxic", "part")
        rows = W.stage_table(rows, "labelled")
        counts = {(r.part, r.toxic > 0): r["count"] for r in rows.withColumn("toxic", (F.col("toxic") > 0).cast("int")).groupBy("part", "toxic").count().collect()}
        total, toxic = sum(counts.values()), sum(n for (_, t), n in counts.items() if t)
        self.share = toxic / total if total else 0.0
        self.trees = self.curve = None
        rows = rows.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
        self.lexicon = learn_lexicon(rows.where("part = 0"), counts[0, True], counts.get((0, False), 0)) if counts.get((0, True)) else {}
        if not all(counts.get((p, t)) for p in (1, 2) for t in (True, False)):
            return
        fit = self.featured(rows, "text").select("features", F.col("row.toxic").cast("double").alias("label"), F.col("row.part").alias("part"))
        fit = W.stage_table(fit, "features").withColumn("features", array_to_vector("features"))
        trees = GBTClassifier(maxDepth=3, maxIter=16, stepSize=0.3, seed=5, featuresCol="features", labelCol="label", cacheNodeIds=False)
        self.trees = trees.fit(fit.where("part = 1"))
        # Trees give few different margins: one row for each, as the fit deals its rows by them.
        steps = self.margins(fit.where("part = 2")).groupBy("margin").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
        self.curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(steps)

    def featured(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(row, features): all columns of ``docs`` in one struct, so that none can clash."""
        lexicon = self.lexicon
        whole = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))

        def run(batches):
            features = Features(lexicon)
            for batch in batches:
                texts = W.texts_of(batch["text"])
                for a, b in W.steps(texts):
                    values = features.rows(texts[a:b])
                    lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(NAMES), dtype=np.int32), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays([batch["row"].slice(a, b - a), lists], names=["row", "features"])

        return whole.mapInArrow(run, T.StructType([whole.schema["row"], T.StructField("features", T.ArrayType(T.DoubleType()))]))

    def margins(self, rows: DataFrame) -> DataFrame:
        scored = self.trees.transform(rows)
        return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction", "probability", "rawPrediction")

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, score): narrow."""
        if self.trees is None:
            return docs.select(F.struct("*").alias("row"), F.lit(float(self.share)).alias("score"))
        rows = self.featured(docs, text_col).withColumn("features", array_to_vector("features"))
        self.curve.setPredictionCol("score")
        scored = self.curve.transform(self.margins(rows))
        return scored.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of the training fold."""
    docs = W.documents(spark, sf_dir).select("doc_id", "text")
    scored = Model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs)
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
