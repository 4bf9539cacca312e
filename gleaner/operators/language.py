"""Language identification by token statistics learned from labelled text."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.probability import argmax, softmax
from ..runtime import BROADCAST_BYTES, broadcast_if_small, computed, materialise
from .lookup import lookup_sums, split_weights


@dataclass(frozen=True)
class LanguageModel:
    """``tokens``: key, n and c0..ck, the count of the token per language."""

    languages: list[str]
    sizes: list[int]
    tokens: DataFrame
    vocabulary: int

    def save(self, path: str) -> None:
        spark = self.tokens.sparkSession
        self.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
        spark.createDataFrame([(l,) for l in self.languages], "lang STRING").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/languages")


def _model(tokens: DataFrame, languages: list[str]) -> LanguageModel:
    sums = tokens.agg(
        F.count("*").alias("v"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(languages))]
    ).first()
    return LanguageModel(languages, [sums[f"c{i}"] for i in range(len(languages))], tokens, sums["v"])


def load_language_model(spark: SparkSession, path: str) -> LanguageModel:
    languages = sorted(r["lang"] for r in spark.read.parquet(f"{path}/languages").collect())
    return _model(spark.read.parquet(f"{path}/tokens"), languages)


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count tokens per language: one shuffle of (token, counts), combined
    map-side so that frequent tokens collapse before it."""
    known = labelled.where(F.col(lang).isNotNull())
    languages = sorted(r[0] for r in known.select(lang).distinct().collect())  # the model's columns
    tokens = known.select(F.col(lang).alias("_lang"), F.explode(txt.words(F.col(text))).alias("key"))
    counts = tokens.groupBy("key").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("_lang") == l).alias(f"c{i}") for i, l in enumerate(languages)]
    )
    return _model(materialise(counts, "language-tokens"), languages)


def language_probabilities(
    docs: DataFrame, model: LanguageModel, row_id: str = "doc_id", text: str = "text", budget: int = BROADCAST_BYTES
) -> DataFrame:
    """``row_id`` and ``probabilities`` in the order of ``model.languages``.

    The score of a language is the mean log-probability of the tokens with
    add-one smoothing. A token never seen in a language adds ln(1) before the
    common denominator is taken off, so only seen tokens are looked up. Rows
    without tokens are absent.
    """
    k = len(model.languages)
    weights = model.tokens.select("key", "n", *[F.ln(F.col(f"c{i}") + 1.0).alias(f"w{i}") for i in range(k)])
    occurrences = docs.select(row_id, F.explode(txt.words(F.col(text))).alias("key"))
    sums = lookup_sums(occurrences, row_id, weights, budget)
    scores = F.array(
        *[F.col(f"w{i}") / F.col("n") - math.log(model.sizes[i] + model.vocabulary) for i in range(k)]
    )
    return sums.select(row_id, softmax(scores).alias("probabilities"))


def language_scores(docs: DataFrame, model: LanguageModel, row_id: str = "doc_id", **kw) -> DataFrame:
    """Long form: ``row_id``, lang, p for every language of the model."""
    names = F.lit(model.languages)
    zipped = F.zip_with(names, "probabilities", lambda l, p: F.struct(l.alias("lang"), p.alias("p")))
    return language_probabilities(docs, model, row_id, **kw).select(row_id, F.inline(zipped))


def top_language(docs: DataFrame, model: LanguageModel, row_id: str = "doc_id", **kw) -> DataFrame:
    """Best language and its probability; ties go to the first name."""
    scored = language_probabilities(docs, model, row_id, **kw)
    best = F.get(F.lit(model.languages), argmax(F.col("probabilities")))
    return scored.select(row_id, best.alias("lang"), F.array_max("probabilities").alias("p"))


HEAD_BYTES = 32 << 20  # of frequent tokens that every task holds


class _Verdict:
    """What the frequent tokens of a text tell about its language.

    A token that is not among them was seen less than ``below`` times, so that each
    adds between 0 and ln(``below``) to the sum of any language: bounds that mostly
    leave one answer.
    """

    def __init__(self, table: pa.Table, model: LanguageModel, language: str, above: float | None, below: int):
        columns = [np.asarray(table.column(f"w{i}")) for i in range(len(model.languages))]
        self._place = {key: i for i, key in enumerate(table.column("key").to_pylist())}
        self._weights = np.concatenate([np.stack(columns, 1).reshape(-1, len(columns)), np.zeros((1, len(columns)))])
        self._base = np.array([math.log(size + model.vocabulary) for size in model.sizes])
        self._mine = model.languages.index(language) if language in model.languages else -1
        self._above, self._most = above, math.log(below)

    def sums(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row the number of tokens, the sums of the known ones and, by token,
        the row of each unknown one (-1: known)."""
        flat = lists.flatten().dictionary_encode()
        unknown = len(self._weights) - 1
        place = np.array([self._place.get(w, unknown) for w in flat.dictionary.to_pylist()], np.int64)
        at = place[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64)
        size = np.where(np.asarray(lists.is_valid()), np.diff(np.asarray(lists.offsets)), 0)
        row = np.repeat(np.arange(len(lists)), size)
        sums = [np.bincount(row, self._weights[at, k], len(lists)) for k in range(len(self._base))]
        return size, np.stack(sums, 1), np.where(at == unknown, row, -1)

    def verdicts(self, size: np.ndarray, sums: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """1: of the language, 0: not, -1: the unknown tokens decide."""
        if self._mine < 0:
            return np.zeros(len(size), np.int32)
        n = np.maximum(size, 1)[:, None]
        low = sums / n - self._base
        high = low + (np.bincount(unknown[unknown >= 0], minlength=len(size)) * self._most)[:, None] / n
        mine, others = self._mine, [k for k in range(len(self._base)) if k != self._mine]
        before = np.array([k < mine for k in others], bool)
        least, most = low[:, mine, None] - high[:, others], high[:, mine, None] - low[:, others]  # leads over the others
        sure = (np.where(before, least > 0, least >= 0)).all(1)
        lost = (np.where(before, most <= 0, most < 0)).any(1)
        if self._above is not None:
            sure &= 1 / (1 + np.exp(-least).sum(1)) > self._above
            lost |= 1 / (1 + np.exp(-most).sum(1)) <= self._above
        return np.where(size == 0, 0, np.where(sure, 1, np.where(lost, 0, -1))).astype(np.int32)


def keep_language(
    docs: DataFrame,
    model: LanguageModel,
    language: str = "en",
    above: float | None = 0.6,
    row_id: str = "doc_id",
    text: str = "text",
    budget: int = HEAD_BYTES,
) -> DataFrame:
    """Rows whose best language is ``language``, strictly ``above`` that
    probability (``None``: whatever the probability).

    The verdict is found where the text lies: tasks hold the most frequent tokens,
    as many as ``budget`` bytes take (they pass the driver once). Rows that the rarer
    ones decide, known by bounds, send their tokens to them and come back as ids; no
    other row moves, and none twice. ``row_id`` must name rows whose texts are equal.
    """
    k = len(model.languages)
    weights = model.tokens.select("key", "n", *[F.ln(F.col(f"c{i}") + 1.0).alias(f"w{i}") for i in range(k)])
    split = split_weights(weights, budget)
    judge = _Verdict(split.head.toArrow(), model, language, above, split.below)
    words = txt.words(F.col(text))

    @F.arrow_udf("int")
    def verdict(lists: pa.Array) -> pa.Array:
        return pa.array(judge.verdicts(*judge.sums(lists)), pa.int32())

    if split.tail is None:
        return docs.where(verdict(words) == 1)

    @F.arrow_udf(f"struct<verdict: int, n: long, {', '.join(f'w{i}: double' for i in range(k))}, rest: array<string>>")
    def partial(lists: pa.Array) -> pa.Array:
        size, sums, unknown = judge.sums(lists)
        found = judge.verdicts(size, sums, unknown)
        open_row = np.append(found == -1, False)
        kept = np.flatnonzero(open_row[unknown])
        offsets = np.searchsorted(unknown[kept], np.arange(len(lists) + 1))
        rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.flatten().take(pa.array(kept)))
        names = ["verdict", "n", *[f"w{i}" for i in range(k)], "rest"]
        return pa.StructArray.from_arrays([pa.array(found), pa.array(size.astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in sums.T), rest], names)

    undecided = materialise(docs.select(row_id, partial(words).alias("p")).where("p.verdict = -1").select(row_id, "p.*").dropDuplicates([row_id]), "language-undecided")
    rare = lookup_sums(undecided.select(row_id, F.explode("rest").alias("key")), row_id, weights, 0)
    added = [F.coalesce(F.col(f"r{i}"), F.lit(0.0)) for i in range(k)]
    both = undecided.join(rare.select(F.col(row_id).alias("_r"), *[F.col(f"w{i}").alias(f"r{i}") for i in range(k)]), F.col(row_id) == F.col("_r"), "left")
    scores = F.array(*[(F.col(f"w{i}") + added[i]) / F.col("n") - math.log(model.sizes[i] + model.vocabulary) for i in range(k)])
    top = both.select(row_id, softmax(scores).alias("q"))
    top = top.where(F.get(F.lit(model.languages), argmax(F.col("q"))) == language)
    if above is not None:
        top = top.where(F.array_max("q") > above)
    chosen = broadcast_if_small(materialise(top.select(row_id), "language-rows"))
    judged = computed(docs, "_verdict", verdict(words))
    decided = judged.where("_verdict = 1").drop("_verdict")
    return decided.unionByName(judged.where("_verdict = -1").drop("_verdict").join(chosen, row_id, "left_semi"))
