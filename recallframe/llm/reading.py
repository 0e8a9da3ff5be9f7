"""Problem 9: reading level from words' acquisition grades.

*Grades.* For each word, its rates in the rated texts of each level (rater_a) give
a distribution over levels; its acquisition grade is the level by which half of
it lies, interpolated.  Words whose distribution is flat say little and get little
weight.  Rates count all rated texts, by distributed aggregation.
*Calibration.* A document's weighted quantiles of its known words' grades, over
words and over its sentences' means, go through a softmax regression, trained on the rated texts; for those, their own
counts are taken out of the grades first.

Upper case, list marks, headings, line breaks and missing full stops play no part;
fenced code is left out.  Null or short texts, logs and texts in other languages
give no row.  A text counts as written in one of the languages if most letters are Latin
and ``SPOKEN`` of its words are function words of that language, more than of any other
language listed, or if ``KNOWN`` of its words are known from the rated texts.  Without
any known word it gets the level of average features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.llm.words import normal
from recallframe.session import cut, spread

LEVELS, LEAST_RUNS, KNOWN, LEAST_DOCS = 4, 40, 0.25, 2
MOST_RATED, FLAT = 20_000, 0.05
WORD_SHARE = 1 / 10_000  # of the rated texts; words below tell no grade, and the table is bounded by the share
QUANTILES = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)
#: Function words; those of other languages with Latin letters only tell the four from them.
LANGUAGES, SPOKEN = ("en", "de", "fr", "es"), 0.08
FUNCTION = {lang: frozenset(own.split()) for lang, own in {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were their been has will would who when there what so if no out up into than them can only other its then these may any such because although while however whether",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich wir ihr innerhalb unter sowie beziehungsweise gegen zwischen ohne jedoch weil während sondern doch wohingegen",
    "fr": "le la les de des du et un une en à est que qui dans pour par sur au aux avec ne pas se ce il elle plus sont ou son sa ses cette ces mais comme nous vous leur été être ont dont où lui sans entre si tout d l qu n s c j je",
    "es": "el la los las de del y un una en a es que por para con no se su sus al lo como más pero o ha son este esta sin sobre también entre cuando muy hasta desde hay donde porque le les ya fue ser mientras si me mi yo",
    "pt": "o a os as de do da dos das e um uma em no na nos nas é que por para com não se seu sua ao à como mais mas ou são este esta sem sobre também entre quando muito até desde há onde porque pelo pela foi ser eu",
    "it": "il lo la i gli le di del della dei delle e un una in nel nella è che per con non si su al alla come più ma o sono questo questa senza tra anche quando molto fino da dal dalla dove perché suo sua ha ed io",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft ze hij door over ze wordt worden werd deze dit tot je ik wij geen zich",
    "ca": "el la els les de del dels i un una en a és que per amb no es seu seva al als com més però o són aquest aquesta sense sobre també entre quan molt fins des hi on perquè ha",
    "sv": "och i att det som en på är av för med den till inte har de ett om var han men sig så från vi kan hon när eller under också efter jag",
    "da": "og i at det som en på er af for med den til ikke har de et om var han men sig så fra vi kan hun når eller under også efter jeg",
    "pl": "i w na z do nie się że o jest to jak po ale za od przez co tak czy dla są już tylko przed który która oraz",
    "ro": "și în de la a cu pe nu că este un o din care pentru mai sau dar ca să au fost prin sunt după al ale",
    "la": "et in est non ad ut cum sed qui quae quod ex per ab si aut esse sunt atque enim de ac",
    "tr": "ve bir bu için ile da de çok ne gibi daha o ama olarak olan kadar sonra en var ki mi",
    "fi": "ja on ei se että hän oli mutta ovat joka niin kun kuin myös tai sen ole",
    "hu": "a az és hogy nem is egy ez meg csak de van mint már még volt ha vagy el",
}.items()}
OF_LANGUAGES = {w: tuple(lang for lang, own in FUNCTION.items() if w in own) for w in frozenset().union(*FUNCTION.values())}
RUN = regex.compile(r"\p{L}+")
OTHER, LETTER = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1), regex.compile(r"\p{L}")
FENCE = regex.compile(r"```.*?(?:```|\Z)", regex.S)
LOG_LINE = regex.compile(r"(?m)^\s*\d{4}-\d\d-\d\dT\S+ .*$")


SENTENCE = re.compile(r"[.!?…]+\s|\n+|;\s")
ASCII_RUN = re.compile(r"[a-z]+")
WIDTH = len(QUANTILES) + 5 + 8


def sentences(text: str) -> list[list[str]]:
    """Letter runs by sentence or line, outside of fenced code and log lines."""
    text = FENCE.sub(" ", text) if "```" in text else text
    text = LOG_LINE.sub(" ", text) if text[:1].isdigit() or "\n2" in text or "\n1" in text or "\n " in text or text[:1].isspace() else text
    return [own for part in SENTENCE.split(normal(text)) if (own := (ASCII_RUN if part.isascii() else RUN).findall(part))]


def runs(text: str) -> list[str]:
    return [w for own in sentences(text) for w in own]


def spoken(words: list[str]) -> bool:
    """Whether function words tell one of the four languages."""
    shares = dict.fromkeys(FUNCTION, 0)
    for w in words:
        for lang in OF_LANGUAGES.get(w, ()):
            shares[lang] += 1
    ours = max(shares[lang] for lang in LANGUAGES)
    return ours >= SPOKEN * max(1, len(words)) and ours > max(n for lang, n in shares.items() if lang not in LANGUAGES)


_AT = np.array((0.1, 0.25, 0.5, 0.75, 0.9))


def _quantiles(ordered: np.ndarray) -> np.ndarray:
    at = _AT * (len(ordered) - 1)
    low = at.astype(int)
    high = np.minimum(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


class Grades:
    """Words' counts by level, and from them their acquisition grades and how much they say."""

    def __init__(self, counts: dict[str, tuple], totals: np.ndarray):
        self.index = {w: i for i, w in enumerate(counts)}
        self.counts = np.array(list(counts.values()), dtype=float).reshape(-1, LEVELS)
        self.totals = np.maximum(np.array(totals, dtype=float), 1.0)
        self.p, self.grade, self.says = self._graded(self.counts, self.totals)

    @staticmethod
    def _graded(counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distribution over levels, the level by which half of it lies, and its distance from a flat one."""
        rate = (np.maximum(counts, 0) + 0.05) / (totals / totals.mean() + 1e-9)
        p = rate / rate.sum(axis=1, keepdims=True)
        upto = np.cumsum(p, axis=1)
        at = np.minimum((upto < 0.5).sum(axis=1), LEVELS - 1)
        own = np.take_along_axis(p, at[:, None], 1)[:, 0]
        before = np.take_along_axis(upto, at[:, None], 1)[:, 0] - own
        says = np.maximum((p * np.log(p * LEVELS + 1e-12)).sum(axis=1) - FLAT, 1e-4)
        return p, at + (0.5 - before) / own + 0.5, says * (counts.sum(axis=1) > 0)

    def features(self, parts: list[list[str]], level: int | None = None) -> tuple[np.ndarray, float]:
        """Quantiles over words and over sentences, and the share of known words; ``level``: the text's own, to be taken out."""
        none = np.full(WIDTH, np.nan), 0.0
        get = self.index.get
        size = np.array([len(own) for own in parts], dtype=np.int64)
        token = np.array([get(w, -1) for own in parts for w in own], dtype=np.int64)
        where = np.repeat(np.arange(len(parts)), size)[token >= 0]
        token = token[token >= 0]
        if not len(token):
            return none
        word, back, c = np.unique(token, return_inverse=True, return_counts=True)
        if level is None:
            p, grade, says = self.p[word], self.grade[word], self.says[word]
        else:
            counts, totals = self.counts[word].copy(), self.totals.copy()
            counts[:, level - 1] -= c
            totals[level - 1] = max(1.0, totals[level - 1] - size.sum())
            p, grade, says = self._graded(counts, totals)
        weight = c * says
        total = weight.sum()
        if total <= 0:
            return none
        order = np.argsort(grade)
        q = np.interp(QUANTILES, np.cumsum(weight[order]) / total, grade[order])
        mean = (weight * grade).sum() / total
        heavy = np.bincount(where, says[back], len(parts))
        light = np.bincount(where, says[back] * grade[back], len(parts))
        good = (heavy > 0) & (size >= 3)
        if good.any():
            v, length = light[good] / heavy[good], size[good]
            of_sentences = [v.mean(), *_quantiles(np.sort(v)), (v * length).sum() / length.sum(), np.log(length.mean())]
        else:
            of_sentences = [mean] * 7 + [0.0]
        return np.array([*q, mean, *((weight[:, None] * p).sum(axis=0) / total), *of_sentences]), len(token) / size.sum()


def _rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("rater") == "rater_a") & F.col("level").between(1, LEVELS)).groupBy("doc_id").agg(F.min("level").cast("int").alias("rated"))
    return docs.select("doc_id", "text").join(good, "doc_id").where(F.col("text").isNotNull())


def fit(docs: DataFrame, labels: DataFrame):
    """Grades and the calibration's weights."""
    rated = cut(_rated(docs, labels))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, lv, c) for text, lv in zip(pdf["text"], pdf["rated"]) for w, c in Counter(runs(text)).items()]
            yield pd.DataFrame(rows, columns=["word", "level", "c"])

    each = spread(rated).mapInPandas(count, "word string, level int, c long")
    by_level = cut(each.groupBy("word").agg(*(F.sum(F.when(F.col("level") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(1, LEVELS + 1)), F.count("*").alias("docs")))
    totals = by_level.agg(*(F.sum(f"c{k}") for k in range(1, LEVELS + 1))).first()
    many = rated.count()
    least = max(LEAST_DOCS, int(many * WORD_SHARE))
    counts = {r["word"]: tuple(r[f"c{k}"] for k in range(1, LEVELS + 1)) for r in by_level.where(F.col("docs") >= least).collect()}
    grades = Grades(counts, [t or 0 for t in totals])

    take = rated if many <= MOST_RATED else rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-many // MOST_RATED))) == 0)
    shared = docs.sparkSession.sparkContext.broadcast(grades)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [shared.value.features(sentences(t), lv)[0] for t, lv in zip(pdf["text"], pdf["rated"])]
            yield pd.DataFrame({"level": pdf["rated"], "f": f})

    sample = spread(take).mapInPandas(describe, "level int, f array<double>").orderBy("level").toPandas()
    x = np.array(sample["f"].tolist(), dtype=float).reshape(-1, WIDTH)
    y = sample["level"].to_numpy(dtype=int) - 1
    good = np.isfinite(x).all(axis=1)
    return shared, Softmax().train(x[good], y[good])


class Softmax:
    """Regularised softmax regression on standardised features and their squares."""

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.sd
        return np.hstack([z, z * z, np.ones((len(z), 1))])

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 1000) -> Softmax:
        self.mean, self.sd = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        width = x.shape[1] * 2 + 1
        penalty = 2e-4 + 0.5 / max(1, len(x))
        self.w = np.zeros((width, LEVELS))
        if not len(x):
            return self
        d, t = self._design(x), np.eye(LEVELS)[y]
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for i in range(1, steps + 1):
            z = d @ self.w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = d.T @ (p - t) / len(x) + penalty * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return self

    def levels(self, x: np.ndarray) -> np.ndarray:
        return (self._design(x) @ self.w).argmax(axis=1) + 1


def levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, level`` of the documents in running prose."""
    grades, model = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, f = [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if len(RUN.findall(text)) < LEAST_RUNS:
                    continue
                if not text.isascii() and 2 * len(OTHER.findall(text)) > len(LETTER.findall(text)):
                    continue
                parts = sentences(text)
                x, known = grades.value.features(parts)
                if model.value.w.any() and (known >= KNOWN or spoken([w for own in parts for w in own])):
                    ids.append(doc)
                    f.append(x if np.isfinite(x).all() else model.value.mean)
            yield pd.DataFrame({"doc_id": ids, "level": model.value.levels(np.array(f)) if ids else []}).astype({"doc_id": "int64", "level": "int64"})

    prose = docs.where(F.col("text").isNotNull() & ((F.col("doc_type") != "log") | F.col("doc_type").isNull())).select("doc_id", "text")
    return spread(prose).mapInPandas(predict, "doc_id long, level long")
