"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces, which the forward algorithm takes; a text's is the product over its words.
Words are runs of letters, lowered; the vocabulary is a public model's whole list of pieces (those with capitals, digits
or signs occur in no word). The probabilities are learned by expectation maximisation (forward and backward sums) from
word counts of a bounded sample of documents for each language.

Texts that are null or have no letters are `und` with score 0; ties go to the language first in code point order; with
no labelled rows every text is `und`; an empty table gives no rows; repeated rows are predicted alike, and each teaches.
Runs of letters over 24 are taken in parts of 24; texts may have any length. Other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semiflow.llm.common import by_length, held_out, id_fraction, small_batches, small_side

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 24
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words whose sums a worker keeps.
KEPT = 150_000


def words_of(text: str) -> list[str]:
    out = LETTERS.findall(text.lower())
    if any(len(w) > LONGEST for w in out):
        out = [w[i : i + LONGEST] for w in out for i in range(0, len(w), LONGEST)]
    return out


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of a SentencePiece model, without its control pieces and those of single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


class Pieces:
    """Finds pieces in words of one length by their rolling hashes."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        codes = np.zeros(len(pieces), np.uint64)
        for at, c in by_length(pieces, self.longest):
            codes[at] = self.ends(c)[:, -1]
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], order.astype(np.int32)
        self.none, self.other = len(pieces), len(pieces) + 1

    def ends(self, c: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings, from the empty one on."""
        h = np.zeros((len(c), c.shape[1] + 1), np.uint64)
        for j in range(c.shape[1]):
            h[:, j + 1] = h[:, j] * BASE + c[:, j].astype(np.uint64) + np.uint64(1)
        return h

    def spans(self, c: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers of the parts from i to j of words given as rows of code points; `none` where it isn't one.

        A single character that isn't a piece is `other`.
        """
        h, out, power = self.ends(c), {}, np.ones(c.shape[1] + 1, np.uint64)
        for i in range(1, len(power)):
            power[i : i + 1] = power[i - 1 : i] * BASE
        for j in range(1, c.shape[1] + 1):
            for i in range(max(0, j - self.longest), j):
                code = h[:, j] - h[:, i] * power[j - i]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                out[i, j] = np.where(self.codes[at] == code, self.ids[at], self.other if j == i + 1 else self.none)
        return out


def forward(spans: dict, n: int, length: int, p: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of all beginnings: (words, length + 1, languages)."""
    a = np.zeros((n, length + 1, p.shape[1]))
    a[:, 0] = 1
    for (i, j), ids in spans.items():
        a[:, j] += a[:, i] * p[ids]
    return a


class Model:
    def __init__(self, langs: list[str], pieces: list[str], p: np.ndarray):
        """p: a row for each piece, one of zeros for none, one for other characters; a column for each language."""
        self.langs, self.pieces, self.p = langs, pieces, p

    @classmethod
    def learn(cls, counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = 3, smooth: float = 0.5) -> Model:
        """counts: (language, word, times)."""
        langs = sorted({x[0] for x in counts})
        find = Pieces(pieces)
        times: dict[str, np.ndarray] = {}
        for lang, word, n in counts:
            times.setdefault(word, np.zeros(len(langs)))[langs.index(lang)] += n
        words = list(times)
        table = np.array([times[w] for w in words]).reshape(len(words), len(langs))
        p = np.full((len(pieces) + 2, len(langs)), 1 / (len(pieces) + 2))
        p[find.none] = 0
        groups = [(at, c, find.spans(c)) for at, c in by_length([MARK + w for w in words], LONGEST + 1)]
        for _ in range(rounds):
            seen = np.zeros_like(p)
            for at, c, spans in groups:
                n, length = c.shape
                a = forward(spans, n, length, p)
                b = np.zeros_like(a)
                b[:, length] = 1
                for i, j in reversed(sorted(spans)):
                    b[:, i] += b[:, j] * p[spans[i, j]]
                share = table[at] / np.maximum(a[:, length], 1e-300)
                for (i, j), ids in spans.items():
                    got = a[:, i] * p[ids] * b[:, j] * share
                    for k in range(len(langs)):
                        seen[:, k] += np.bincount(ids, got[:, k], len(p))
            seen += smooth
            seen[find.none] = 0
            p = seen / seen.sum(0)
        return cls(langs, pieces, p)

    def scorer(self):
        """A function of a text: (language, score)."""
        find, p = Pieces(self.pieces), self.p
        place: dict[str, int] = {}
        sums = np.zeros((1024, len(self.langs)))

        def add(new: list[str]) -> None:
            nonlocal sums
            if len(place) + len(new) > len(sums):
                sums = np.concatenate([sums, np.zeros((len(place) + len(new), len(self.langs)))])
            first = len(place)
            for at, c in by_length([MARK + w for w in new], LONGEST + 1):
                a = forward(find.spans(c), *c.shape, p)[:, -1]
                sums[first + at] = np.log(np.maximum(a, 1e-300))
            place.update(zip(new, range(first, first + len(new))))

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal sums
            each = [words_of(t) if t and self.langs else [] for t in texts]
            if len(place) > KEPT:
                place.clear()
                sums = np.zeros((1024, len(self.langs)))
            if new := list(set().union(*each) - place.keys()):
                add(new)
            out = []
            for ws in each:
                if not any(c.isalpha() for w in ws for c in w):
                    out.append(("und", 0.0))
                    continue
                x = sums[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(0)
                k = int(np.argmax(x))
                out.append((self.langs[k], float(1 / np.exp(x - x[k]).sum())))
            return out

        return score


def learn(docs: DataFrame, train: Column, path: str = VOCABULARY, per_lang: int = 250, words_per_lang: int = 50_000) -> Model:
    """Fitted on about per_lang documents of each language, chosen by a hash of their id, for which train is true.

    Of each language's words in them the words_per_lang most frequent teach. Rows without a language teach nothing.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & train)
    sizes = small_side(rows.groupBy("lang").agg(F.count("*").alias("rows_of_lang")))
    chosen = rows.join(sizes, "lang").filter(id_fraction(F.col("doc_id")) < per_lang / F.col("rows_of_lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for x in batches:
            for lang, t in zip(x.lang, x.text):
                c.update((lang, w) for w in words_of(t or ""))
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["lang", "word", "n"])

    got = small_batches(chosen).select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = got.withColumn("place", place).filter(F.col("place") <= words_per_lang).orderBy("lang", "place").select("lang", "word", "n").collect()
    return Model.learn([tuple(r) for r in top], vocabulary(path))


def predictor(model: Model):
    """A column function of a text: struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for x in texts:
            got = [y for lo in range(0, len(x), 500) for y in score(list(x.iloc[lo : lo + 500]))]
            yield pd.DataFrame(got, columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score. Rows that are held out teach nothing."""
    out = held_out(F.col("doc_id"))
    model = learn(docs, ~out, path)
    return small_batches(docs).select("doc_id", out.alias("held_out"), predictor(model)(F.col("text")).alias("x")).select("doc_id", "held_out", "x.lang_pred", "x.score")
