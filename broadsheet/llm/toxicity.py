"""Toxicity: a learned weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import materialize

# Bound of the labelled rows that the model is fitted on, and of what is learned from them.
MOST_ROWS = 20_000
MOST_ENTRIES = 5_000
LEAST_DOCS = 5
LEAST_WEIGHT = 2.0
PREFIXES = range(4, 11)

# Characters that are read as another letter, and the digits and signs that
# stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Folding(dict):
    """Code point to folded text, made as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = char.lower()
        if low in HOMOGLYPHS or low in SIGNS:
            out = HOMOGLYPHS.get(low) or SIGNS[low]
        elif unicodedata.combining(char) or unicodedata.category(char) == "Cf":
            out = ""  # accents and zero-width characters vanish
        else:
            parts = unicodedata.normalize("NFKD", char).lower()
            out = "".join(
                HOMOGLYPHS.get(c, c) if c.isalnum() else "" if unicodedata.combining(c) else " "
                for c in parts
            )
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Words in lower case without accents, look-alikes and digits read as letters, between
    single blanks."""
    return f" {' '.join((text or '').translate(_FOLDING).split())} "


@dataclass
class Model:
    """Starts of words with weights, phrases in which they don't count, and the score's
    coefficients (constant, weight, weight per length)."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-5.0, 0.0, 0.0)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.machine = model, None
        if model.lexicon:
            machine = ahocorasick.Automaton()
            for start, weight in model.lexicon.items():
                machine.add_word(f" {start}", (len(start) + 1, weight))
            for phrase in model.exceptions:
                machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
            machine.make_automaton()
            self.machine = machine

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of what the lexicon finds outside the exception phrases."""
        if self.machine is None:
            return []
        found, free = {}, []
        for end, (length, weight) in self.machine.iter(folded):
            at = end - length + 1
            if weight is None:
                free.append((at, end))
            else:
                found[at] = max(weight, found.get(at, 0.0))
        return [(at, w) for at, w in found.items() if not any(a <= at < e for a, e in free)]

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        weight = sum(w for _, w in self.hits(folded))
        return math.log1p(weight), math.log1p(100 * weight / (folded.count(" ") + 20))

    def score(self, text: str | None) -> float:
        const, whole, dense = self.model.coefficients
        a, b = self.features(text)
        return 1 / (1 + math.exp(-(const + whole * a + dense * b)))


def _counts(rows: DataFrame, terms: Callable[[str], set[str]]) -> DataFrame:
    """(term, pos, neg): documents of each label with the term; counted in tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                (pos if toxic else neg).update(terms(fold(text)))
        every = list(pos.keys() | neg.keys())
        if every:
            yield pd.DataFrame({"term": pd.Series(every, dtype=object),
                                "pos": [pos[t] for t in every], "neg": [neg[t] for t in every]})

    return (
        rows.mapInPandas(count, "term string, pos long, neg long")
        .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def _starts(folded: str) -> set[str]:
    return {w[:n] for w in set(folded.split()) for n in PREFIXES if len(w) >= n}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta
        )
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit the model on ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text).

    At most about ``most_rows`` labelled rows are used, picked by a hash of the id; rows with
    a null label are none. An entry is the start of a word that at least five toxic documents
    hold and whose log odds for toxic documents are at least 2; the exceptions are words and
    word pairs that hold an entry and yet are no more frequent in toxic documents. Without
    toxic rows the lexicon is empty and all scores are the same low value.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    share = most_rows / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # written once: the bounded sample is read for each count below
    # (copies of one text teach once)
    rows = materialize(
        docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic").distinct(),
        "toxic-sample",
    )
    total = rows.agg(F.sum("toxic").alias("pos"), F.count("toxic").alias("n")).first()
    pos, neg = total.pos or 0, total.n - (total.pos or 0)
    if not pos:
        return Model()
    weight = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    found = {
        r.term: (r.pos, r.weight) for r in
        _counts(rows, _starts).where(F.col("pos") >= LEAST_DOCS).withColumn("weight", weight)
        .where(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), F.desc("pos"), "term")
        .limit(4 * MOST_ENTRIES).collect()
    }
    # Of nested entries the shortest stays, unless a longer one has nearly all its documents.
    kept: dict[str, float] = {}
    longer: dict[str, int] = {}
    for term, (docs_with, _) in found.items():
        longer[term[:-1]] = max(docs_with, longer.get(term[:-1], 0))
    for term in sorted(found, key=lambda t: (len(t), t)):
        if any(term[:n] in kept for n in PREFIXES if n < len(term)):
            continue
        if longer.get(term, 0) >= 0.9 * found[term][0]:
            continue
        kept[term] = found[term][1]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:MOST_ENTRIES])
    scorer = Scorer(Model(kept))

    def contexts(folded: str) -> set[str]:
        out = set()
        for at, _ in scorer.hits(folded):
            end = folded.index(" ", at + 1)
            word = folded[at + 1:end]
            out.add(word)
            before = folded[folded.rfind(" ", 0, at) + 1:at] if at > 0 else ""
            if before:
                out.add(f"{before} {word}")
        return out

    exceptions = [
        r.term for r in _counts(rows, contexts)
        .where((F.col("neg") >= LEAST_DOCS) & (F.col("neg") * pos >= F.col("pos") * neg))
        .orderBy(F.desc("neg"), "term").limit(MOST_ENTRIES).collect()
    ]
    model = Model(kept, exceptions)
    measured = Scorer(model)

    @F.pandas_udf("whole double, dense double")
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured.features(t) for t in texts], columns=["whole", "dense"])

    # two numbers for each row of the bounded sample
    sample = rows.select(features("text").alias("f"), "toxic").select("f.*", "toxic").toPandas()
    model.coefficients = _fit(
        sample[["whole", "dense"]].to_numpy(), sample["toxic"].to_numpy(dtype=float)
    )
    return model


def toxicity(text: Column, model: Model) -> Column:
    """Score in 0 to 1 of each whole text; a null or empty text has the score of no hit."""
    scorer = Scorer(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(scorer.score)

    return score(text)
