"""Toxicity by a learned lexicon, met through Levenshtein automata, and the words around each hit.

Terms are whole words and word beginnings that labelled toxic texts have far more often than others. They stand in a
trie; the Levenshtein automaton of all whole words at once is that trie with a count of edits, made deterministic step by
step as tokens run through it, so a token is read once whatever the size of the lexicon. Around each hit a window of words
tells quotation (quotation marks around it, words of reporting) from abuse. Both kinds of evidence are summed per text,
and a logistic fit turns the sums into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from statelake.llm.fitting import Logistic, labelled_sample

#: Bounds of the sample by label (texts for the lexicon, for the fit), and of the lexicon.
LEXICON_TEXTS, FIT_TEXTS = {0: 4000, 1: 3000}, {0: 3000, 1: 2000}
LEXICON_TERMS, LEAST_ODDS, BEGINNINGS = 1000, 1.2, range(4, 10)
#: Edits allowed in a whole word by its length: below the first bound none, from the second two.
ONE_EDIT, TWO_EDITS = 5, 9
WINDOW, REMEMBERED = 6, 200_000

TOKEN = re.compile(r"[^\W_](?:[^\W_]|[*@$!](?=[^\W_]))*")
#: Words that report or mention speech, and quotation marks that open and close.
REPORTING = frozenset(
    "said says say quote quoted quotes quoting word words term called wrote writes example mention mentioned citation "
    "dit mot cité appelé sagte wort zitat genannt dijo palabra cita llamado".split()
)
OPENING, CLOSING = "\"“„«'‘", "\"”“»'’"
FEATURES = 8


class Lexicon:
    """A trie of terms with a Levenshtein automaton over it; `match` gives the best term of a token."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.child: list[dict[str, int]] = [{}]
        self.word_at: list[float] = [0.0]
        self.begin_at: list[float] = [0.0]
        self.edits_at: list[int] = [0]
        self.own: dict[int, int] = {}
        for term, weight in words.items():
            allowed = (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)
            for node in self._path(term):
                self.edits_at[node] = max(self.edits_at[node], allowed)
            self.word_at[node] = weight
            self.own[node] = allowed
        for term, weight in beginnings.items():
            *_, node = self._path(term)
            self.begin_at[node] = weight
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.results: list[tuple[float, int]] = []
        self.begun: list[float] = []
        self.start = self._state(self._closed({(0, 0)}))
        self.known: dict[str, tuple[float, int] | None] = {}

    def _path(self, term: str) -> Iterator[int]:
        node = 0
        yield node
        for c in term:
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                for column, empty in ((self.child, {}), (self.word_at, 0.0), (self.begin_at, 0.0), (self.edits_at, 0)):
                    column.append(empty)
            node = self.child[node][c]
            yield node

    def _closed(self, places: set[tuple[int, int]]) -> frozenset:
        """With characters of the term left out by the token; of a node only the least edits count."""
        best: dict[int, int] = {}
        todo = sorted(places, key=lambda p: p[1])
        while todo:
            node, edits = todo.pop(0)
            if best.get(node, 9) <= edits:
                continue
            best[node] = edits
            todo += [(n, edits + 1) for n in self.child[node].values() if edits < self.edits_at[n]]
        return frozenset(best.items())

    def _state(self, places: frozenset) -> int:
        if places not in self.states:
            self.states[places] = len(self.members)
            self.members.append(places)
            self.moves.append({})
            ends = [(self.word_at[n] / (1 + e), e) for n, e in places if self.word_at[n] and e <= self.own[n]]
            self.results.append(max(ends, key=lambda x: (-x[1], x[0]), default=(0.0, 0)))
            self.begun.append(max((self.begin_at[n] for n, e in places if e == 0), default=0.0))
        return self.states[places]

    def _move(self, state: int, c: str) -> int:
        places = set()
        for node, edits in self.members[state]:
            if c in self.child[node]:
                places.add((self.child[node][c], edits))
            if edits < self.edits_at[node]:
                places.add((node, edits + 1))  # a character too many
            places |= {(n, edits + 1) for n in self.child[node].values() if edits < self.edits_at[n]}
        self.moves[state][c] = out = self._state(self._closed(places))
        return out

    def match(self, token: str) -> tuple[float, int] | None:
        """Weight and kind of the best term: 0 whole word, 1 misspelled word, 2 beginning. None without a term."""
        if token in self.known:
            return self.known[token]
        state, begun = self.start, 0.0
        for c in token:
            state = self.moves[state][c] if c in self.moves[state] else self._move(state, c)
            begun = max(begun, self.begun[state])
            if not self.members[state] and not begun:
                break
        weight, edits = self.results[state]
        found = (weight, 0) if weight and not edits else (begun, 2) if begun else (weight, 1) if weight else None
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[token] = found
        return found

    def __reduce__(self):
        return Lexicon, (self.words, self.beginnings)


def quoted(text: str, tokens: list[re.Match], k: int) -> bool:
    """Whether token `k` stands in quotation marks, or a word of reporting stands in the window before it."""
    low, high = tokens[max(0, k - WINDOW)].start(), tokens[min(len(tokens) - 1, k + WINDOW)].end()
    before, after = text[low:tokens[k].start()], text[tokens[k].end():high]
    opened = any(before.count(o) % 2 if o == c else before.rfind(o) > before.rfind(c) for o, c in zip(OPENING[:4], CLOSING))
    closed = any(c in after for c in CLOSING[:4])
    tight = before[-1:] in OPENING and after[:1] in CLOSING if before and after else False
    told = any(tokens[i].group() in REPORTING for i in range(max(0, k - WINDOW), k))
    return tight or opened and closed or told


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Sums of a text: evidence of whole, misspelled and begun words as abuse, the same in quotation, and its length."""
    low = text.lower()
    names = TOKEN.findall(low)
    hits = {t: m for t in set(names) if (m := lexicon.match(t)) is not None}
    sums, counts, different, cited = [0.0] * 3, [0] * 3, 0.0, 0.0
    if hits:
        tokens = list(TOKEN.finditer(low))
        seen = set()
        for k, token in enumerate(names):
            if token in hits:
                weight, kind = hits[token]
                if quoted(low, tokens, k):
                    cited += weight
                else:
                    sums[kind] += weight
                    counts[kind] += 1
                    if token not in seen:
                        seen.add(token)
                        different += weight
    words = len(names) + 10
    return [
        *(np.log1p(s) for s in sums), np.log1p(different), np.log1p(cited), np.log1p(1000 * sum(sums) / words),
        np.log1p(counts[0] + counts[2]), np.log(words),
    ]


def terms(text: str) -> set[str]:
    """Words (ended by a space) and beginnings of words of a text."""
    out = set()
    for w in set(TOKEN.findall(text.lower())):
        out.add(w + " ")
        out.update(w[:k] for k in BEGINNINGS if k < len(w))
    return out


def learn_lexicon(sample: DataFrame, texts: dict[int, int]) -> Lexicon:
    """Terms that toxic texts have `exp(LEAST_ODDS)` times as often or more; counted in tasks, summed by Spark.

    Of a beginning and a longer term that occur in equally many texts of either kind only the longer one is taken.
    """
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = {0: Counter(), 1: Counter()}
            for label, text in zip(part["label"], part["text"]):
                found[label].update(terms(text))
            keys = list(found[0].keys() | found[1].keys())
            yield pd.DataFrame({"term": keys, "toxic": [found[1][k] for k in keys], "clean": [found[0][k] for k in keys]})

    toxic, clean = max(1, texts.get(1, 0)), max(1, texts.get(0, 0))
    least = max(3, round(0.004 * toxic))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = sample.select("label", "text").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).filter(F.col("toxic") >= least).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(
        (F.col("odds") * F.sqrt("toxic")).desc(), "term"
    ).limit(LEXICON_TERMS).collect()
    # a beginning that stands in the same texts as a longer term says less than that one
    same = {
        (r["term"][:k], r["toxic"], r["clean"]) for r in found for k in range(BEGINNINGS.start, len(r["term"].rstrip()) + 1)
        if k < len(r["term"])
    }
    found = [r for r in found if (r["term"], r["toxic"], r["clean"]) not in same]
    words = {r["term"][:-1]: r["odds"] for r in found if r["term"].endswith(" ")}
    begins = {r["term"]: r["odds"] for r in found if not r["term"].endswith(" ")}
    return Lexicon(words, begins)


class ToxicityModel:
    """Lexicon and fit; `score` is a column expression."""

    def __init__(self, lexicon: Lexicon, fit: Logistic):
        self.lexicon, self.fit = lexicon, fit

    def score(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.array([features(t, model.lexicon) for t in part], float).reshape(len(part), FEATURES)
                yield pd.Series(model.fit(x))

        return scored(F.coalesce(text.cast("string"), F.lit("")))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from the rows of `labels` (id, toxic) for which `usable` holds; whole texts, empty ones included.

    Without labelled rows the lexicon is empty and the score 0.5; with one label only it is near that label.
    """
    sample, counts = labelled_sample(
        docs, labels, "toxic", usable, {"lexicon": LEXICON_TEXTS, "fit": FIT_TEXTS}, id_col, text_col
    )
    sample = sample.persist()
    try:
        had = {(r["role"], r["label"]): r["n"] for r in sample.groupBy("role", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        lexicon = learn_lexicon(
            sample.filter("role = 'lexicon'"), {v: had.get(("lexicon", v), 0) for v in (0, 1)}
        )

        @F.pandas_udf("array<double>")
        def measured(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([features(t, lexicon) for t in part])

        rows = sample.filter("role = 'fit'").select("label", measured("text").alias("x")).collect()
    finally:
        sample.unpersist()
    y = np.array([r["label"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), FEATURES)
    weight = np.ones(len(y))
    for value in (0, 1):
        mine = y == value
        if mine.any():
            weight[mine] = counts[value] / mine.sum()
    return ToxicityModel(lexicon, Logistic(x, y, weight * len(y) / max(1e-9, weight.sum()), ridge=0.1))
