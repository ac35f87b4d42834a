"""Abusive, hateful or sexual content: a convolutional classifier of sentences, trained in numpy.

A word's vector is the mean of hashed embeddings of the word and all its letter trigrams. Filters of several widths run
over a sentence and the maximum over positions feeds a logistic output. A document scores as its highest sentence
(multiple-instance learning: a judgement says that some sentence is abusive, not which). Disguises are undone first:
invisible letters, accents, digits and signs for letters, spaced or dotted letters, repeated letters, swaps.

The model learns from judged documents only, ``max_docs`` of them at most, in one task of an executor. Every document is
scored whole, once, in Arrow batches; the thresholds are calibrated by language on all judged documents that the model
hasn't seen.
"""

from __future__ import annotations

import math
import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.abuse_words import WORDS
from tabularium.session import small, stage

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 14, 24, 24, (1, 2, 3, 5)
PAD = max(WIDTHS) - 1
END = "\x01"

_HIDDEN = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯­​-‏⁠-⁤﻿\x01]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”')\]]*\s+|\n+|;\s+(?=\S+\s+\S+\s+\S+)")
_DOTTED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_·]){2,}[^\W\d_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_] ){2,}[^\W_](?![^\W_])")
_TOKEN = re.compile(END + r"|[\"“”«»]|[^\W_](?:[^\W_]|[@#*_$%!+](?=[^\W_]))*")
_CAPITAL = re.compile(r"\b[A-Z]")
_INNER = re.compile(r"(?<=[a-z,] )[A-Z][a-z]{2,}\b")
_REPEAT = re.compile(r"(.)\1+")
_LEET = str.maketrans("0134578@$!", "oieastbasi")


def _squeezed(word: str) -> str:
    return _REPEAT.sub(r"\1", word)


def _seen(text: str) -> str:
    """text without accents and invisible characters; case is kept."""
    return text.replace(END, " ") if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFD", text))


LEXICON = frozenset(_squeezed(_seen(w).lower()) for words in WORDS.values() for w in words)


@lru_cache(maxsize=200_000)
def _name(word: str) -> str:
    short = _squeezed(word.lower())
    return word if short in LEXICON or short.rstrip("s") in LEXICON else "nome"


def _unnamed(text: str) -> str:
    """text with the capitalised words inside its sentences read as 'nome': who is named says nothing about abuse.

    Words of the lexicon stay, as does a text that capitalises more than half of its words.
    """
    if len(_CAPITAL.findall(text)) * 2 > text.count(" ") + 1:
        return text
    return _INNER.sub(lambda m: _name(m.group(0)), text)


_SWAPS = {(len(w), "".join(sorted(w)), w[0]): w for w in sorted(LEXICON) if len(w) >= 5}


@lru_cache(maxsize=200_000)
def repair(word: str) -> str:
    """A disguised word as meant: signs and digits for letters, repeated and swapped letters. Plain numbers become '0'."""
    if word in '"“”«»':
        return '"'
    if word.isdigit():
        return "0"
    if not word.isalpha():
        read = _squeezed(re.sub(r"[^a-z]", "", word.translate(_LEET)))
        if read in LEXICON:
            return read
        pattern = re.compile("".join(re.escape(c) if c.isalpha() else "." for c in _squeezed(word)))
        whole = re.compile("".join(re.escape(c) if c.isalpha() else "." for c in word))
        for w in sorted(LEXICON):
            if pattern.fullmatch(w) or whole.fullmatch(w) or not w.endswith("s") and pattern.fullmatch(w + "s"):
                return w
        word = re.sub(r"[^a-z]", "", word.translate(_LEET)) or "0"
    short = _squeezed(word)
    if short in LEXICON:
        return short
    for stem in (short, short[:-1] if short.endswith("s") else short):
        if stem in LEXICON:
            return stem
        if len(stem) >= 5 and (w := _SWAPS.get((len(stem), "".join(sorted(stem)), stem[0]))):
            return w
    return short


def _joined(letters: str) -> str:
    """Spaced letters as one word; a single-letter word before it stays apart where the rest is a known word."""
    if sum(c.isalpha() for c in letters) < 3:
        return letters
    word = letters.replace(" ", "")
    if word[0] in "aeo" and repair(word) not in LEXICON and repair(word[1:]) in LEXICON:
        return word[0] + " " + word[1:]
    return word


def marks(text: str | None) -> list[str]:
    """The raw tokens of a text in order, with END between its sentences; whole texts, however long."""
    if not text:
        return []
    plain = _SENTENCE.sub(f" {END} ", _unnamed(_seen(text)).lower())
    plain = _DOTTED.sub(lambda m: re.sub(r"[.\-_·]", "", m.group(0)), plain)
    plain = _SPACED.sub(lambda m: _joined(m.group(0)), plain)
    return _TOKEN.findall(plain)


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as repaired words; null, empty and wordless texts give none."""
    out: list[list[str]] = [[]]
    for m in marks(text):
        if m == END:
            out.append([])
        else:
            out[-1].append(repair(m))
    return [s for s in out if s]


@lru_cache(maxsize=200_000)
def subwords(word: str) -> tuple[int, ...]:
    """Buckets of a word and all its letter trigrams."""
    marked = f"<{word}>"
    return tuple(zlib.crc32(g.encode()) % BUCKETS for g in [marked] + [marked[i : i + 3] for i in range(len(marked) - 2)])


def flat(sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers with PAD times -1 after each sentence, places of words, first word of each sentence) of non-empty sentences."""
    lengths = np.array([len(s) for s in sentences])
    starts = np.cumsum(lengths + PAD) - lengths - PAD
    ids = np.full(int(lengths.sum()) + PAD * len(sentences), -1)
    firsts = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum())) + np.repeat(starts - firsts, lengths)
    ids[places] = np.concatenate(sentences)
    return ids, places, firsts


@dataclass
class Model:
    """embedding: buckets x DIM; filters by width; out: weights of the pooled filters, and the bias.

    Words outside ``known`` (seen in fewer than three training documents, mostly names) count a third.
    """

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    known: frozenset = frozenset()

    def words(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors with a zero one at the end, flat buckets, first bucket, scale of each word)."""
        lists = [subwords(w) for w in vocabulary]
        sizes = np.array([len(x) for x in lists])
        buckets = np.fromiter((b for x in lists for b in x), np.int64, int(sizes.sum()))
        firsts = np.cumsum(sizes) - sizes
        scale = (np.array([1.0 if w in self.known else 0.3 for w in vocabulary]) / np.sqrt(sizes)).astype(np.float32)[:, None]
        vectors = np.add.reduceat(self.embedding[buckets], firsts) * scale
        return np.vstack([vectors, np.zeros((1, DIM), np.float32)]), buckets, firsts, scale

    def forward(self, vectors: np.ndarray, ids: np.ndarray, places: np.ndarray, firsts: np.ndarray):
        """(logits of the sentences of ``flat``, pooled features, the windows' activations)."""
        x = vectors[ids]
        pooled, acts = [], []
        for f, b, w in zip(self.filters, self.biases, WIDTHS):
            act = x[places] @ f[:DIM]
            for i in range(1, w):
                act += x[places + i] @ f[i * DIM : (i + 1) * DIM]
            act += b
            pooled.append(np.maximum(np.maximum.reduceat(act, firsts), 0))
            acts.append(act)
        features = np.concatenate(pooled, axis=1)
        return features @ self.out + np.float32(self.bias), features, acts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _evidence(bags: list[tuple[list[np.ndarray], int]], size: int) -> list[np.ndarray]:
    """For each sentence of each document: how far its words and word pairs speak for abuse, by their share of the other abusive documents.

    It tells which sentence of an abusive document may be meant before anything is learned, and which judgements no
    other document bears out.
    """
    grams = [[set(np.concatenate([s, s[:-1] * size + s[1:] + size]).tolist()) for s in own] for own, _ in bags]
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for own, (_, y) in zip(grams, bags):
        count[y].update(set().union(*own))
    total = [max(sum(y == k for _, y in bags), 1) for k in (0, 1)]

    def odds(g: int, y: int) -> float:
        return math.log((count[1][g] - y + 0.1) / (total[1] + 1)) - math.log((count[0][g] - (1 - y) + 0.5) / (total[0] + 1))

    return [np.array([sum(sorted((odds(g, y) for g in s), reverse=True)[:4]) for s in own]) for own, (_, y) in zip(grams, bags)]


class Neighbours:
    """Tells which sentences of judged documents others bear out as clean: of the documents with the most similar
    sentences most are judged clean.

    Two sentences are similar if they share half of their word pairs, begin and end included. The ``nearest`` documents
    count, with all that are as near as the last of them; fewer than three tell nothing.
    """

    def __init__(self, bags: list[tuple[list[np.ndarray], int]], size: int, nearest: int = 8) -> None:
        self.nearest = nearest
        self.labels = np.array([y for _, y in bags])
        self.firsts = np.cumsum([0] + [len(own) for own, _ in bags])
        self.owner = np.repeat(np.arange(len(bags)), np.diff(self.firsts))
        ends = [np.concatenate([[size], s, [size]]) for own, _ in bags for s in own]
        self.pairs = [np.unique(e[:-1] * (size + 1) + e[1:]) for e in ends]
        self.sizes = np.array([len(p) for p in self.pairs])
        keys = np.concatenate(self.pairs)
        order = np.argsort(keys, kind="stable")
        self.places = np.repeat(np.arange(len(self.pairs)), self.sizes)[order]
        self.keys, begins = np.unique(keys[order], return_index=True)
        self.begins = np.append(begins, len(keys))
        self.told: dict[int, bool] = {}

    def clean(self, doc: int, sentence: int) -> bool:
        """Whether other documents bear the sentence out as clean."""
        n = int(self.firsts[doc]) + sentence
        if n not in self.told:
            at = np.searchsorted(self.keys, self.pairs[n])
            common = np.bincount(np.concatenate([self.places[self.begins[a] : self.begins[a + 1]] for a in at]), minlength=len(self.pairs))
            alike = common / np.maximum(self.sizes, self.sizes[n])
            found = np.flatnonzero((alike >= 0.5) & (self.owner != doc))
            best = np.zeros(len(self.labels))
            np.maximum.at(best, self.owner[found], alike[found])
            others = np.unique(self.owner[found])
            if len(others) > self.nearest:
                others = others[best[others] >= np.sort(best[others])[-self.nearest]]
            self.told[n] = len(others) >= 3 and bool(self.labels[others].mean() < 0.5)
        return self.told[n]


def train(docs: list[tuple[list[list[str]], int]], epochs: int = 10, rate: float = 0.01, seed: int = 5) -> Model:
    """A model fitted on documents (sentences, label) by Adam on the logistic loss of the highest sentence.

    Documents without sentences are skipped; without any abusive document every text scores low.
    """
    rng, dice = np.random.default_rng(seed), random.Random(seed)
    model = Model(
        rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 1 / math.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        -3.0,
    )
    docs = [(s, y) for s, y in docs if s]
    if not any(y for _, y in docs):
        return model
    seen = Counter(w for s, _ in docs for w in {w for x in s for w in x})
    model.known = frozenset(w for w, n in seen.items() if n >= 3)
    names = {w: n for n, w in enumerate(seen)}
    order = list(names)
    bags = [([np.array([names[w] for w in x]) for x in s], y) for s, y in docs]
    evidence = _evidence(bags, len(names))
    near = Neighbours(bags, len(names))
    # what others bear out as clean can't be what an abusive document is judged for, unless it has nothing else
    meant = [np.array([not (y and near.clean(d, i)) for i in range(len(own))]) for d, (own, y) in enumerate(bags)]
    positive = sum(y for _, y in bags)
    balance = min(2.0, max(1.0, (len(bags) - positive) / positive / 4))
    trust = np.array([sigmoid(e.max() - 4) if y else 1.0 for e, (_, y) in zip(evidence, bags)])
    trust /= max(trust[d] for d, (_, y) in enumerate(bags) if y) * np.array([y for _, y in bags]) + np.array([1 - y for _, y in bags])
    state: dict[int, list[np.ndarray]] = {}
    step = 0

    def adam(key: int, value: np.ndarray, grad: np.ndarray) -> None:
        m = state.setdefault(key, [np.zeros_like(value), np.zeros_like(value)])
        m[0] += np.float32(0.1) * (grad - m[0])
        m[1] += np.float32(0.01) * (grad * grad - m[1])
        value -= np.float32(rate) * (m[0] / np.float32(1 - 0.9**step)) / (np.sqrt(m[1] / np.float32(1 - 0.99**step)) + np.float32(1e-8))

    turn = list(range(len(bags)))
    worst: dict[int, int] = {}
    for epoch in range(epochs):
        dice.shuffle(turn)
        for a in range(0, len(turn), 64):
            step += 1
            own, y, weight = [], [], []
            part = turn[a : a + 64]
            # of a clean document some sentences an epoch, others the next time, and always the highest of the last
            taken = [list(range(len(bags[d][0]))) if bags[d][1] or len(bags[d][0]) <= 6 else dice.sample(range(len(bags[d][0])), 6) for d in part]
            taken = [t if d not in worst or worst[d] in t else [worst[d], *t[1:]] for d, t in zip(part, taken)]
            every = [bags[d][0][i] for d, t in zip(part, taken) for i in t]
            used, back = np.unique(np.concatenate(every), return_inverse=True)
            vectors, buckets, firsts, scale = model.words([order[i] for i in used])
            ends = np.cumsum([len(s) for s in every])
            local = np.split(back, ends[:-1])
            logits = model.forward(vectors, *flat(local))[0]
            at = 0
            for d, t in zip(part, taken):
                label, mine = bags[d][1], logits[at : at + len(t)]
                # the highest sentence of an abusive document, the three highest of a clean one
                rank = mine if not label or epoch >= 2 else evidence[d]
                best = np.argsort(-np.where(meant[d][t], rank, rank - 1e6), kind="stable")[: 1 if label else 3]
                worst[d] = t[best[0]]
                w = float(trust[d])
                # judgements count as far as the others bear them out
                if label and not meant[d].any():
                    w *= 0.05
                elif label and epoch >= 3 and mine[best[0]] < 0:
                    w *= 0.3 if epoch < 6 else 0.05
                elif not label and epoch >= 4 and mine[best[0]] > 2.2 and not near.clean(d, t[best[0]]):
                    w = 0.1
                own += [local[at + i] for i in best]
                y += [label] * len(best)
                weight += [w * (balance if label else 1 / 1.5)] * len(best)
                at += len(t)
            ids, places, begins = flat(own)
            logits, features, acts = model.forward(vectors, ids, places, begins)
            error = ((sigmoid(logits) - (0.97 * np.array(y) + 0.01)) * np.array(weight) / len(part)).astype(np.float32)
            grad_features = error[:, None] * model.out * (features > 0)
            grad_out, grad_bias = features.T @ error, float(error.sum())
            x, grad_x = vectors[ids], np.zeros((len(ids), DIM), np.float32)
            lasts = np.append(begins[1:], len(places))
            for n, (f, w) in enumerate(zip(model.filters, WIDTHS)):
                g = grad_features[:, n * FILTERS : (n + 1) * FILTERS]
                top = np.stack([acts[n][b:e].argmax(axis=0) + b for b, e in zip(begins, lasts)])  # sentences x filters
                where = places[top]
                grad_f = np.empty_like(f)
                for i in range(w):
                    grad_f[i * DIM : (i + 1) * DIM] = np.einsum("sf,sfd->df", g, x[where + i])
                    for c in range(FILTERS):  # the places of one filter differ from sentence to sentence
                        grad_x[where[:, c] + i] += g[:, c, None] * f[i * DIM : (i + 1) * DIM, c]
                adam(10 + n, model.filters[n], grad_f + np.float32(1e-4) * f)
                adam(20 + n, model.biases[n], g.sum(axis=0))
            adam(1, model.out, grad_out + np.float32(1e-4) * model.out)
            model.bias -= rate * grad_bias
            grad_words = np.zeros((len(used) + 1, DIM), np.float32)
            np.add.at(grad_words, ids, grad_x)
            grad_words = grad_words[:-1] * scale
            grad_e = np.zeros_like(model.embedding)
            np.add.at(grad_e, buckets, np.repeat(grad_words, np.diff(np.append(firsts, len(buckets))), axis=0))
            adam(0, model.embedding, grad_e)
    return model


class Scorer:
    """Scores documents with a model; word vectors are kept between batches, up to ``most`` words."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        self.model, self.most = model, most
        self.numbers: dict[str, int] = {}
        self.vectors = np.zeros((0, DIM), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the highest sentence of each text; 0 for texts without words."""
        tokens = [marks(t) for t in texts]
        if len(self.numbers) > self.most:
            self.numbers, self.vectors = {}, np.zeros((0, DIM), np.float32)
        new = [m for m in {m for t in tokens for m in t} if m not in self.numbers and m != END]
        if new:
            self.vectors = np.vstack([self.vectors, self.model.words([repair(m) for m in new])[0][:-1]])
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        numbers, out = {**self.numbers, END: -1}, np.zeros(len(texts))
        vectors = np.vstack([self.vectors, np.zeros((1, DIM), np.float32)])
        owners, items, size = [], [], 0
        for n, t in enumerate(tokens):
            ids = np.array([numbers[m] for m in t], np.int64)
            cuts = np.flatnonzero(ids < 0)
            for s in np.split(ids, cuts):
                s = s[1:] if len(s) and s[0] < 0 else s
                if len(s):
                    owners.append(n)
                    items.append(s)
                    size += len(s)
            if size > 50_000 or n + 1 == len(tokens):
                if items:
                    np.maximum.at(out, owners, sigmoid(self.model.forward(vectors, *flat(items))[0]).astype(np.float64))
                owners, items, size = [], [], 0
        return out


def judged(reviews: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """(staged labels (doc_id, rotulo), the sample of them that is learned from, with held: the fifth that isn't).

    A document's label is the majority of its judgements; ties and nulls are left out. The sample holds at most
    max_docs documents, half of them abusive if there are as many, in an order by hash.
    """
    votes = reviews.filter(F.col("ofensivo").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum(F.col("ofensivo") * 2 - 1).alias("v")).filter("v <> 0")
    labels = stage(votes.select("doc_id", (F.col("v") > 0).cast("int").alias("rotulo")), "p10-rotulos")
    totals = {r["rotulo"]: r["count"] for r in labels.groupBy("rotulo").count().collect()}
    bad = min(totals.get(1, 0), max_docs // 2)
    clean = min(totals.get(0, 0), max_docs - bad)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = labels.filter("rotulo = 1").orderBy(*order).limit(bad).unionByName(labels.filter("rotulo = 0").orderBy(*order).limit(clean))
    return labels, stage(sample.withColumn("fora", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0), "p10-amostra")


def fit(documents: DataFrame, reviews: DataFrame, max_docs: int = 6000) -> tuple[Model, DataFrame]:
    """(the classifier, fitted on four fifths of at most ``max_docs`` judged documents; the labels of all others).

    The texts are split into words in parallel; one task of an executor learns from them. Only the model (about 2 MB)
    comes back. Without judged documents nothing is abusive.
    """
    labels, sample = judged(reviews, max_docs)
    learned = F.broadcast(sample.filter("not fora").select("doc_id", "rotulo"))  # at most max_docs rows

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([sentences(t) for t in batch.column(2).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), items], names=["doc_id", "rotulo", "frases"])

    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(learned, "doc_id").select("doc_id", "rotulo", "text")
    ready = stage(texts.mapInArrow(split, "doc_id bigint, rotulo int, frases array<array<string>>"), "p10-frases")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((d, y, f) for b in batches for d, y, f in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(f, y) for _, y, f in rows]))], pa.binary())], names=["modelo"])

    made = ready.coalesce(1).mapInArrow(learn, "modelo binary").first()
    return train([]) if made is None else pickle.loads(made["modelo"]), labels.join(learned.select("doc_id"), "doc_id", "left_anti")


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, lang, nota) for every document: nota is the score of its highest sentence, 0 for null and empty texts."""
    arrow = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("nota", pa.float64())])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed size: 1.6 MB and the known words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            notes = scorer.score(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(notes, pa.float64())], schema=arrow)

    return documents.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id bigint, source string, lang string, nota double")


GRID = tuple(i / 100 for i in range(10, 95, 5))


def thresholds(scored: DataFrame, labels: DataFrame, prior: int = 200) -> tuple[DataFrame, float]:
    """((lang, limite) of every judged language, the limit of all languages together), by the best F1 on labels (doc_id, rotulo).

    A language's own counts are joined with those of all languages, which weigh as ``prior`` documents: much evidence of
    its own moves a language to its own limit, little leaves it near the common one. Among almost equal limits the one
    nearest to a half counts; without judgements that is 0.5.
    """
    each = scored.select("doc_id", "lang", "nota").join(labels, "doc_id").select("lang", "rotulo", "nota", F.explode(F.array(*map(F.lit, GRID))).alias("t"))
    over = (F.col("nota") >= F.col("t")).cast("int")
    own = each.groupBy("lang", "t").agg(F.sum(over * F.col("rotulo")).alias("certos"), F.sum(over).alias("ditos"), F.sum("rotulo").alias("reais"), F.count("*").alias("n"))
    own = stage(own, "p10-contagens")
    every = own.groupBy("t").agg(*[F.sum(c).alias("g_" + c) for c in ("certos", "ditos", "reais", "n")])  # one row per step of the grid

    def best(f1, keys: list[str], df: DataFrame) -> DataFrame:
        rank = F.struct(F.round(f1 / 0.005).alias("f"), (-F.abs(F.col("t") - 0.5)).alias("d"), (-F.col("t")).alias("t"))
        return df.withColumn("r", rank).groupBy(*keys).agg(F.max_by("t", "r").alias("limite"))

    pooled = best(2 * F.col("g_certos") / F.greatest(F.col("g_ditos") + F.col("g_reais"), F.lit(1)), [], every).first()["limite"]
    share = F.lit(float(prior)) / F.col("g_n")
    mixed = own.filter("lang IS NOT NULL").join(F.broadcast(every), "t")
    part = lambda c: F.col(c) + share * F.col("g_" + c)
    return best(2 * part("certos") / F.greatest(part("ditos") + part("reais"), F.lit(1e-9)), ["lang"], mixed), 0.5 if pooled is None else pooled


def flag(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, nota, ofensivo) of staged scored documents: whether each reaches the limit of its language."""
    own, common = thresholds(scored, labels)
    limits = small(stage(own, "p10-limites"))
    return scored.join(limits, "lang", "left").select("doc_id", "source", "nota", (F.col("nota") >= F.coalesce("limite", F.lit(common))).alias("ofensivo"))


def source_rates(flagged: DataFrame) -> DataFrame:
    """(source, documentos, ofensivos, taxa, nota_media) per source, the null one included."""
    return flagged.groupBy("source").agg(
        F.count("*").alias("documentos"), F.count_if("ofensivo").alias("ofensivos"), F.round(F.avg(F.col("ofensivo").cast("int")), 6).alias("taxa"), F.round(F.avg("nota"), 6).alias("nota_media")
    )
