"""Toxicity by a weighted finite-state grammar of clauses.

Five small transducers read the words of a clause as symbols: an insult, a threat, a target (whom it is aimed at), a
negation and a report of what somebody said. Their product is one transducer; every insult or threat it reads is put
out together with what the others know by then: negated within the last words, reported, aimed at somebody. So a
clause is scored as a whole and not its words apart. What a document's clauses put out is weighed by weights learned
from labels. Insults are the listed words and those that the training labels give away; words that share the first
bytes with words of toxic training documents are slurs, a weaker symbol that takes several to convince.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import kernels as K
from millrace.llm.labelled import fit_logistic, remainder, sampled, sigmoid
from millrace.llm.stage import forget, texts_of, written

# Fixed word lists of the grammar.
INSULTS = (
    "idiot idiots moron morons stupid dumb trash scum loser losers clown worthless pathetic disgusting fool imbecile "
    "bastard asshole bitch vermin filth dummkopf trottel abschaum versager wertlos erbärmlich ekelhaft crétin débile "
    "ordure minable dégoûtant abruti estúpido imbécil basura escoria inútil patético asqueroso"
).split()
THREATS = "kill hurt destroy crush beat stab shoot burn murder töten vernichten verletzen tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours u he she they them him her these those du dich dir ihr euch sie tu toi te vous ils elles tú te vosotros ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls quoted reported wrote claims sagte sagt nannte schrieb dit écrit appelé dijo llamó escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SLUR = range(7)
KINDS = (INSULT, THREAT, SLUR)
STEM = 6  # bytes
REACH = 3  # words over which a negation holds
PATTERNS = 24  # insult, threat or slur x aimed x negated x reported
BREAKS = np.zeros(256, bool)
BREAKS[[*b".!?;\n"]] = True  # not a colon, which may lead into reported speech
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("'")]] = False


def transducers() -> list[tuple[int, callable]]:
    """States and step of each: aimed, reported, and how long a negation still holds."""
    return [
        (2, lambda state, symbol: 1 if symbol == TARGET else state),
        (2, lambda state, symbol: 1 if symbol == REPORT else state),
        (REACH + 1, lambda state, symbol: REACH if symbol == NEGATION else max(0, state - 1)),
    ]


def composed() -> tuple[np.ndarray, np.ndarray]:
    """The product: next state, and the pattern put out (-1: none), by state and symbol."""
    parts = transducers()
    states = list(product(*[range(n) for n, _ in parts]))
    number = {s: i for i, s in enumerate(states)}
    move, put = np.zeros((len(states), 7), np.int64), np.full((len(states), 7), -1)
    for state in states:
        for symbol in range(7):
            aimed, reported, negated = after = tuple(step(s, symbol) for s, (_, step) in zip(state, parts))
            move[number[state], symbol] = number[after]
            if symbol in KINDS:
                put[number[state], symbol] = 8 * KINDS.index(symbol) + 4 * aimed + 2 * (state[2] > 0) + reported
    return move, put


MOVE, PUT = composed()


def word_hashes(words: list[str]) -> np.ndarray:
    texts = next(K.slices(pa.array([*words, ""], pa.string()), 1 << 62))
    return np.unique(K.Words(texts, lower=True, white=OUTSIDE).hash)


class Grammar:
    """Word hashes by symbol, for looking up many words at once."""

    def __init__(self, learned: list[int] = (), stems: list[int] = ()):
        self.stems = np.sort(np.array(stems, np.int64).view(np.uint64))
        keys, symbols = [np.array(learned, np.int64).view(np.uint64)], [np.full(len(learned), INSULT)]
        for symbol, words in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            own = word_hashes(words)
            keys.append(own)
            symbols.append(np.full(len(own), symbol))
        keys, symbols = np.concatenate(keys), np.concatenate(symbols)
        keep = np.unique(keys[::-1], return_index=True)[1]  # a listed word keeps its symbol
        self.keys, self.symbols = keys[::-1][keep], symbols[::-1][keep]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def read(self, words: K.Words) -> np.ndarray:
        out = np.zeros(len(words.hash), np.int8)
        some = np.flatnonzero(self.near[(words.hash >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, words.hash[some]), len(self.keys) - 1)
        hit = self.keys[at] == words.hash[some]
        out[some[hit]] = self.symbols[at[hit]]
        if len(self.stems):
            stems = words.stems(STEM)
            at = np.minimum(np.searchsorted(self.stems, stems), len(self.stems) - 1)
            out[(self.stems[at] == stems) & (out == OTHER)] = SLUR
        return out

    def patterns(self, texts: K.Texts) -> np.ndarray:
        """How often each text puts out each pattern, and its words, last."""
        words = K.Words(texts, lower=True, white=OUTSIDE)
        counts = np.zeros((texts.n, PATTERNS + 1))
        counts[:, PATTERNS] = words.counts
        if not len(words.start):
            return counts
        symbols = self.read(words)
        stops = np.r_[0, np.cumsum(BREAKS[texts.data])][words.start]
        new = np.r_[True, (words.owner[1:] != words.owner[:-1]) | (stops[1:] != stops[:-1])]
        clause = np.cumsum(new) - 1
        strong = np.unique(clause[np.isin(symbols, KINDS)])
        first = np.flatnonzero(new)
        start, length = first[strong], np.diff(np.r_[first, len(symbols)])[strong]
        state = np.zeros(len(strong), np.int64)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], words.owner[start[order]]
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, "left"))
            symbol = symbols[start[:n] + t]
            out = PUT[state[:n], symbol]
            hit = out >= 0
            np.add.at(counts, (owner[:n][hit], out[hit]), 1)
            state[:n] = MOVE[state[:n], symbol]
        return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Each pattern's count; how many plain ones there are, neither negated nor reported; slurs by number and share."""
    counts, words = counts[:, :PATTERNS], counts[:, PATTERNS:]
    plain = counts[:, [0, 4, 8, 12]].sum(axis=1, keepdims=True)
    slurs = counts[:, 16:].sum(axis=1, keepdims=True)
    share = 1000 * slurs / np.maximum(words, 50)
    return np.hstack([np.log1p(counts), plain > 0, plain > 1, slurs > 1, slurs > 2, slurs > 3, np.log1p(share), np.log1p(share) * (slurs > 1)])


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents hold each word, and each beginning of a word (``stem``)."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for texts in K.slices(batch.column("text")):
            words = K.Words(texts, lower=True, white=OUTSIDE)
            stems = words.stems(STEM)
            for stem, hashes, owner in ((False, words.hash, words.owner), (True, stems[stems > 0], words.owner[stems > 0])):
                pair = np.unique(np.rec.fromarrays([hashes, owner]))
                h, inverse = np.unique(pair["f0"], return_inverse=True)
                toxic = np.bincount(inverse, weights=label[texts.first + pair["f1"]], minlength=len(h)).astype(np.int64)
                clean = np.bincount(inverse, minlength=len(h)) - toxic
                yield pa.RecordBatch.from_arrays([K.signed(h), pa.array(np.full(len(h), stem)), pa.array(toxic), pa.array(clean)], ["h", "stem", "toxic", "clean"])


def pattern_rows(grammar: Grammar):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                counts = grammar.patterns(texts)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(texts.first, texts.n), pa.array(list(counts))], ["label", "counts"])

    return rows


class Model:
    def __init__(self, grammar: Grammar, weights: np.ndarray):
        self.grammar, self.weights = grammar, weights

    def score(self, texts: K.Texts) -> np.ndarray:
        return sigmoid(features(self.grammar.patterns(texts)) @ self.weights[:-1] + self.weights[-1])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = 20_000, words: int = 200) -> Model:
    """Insults, slurs and weights from at most ``rows`` training documents; at most ``words`` of each are learned.

    A word is learned when it is in ten or more toxic training documents, a fiftieth of them at least, and fifty
    times rarer in others; the beginning of a word, when it is five times rarer.
    """
    sample = written(sampled(texts_of(docs), labels, "toxic", folds, held, rows), "labelled")
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = (F.col("toxic") / max(n.get(1, 0), 1)) / ((F.col("clean") + 0.5) / max(n.get(0, 0), 1))
    known = (
        sample.mapInArrow(word_rows, "h long, stem boolean, toxic long, clean long").groupBy("stem", "h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= 10)
    )
    telling = written(known.where((F.col("toxic") >= 0.02 * n.get(1, 0)) & (rate >= F.when(F.col("stem"), 5).otherwise(50))), "telling")
    found = [[r.h for r in telling.where(F.col("stem") == stem).orderBy(F.desc("toxic"), "h").limit(words).collect()] for stem in (False, True)]
    grammar = Grammar(*found)
    forget(telling)
    got = sample.mapInArrow(pattern_rows(grammar), "label int, counts array<double>").collect()  # at most ``rows``
    forget(sample)
    x = features(np.array([r.counts for r in got]).reshape(-1, PATTERNS + 1))
    return Model(grammar, fit_logistic(x, np.array([r.label for r in got], float)))


def score_rows(model: Model, limit: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                own, score = batch.slice(texts.first, texts.n), model.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return rows


def clean_rows(model: Model, limit: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(texts) for texts in K.slices(batch.column("text").cast(pa.string()))]
            yield batch.filter(pa.array(np.concatenate(scores) < limit)) if scores else batch

    return rows


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.7, folds: int = 3, held: int = 1, rows: int = 20_000) -> DataFrame:
    """Score of every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= limit).

    Labels are learned from documents whose crc32(doc_id as text) modulo ``folds`` is not ``held``. A null or empty
    text scores as one without any insult. Null ids are scored; their crc32 is that of the empty text. Repeated rows
    are scored alike. Without labels every score is 0.5. Other columns are ignored. No rows give no rows.
    """
    model = learn(docs, labels, folds, held, rows)
    own = texts_of(docs).withColumn("held_out", remainder(folds) == held)
    return own.mapInArrow(score_rows(model, limit), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that ``toxicity`` does not predict toxic."""
    return docs.mapInArrow(clean_rows(learn(docs, labels), limit), docs.schema)
