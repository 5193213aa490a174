"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its labels.

Edge cases: null and empty texts have no words, get the classifier's score for no features and are predicted 0; repeated
rows are scored alike; with no labels the lexicons given vote alone; rows with a null label are not learned from; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import ascii_lower, by_bytes, materialise
from mnemos.llm.quality_rules import labelled_sample

#: Seed lexicons of abusive words, a voter each.
LEXICONS: dict[str, tuple[str, ...]] = {
    "insult_mind": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool"),
    "insult_worth": ("worthless", "pathetic", "loser", "losers", "useless", "failure"),
    "insult_person": ("clown", "clowns", "scum", "trash", "vermin", "pig", "rat"),
    "disgust": ("disgusting", "vile", "filthy", "gross", "repulsive"),
    "hate": ("hate", "despise", "loathe"),
    "threat": ("kill", "die", "hurt", "destroy"),
    "german": ("dummkopf", "trottel", "abschaum", "versager", "idioten"),
    "french": ("imbécile", "crétin", "ordure", "minable", "débile"),
    "spanish": ("imbécil", "estúpido", "basura", "inútil", "escoria"),
}
PATTERNS: dict[str, str] = {
    "you_are": r"\b(?:you|u)(?: are|'re| r)(?: (?:a|an|such|so|all))* (?:idiot|moron|loser|clown|stupid|pathetic|worthless|trash|scum|disgusting)",
    "shouted": r"\b(?:IDIOT|MORON|STUPID|LOSER|SCUM|TRASH|PATHETIC|CLOWN)\b",
    "masked": r"\b(?:[i1!]d[i1!][o0]t|m[o0]r[o0]n|l[o0]s[e3]r|stup[i1!]d|tr[a@]sh|sc[u*]m)\b",
}
#: ASCII punctuation as space, A-Z lower-cased.
_NORMAL = {c: " " for c in range(128) if not chr(c).isalnum()} | {c: chr(c + 32) for c in range(65, 91)}


@dataclass(frozen=True)
class ToxicityConfig:
    """max_docs bounds the labelled sample that everything is learned from, whatever the input."""

    max_docs: int = 20_000
    least_count: int = 5
    least_share: float = 0.005  # of the toxic documents, that a learned word or beginning occurs in
    least_precision: float = 0.8
    steps: int = 300
    threshold: float = 0.5


def document_words(text: str | None) -> list[str]:
    return (text or "").translate(_NORMAL).split()


@dataclass(frozen=True)
class Lexicon:
    """What the labelled sample teaches: words and word beginnings of toxic documents, and what isn't toxic after all."""

    terms: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    cleared: frozenset[str] = frozenset()  # words of clean documents: of the seed lexicons, or with one of the stems


def learn_lexicon(sample: DataFrame, config: ToxicityConfig, text: str = "text", label: str = "toxic") -> Lexicon:
    """Distributed counts of documents by word (equal texts count once). A word or beginning is learned by its evidence
    alone: how many toxic documents have it (least_count, and least_share of them), and how few others (least_precision).
    What reaches the driver are the words of toxic documents at these thresholds, of a sample bounded by max_docs."""
    once = sample.groupBy(F.xxhash64(text)).agg(F.first(text).alias("t"), F.max(label).alias("y"))
    flat = F.regexp_replace(ascii_lower(F.coalesce(F.col("t"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    once = once.select("y", F.explode(F.array_distinct(F.split(flat, " "))).alias("w"))
    counts = materialise(once.where("w != ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")), "toxic-words")
    n, p = F.col("n"), F.col("p")
    least = max(config.least_count, config.least_share * (sample.agg(F.sum(label)).first()[0] or 0))
    terms = [r["w"] for r in counts.where((p >= least) & (p >= config.least_precision * n)).orderBy(F.desc("p"), "w").collect()]
    seeds = [w for k in LEXICONS for w in LEXICONS[k]]
    cleared = {r["w"] for r in counts.where(F.col("w").isin(seeds) & (n >= 4) & (p < 0.4 * n)).collect()}
    begins = counts.where(n - p <= 1).select(n, p, F.explode(F.array(*(F.when(F.length("w") > k, F.substring("w", 1, k)) for k in (5, 6, 7)))).alias("s")).where("s is not null")
    best = begins.groupBy("s").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("words")).where((p >= 2 * least) & (p >= config.least_precision * n) & (F.col("words") >= 4))
    stems: list[str] = []
    for r in best.orderBy(F.length("s"), F.desc("p"), "s").collect():
        if not any(r["s"].startswith(x) for x in stems):
            stems.append(r["s"])
    if stems:
        starts = F.lit(False)
        for x in stems:
            starts = starts | F.col("w").startswith(x)
        cleared |= {r["w"] for r in counts.where(starts & (n - p >= 2) & (p < 0.5 * n)).collect()}
    return Lexicon(tuple(terms), tuple(stems), frozenset(cleared))


@dataclass(frozen=True)
class Voters:
    """Each votes 1 (toxic), -1 (not) or 0 (abstains) on a text."""

    learned: Lexicon = Lexicon()
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        names = [*(f"lexicon:{k}" for k in LEXICONS), *(f"pattern:{k}" for k in PATTERNS), *(f"term:{t}" for t in self.learned.terms), *(f"stem:{t}" for t in self.learned.stems), "dense", "several", "clean_lexicon", "clean_learned", "clean_sparse"]
        object.__setattr__(self, "names", tuple(names))

    def compiled(self) -> tuple:
        vocabulary: dict[str, list[int]] = {}
        for i, k in enumerate(LEXICONS):
            for w in LEXICONS[k]:
                if w not in self.learned.cleared:
                    vocabulary.setdefault(w, []).append(i)
        base = len(LEXICONS) + len(PATTERNS)
        for j, t in enumerate(self.learned.terms):
            vocabulary.setdefault(t, []).append(base + j)
        return vocabulary, frozenset(vocabulary), frozenset(self.learned.terms), [re.compile(p) for p in PATTERNS.values()]

    def votes(self, text: str | None, made: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The votes, and the classifier's features: which voters' words occur, and their log counts."""
        vocabulary, known, terms, patterns = made
        w = document_words(text)
        words = set(w)
        hit = known & words
        v = np.zeros(len(self.names), dtype=np.int8)
        tail = len(self.names) - 5
        stem_at = tail - len(self.learned.stems)
        stemmed = set()
        for j, x in enumerate(self.learned.stems):
            found = {y for y in words if y.startswith(x)} - self.learned.cleared
            if found:
                v[stem_at + j] = 1
                stemmed |= found
        count = 0
        in_terms = len((hit & terms) | stemmed)
        for x in hit:
            for i in vocabulary[x]:
                v[i] = 1
        matched, more = self.matches(text, patterns, v, hit | stemmed)
        marked = hit | stemmed | matched
        if marked:
            count = sum(x in marked for x in w) + more
            v[tail] = 1 if count * 200 > len(w) else 0
            v[tail + 1] = 1 if len(marked) >= 3 else 0
        v[tail + 2] = 0 if hit or matched else -1
        v[tail + 3] = 0 if in_terms or matched else -1
        v[tail + 4] = -1 if count * 2000 < len(w) or not w else 0
        x = np.zeros(tail + 3)
        x[:tail] = v[:tail]
        x[tail] = np.log1p(len(marked))
        x[tail + 1] = np.log1p(in_terms)
        x[tail + 2] = np.log1p(1000.0 * count / max(1, len(w))) / 4
        return v, x


    def matches(self, text: str | None, patterns: list, v: np.ndarray, marked: set[str]) -> tuple[set[str], int]:
        """Sets the patterns' votes, and gives what they found besides marked words: distinct, and how often outside of
        single words (those the caller counts). A word that is cleared is no masked one."""
        found: set[str] = set()
        more = 0
        low = (text or "").lower()
        for j, (name, p) in enumerate(zip(PATTERNS, patterns)):
            for m in p.finditer(text or "" if name == "shouted" else low):
                x = m.group().lower()
                if name == "masked" and x in self.learned.cleared:
                    continue
                v[len(LEXICONS) + j] = 1
                w = document_words(x)
                if marked.isdisjoint(w):
                    found.add(w[0] if len(w) == 1 else x)
                    more += len(w) > 1
        return found, more


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) of each voter, the prior, and how far correlated voters repeat each other."""

    prior: float
    rates: np.ndarray  # (voters, 2 classes, 3 votes)
    weight: np.ndarray  # 1 / (1 + sum of a voter's correlations given the class)

    @staticmethod
    def fit(votes: np.ndarray, prior: float, rounds: int = 60, times: np.ndarray | None = None) -> LabelModel:
        """Expectation maximisation, then the correlations that remain given the class, then again with those weights.

        A voter's log likelihood ratio counts 1 / (1 + sum of |correlations|), so that voters that repeat each other
        weigh together about what one weighs. Row i of votes counts times[i] times (once, where not given).
        """
        m = votes.shape[1]
        times = np.ones(len(votes)) if times is None else times.astype(np.float64)
        n = times.sum()
        onehot = np.stack([votes == k for k in (-1, 0, 1)], axis=-1).astype(np.float32)
        toxic, clean = (votes > 0).sum(axis=1), (votes < 0).sum(axis=1)
        start = np.clip(prior + 0.4 * np.sign(toxic - clean * 0.5) * (toxic + clean > 0), 0.02, 0.98)
        weight = np.ones(m)
        post, rates = start, np.full((m, 2, 3), 1 / 3)
        for phase in range(2):
            for _ in range(rounds):
                for c, p in ((0, times * (1 - post)), (1, times * post)):
                    rates[:, c] = (np.einsum("n,nmk->mk", p, onehot) + 0.1) / (p.sum() + 0.3)
                ratio = np.log(rates[:, 1] / rates[:, 0])
                score = np.log(prior / (1 - prior)) + np.einsum("nmk,mk,m->n", onehot, ratio, weight)
                after = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
                done = np.abs(after - post).max() < 1e-6
                post = after
                if done:
                    break
            if phase == 0:
                left = votes - (post[:, None] * (rates[:, 1, 2] - rates[:, 1, 0]) + (1 - post)[:, None] * (rates[:, 0, 2] - rates[:, 0, 0]))
                sd = np.sqrt(times @ (left - times @ left / n) ** 2 / n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = np.abs(((left.T * times) @ left) / n / np.outer(sd, sd))
                corr = np.where(np.isfinite(corr) & (corr > 0.1), np.minimum(corr, 1.0), 0.0)
                np.fill_diagonal(corr, 0.0)
                weight = 1 / (1 + corr.sum(axis=1))
        return LabelModel(prior, rates, weight)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.rates[:, 1] / self.rates[:, 0])
        score = np.log(self.prior / (1 - self.prior)) + (ratio[np.arange(votes.shape[1]), votes + 1] * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(score, -60, 60)))


@dataclass(frozen=True)
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> list[float]:
        made = self.voters.compiled()
        out = []
        for t in texts:
            _, x = self.voters.votes(t, made)
            out.append(float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -60, 60)))))
        return out


def fit_linear(x: np.ndarray, target: np.ndarray, steps: int, decay: float = 1e-3, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on soft targets by damped Newton steps; the last weight is the constant. Row i counts times[i]
    times."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.full(len(x), 1 / len(x)) if times is None else times / times.sum()
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (target - p)) - decay * w
        hess = (x.T * (share * p * (1 - p))) @ x + (decay + 1e-6) * np.eye(len(w))
        change = np.linalg.solve(hess, grad)
        w = w + change
        if np.abs(change).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learns from the labelled rows given. Labels choose the learned lexicon's terms and the share of toxic documents;
    the classifier itself sees the label model's posteriors only. Votes and features of the sample (bounded by
    max_docs) reach the driver as small arrays."""
    sample = materialise(labelled_sample(docs.select(doc_id, text), labels, "toxic", config.max_docs, doc_id).select(F.col(text).cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")), "toxic-sample")
    n, p = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    voters = Voters(learn_lexicon(sample, config) if n else Lexicon())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = voters.compiled()
        for b in batches:
            pairs = [voters.votes(t, made) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v, _ in pairs], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in pairs], pa.binary())], names=["v", "x"])

    # equal votes and features count once, with their number: the classifier sees as many rows as there are kinds
    kinds = sample.select("text").mapInArrow(run, "v binary, x binary").groupBy("v", "x").agg(F.count(F.lit(1)).alias("n")).orderBy("v", "x").collect()
    m = len(voters.names)
    prior = min(0.5, max(0.02, (p or 0) / n)) if n else 0.1
    if not kinds:
        model = LabelModel(prior, np.full((m, 2, 3), 1 / 3), np.ones(m))
        return ToxicityModel(voters, model, np.r_[np.full(len(LEXICONS) + len(PATTERNS), 3.0), np.zeros(3), -2.0])
    votes = np.array([np.frombuffer(k["v"], dtype=np.int8) for k in kinds]).reshape(-1, m).astype(np.int64)
    x = np.array([np.frombuffer(k["x"], dtype="<f4") for k in kinds]).reshape(len(votes), -1).astype(np.float64)
    times = np.array([k["n"] for k in kinds], dtype=np.float64)
    model = LabelModel.fit(votes, prior, times=times)
    return ToxicityModel(voters, model, fit_linear(x, model.posterior(votes), config.steps, times=times))


def score_documents(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (probability of toxic) of each whole text, in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
