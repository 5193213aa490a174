"""Quality rules (native): a decision list learned by sequential covering from labelled text statistics.

Edge cases: a null text counts as empty (no words, so the base rule fails it); rates of texts without words are 0;
repeated documents keep their rows; with no labels, or labels of one kind, the list is empty and keeps what the base
rule keeps; rows with a null label are not learned from; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import SPACE_CLASS, SPACES, UPPER, materialise, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
FEATURES = ("symbol_rate", "bang_rate", "upper_rate", "repeat_rate", "next_rate", "dup_line_rate")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(hashes: Column, n_words: Column) -> Column:
    """Words inside 8-word windows that occur again, from the windows' hashes in order.

    Sorting (hash, position) puts equal windows side by side: O(n log n) in the row, no shuffle, no pairs. It is done
    only where some hash repeats. Hashes have 64 bits, within one text.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    first = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i"))
    before = F.concat(F.array(first), F.slice(ordered, 1, F.size(ordered) - 1))
    after = F.concat(F.slice(ordered, 2, F.size(ordered)), F.array(first))
    twin = lambda x, y: F.when(x["h"] == y["h"], x["i"])
    starts = F.array_sort(F.filter(F.zip_with(F.zip_with(ordered, before, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), after, lambda xy, z: F.coalesce(twin(xy["x"], xy["y"]), twin(xy["x"], z))), lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when((n_words > WINDOW) & (F.size(F.array_distinct(hashes)) < F.size(hashes)), covered).otherwise(0)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts of the text and the rates in FEATURES, in the docs' own partitions.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are exact counts over the whole text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_w", words(F.col(text)))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("_h", F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - (WINDOW - 1))), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    out = out.withColumns({
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(_repeat_words(F.col("_h"), F.col("n_words")), F.lit(0)).cast("long"),
        "_n_lines": F.size("_lines"),
        "_next": F.size(F.filter(F.zip_with("_w", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), lambda a, b: a == b), lambda same: same)),
        "_upper": F.length(body) - F.length(F.translate(body, UPPER, "")),
        "_bangs": F.length(body) - F.length(F.translate(body, "!", "")),
    })
    per_word, per_char = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return out.withColumns({
        "symbol_rate": F.col("n_symbols") / per_char, "bang_rate": F.col("_bangs") / per_word, "upper_rate": F.col("_upper") / per_char,
        "repeat_rate": F.col("n_repeat_words") / per_word, "next_rate": F.col("_next") / per_word,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
    }).drop("_w", "_h", "_lines", "_n_lines", "_next", "_upper", "_bangs")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">=" or "<"
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.op == ">=" else F.col(self.feature) < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, none keeps."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def verdict(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(False)).otherwise(out)
        return out

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.feature} {c.op} {c.threshold:.6g}" for c in rule) + " -> reject" for rule in self.rules] + ["else keep"]


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


@dataclass(frozen=True)
class CoveringConfig:
    """max_rows bounds the labelled sample (by hash of the id) that the list is learned from, whatever the input."""

    max_rows: int = 20_000
    bins: int = 40
    max_rules: int = 8
    max_conditions: int = 3
    least_precision: float = 0.9
    least_support: int = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, doc_id: str = "doc_id") -> DataFrame:
    """docs with the column `label`, of about max_rows labelled ids at most, chosen by a hash of the id.

    The kept ids are a bounded table (16 bytes a row), so it is broadcast and the texts are never shuffled.
    Repeated labels of one id count once (the least label holds).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    n = known.count()
    share = 1_000_000 if n <= max_rows else max(1, int(1_000_000 * max_rows / n))
    kept = known.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1_000_000)) < share).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
    return docs.drop(label).join(F.broadcast(kept), F.col(doc_id) == F.col("_id")).withColumnRenamed("_label", label).drop("_id")


def learn_decision_list(stats: DataFrame, label: str = "quality", config: CoveringConfig = CoveringConfig(), doc_id: str = "doc_id") -> DecisionList:
    """Sequential covering over labelled statistics: stats has FEATURES, doc_id and the label (0: reject).

    Each step is one aggregate of counts by feature, bin and fold (a few hundred rows reach the driver). A rule grows by
    the condition of most FOIL gain on the grow fold, loses trailing conditions while the prune fold's (p - n)/(p + n)
    doesn't fall, and is taken if precise there; what it covers is set aside for the next.
    """
    # thresholds are quantiles within either class, so that a kind of few documents has some of its own
    at, bad = [(i + 0.5) / config.bins for i in range(config.bins)], F.col(label) == 0
    row = stats.agg(*(F.percentile_approx(F.when(bad == of, F.col(f)), at, 10_000).alias(f"{f}_{of}") for f in FEATURES for of in (True, False))).first()
    cuts = {f: sorted({*(row[f"{f}_True"] or ()), *(row[f"{f}_False"] or ())}) for f in FEATURES}
    binned = stats.select(
        (F.col(label) == 0).alias("_bad"), (F.pmod(F.xxhash64(F.col(doc_id), F.lit(5)), F.lit(3)) == 0).alias("_prune"),
        *(_bin(F.col(f), cuts[f]).alias(f) for f in FEATURES),
    )
    binned = materialise(binned, "rule-bins")

    def counts(rule: list[tuple[str, str, int]], done: list[list[tuple[str, str, int]]]) -> dict:
        left = binned
        for r in done:
            left = left.where(~_bins(r))
        left = left.where(_bins(rule))
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES))).alias("x")
        table: dict = {}
        for x in left.select("_bad", "_prune", pairs).groupBy("x.f", "x.b", "_prune").agg(F.count_if("_bad").alias("p"), F.count_if(~F.col("_bad")).alias("n")).collect():
            table[x["f"], x["b"], x["_prune"]] = (x["p"], x["n"])
        return table

    def held(table: dict, prune: bool) -> tuple[int, int]:
        at = [v for (f, _, q), v in table.items() if f == FEATURES[0] and q == prune]
        return sum(p for p, _ in at), sum(n for _, n in at)

    def worth(p: int, n: int) -> float:
        return (p - n) / (p + n) if p + n else -1.0

    import math

    done: list[list[tuple[str, str, int]]] = []
    while len(done) < config.max_rules:
        rule: list[tuple[str, str, int]] = []
        table = counts(rule, done)
        p, n = held(table, False)
        if p < config.least_support:
            break
        worths = []
        precise = (0, 0)
        while len(rule) < config.max_conditions and n:
            best = None
            for f in FEATURES:
                for k in range(1, len(cuts[f]) + 1):
                    for op in (">=", "<"):
                        inside = [v for (g, b, q), v in table.items() if g == f and not q and ((b >= k) == (op == ">="))]
                        cp, cn = sum(x for x, _ in inside), sum(y for _, y in inside)
                        if cp < config.least_support:
                            continue
                        gain = cp * (math.log2(cp / (cp + cn)) - math.log2(p / (p + n)))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, (f, op, k))
            if best is None:
                break
            rule.append(best[1])
            table = counts(rule, done)
            p, n = held(table, False)
            precise = held(table, True)
            worths.append((worth(*precise), precise, (p, n)))
        if not rule:
            break
        while len(rule) > 1 and worths[-2][0] >= worths[-1][0]:
            rule.pop()
            worths.pop()
        _, (hp, hn), (gp, gn) = worths[-1]
        if (hp + gp) < config.least_precision * (hp + gp + hn + gn) or (hp + hn and hp < (config.least_precision - 0.1) * (hp + hn)):
            break
        done.append(rule)
    return DecisionList(tuple(tuple(Condition(f, op, cuts[f][k - 1]) for f, op, k in rule) for rule in done))


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts the value has reached."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= value)) if cuts else F.lit(0)


def _bins(rule: list[tuple[str, str, int]]) -> Column:
    out = F.lit(True)
    for f, op, k in rule:
        out = out & (F.col(f) >= k if op == ">=" else F.col(f) < k)
    return out


def fit(docs: DataFrame, labels: DataFrame, config: CoveringConfig = CoveringConfig(), doc_id: str = "doc_id", text: str = "text") -> DecisionList:
    sample = labelled_sample(docs.select(doc_id, text), labels, "quality", config.max_rows, doc_id)
    stats = materialise(text_statistics(sample, text).drop(text), "rule-stats")
    return learn_decision_list(stats, "quality", config, doc_id)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs with the statistics, base_failed and kept; one narrow stage."""
    out = text_statistics(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.verdict()))
