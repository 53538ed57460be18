"""Quality rules as a learned decision list.

Every text becomes a few counts of its form, and Spark makes ratios of them. From the counts
of labelled texts, sequential covering learns one conjunction of thresholds after another:
a rule grows, condition by condition, on one part of the rows as long as it gains, loses its
last conditions again where that is better on the other part, and takes away the rows that it
covers. The rules in their order are one conditional expression over columns, so that the
verdict needs no Python and can be read, printed and changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import AS_WRITTEN, held_out, mix, per_text, sample_ids, text_of, word_hashes

#: What white space is, and the kinds of bytes that are counted.
_SPACE = " \t\n\v\f\r"
_KINDS = {"space": _SPACE, "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "bar": "|", "symbol": "#*$%&<>", "bang": "!", "point": ".?", "comma": ",;:", "bracket": "()[]{}"}
_NAMES = ["plain", "inner", *_KINDS]
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:0xC0] = 1  # bytes within a code point
for _k, _letters in enumerate(_KINDS.values()):
    _CLASS[[ord(c) for c in _letters]] = _k + 2

#: Counts of a text, whole numbers.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_next_words", "n_upper", "n_digits", "n_bars", "n_bangs", "n_points", "n_commas", "n_brackets"]
#: Ratios of counts, zero where the divisor is: what rules put thresholds on, besides n_words.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"), "next_share": ("n_next_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "bars_per_word": ("n_bars", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"), "points_per_word": ("n_points", "n_words"), "commas_per_word": ("n_commas", "n_words"), "brackets_per_word": ("n_brackets", "n_words"),
}
FEATURES = ["n_words", *RATIOS]


# --- counts -------------------------------------------------------------------------------


def _mark(text: np.ndarray) -> np.ndarray:
    """A hash of a text's number that no word has: words of one letter are hashes of small numbers."""
    return mix(text.astype(np.uint64) + np.uint64(1 << 40))


def repeat_words(words: np.ndarray, starts: np.ndarray, width: int = 3) -> np.ndarray:
    """For the words of several texts, one after another from `starts`, whether each lies in a window of `width` words
    that its text has twice or more."""
    n = len(words)
    out = np.zeros(n, bool)
    if n < width:
        return out
    text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    first = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    h = _mark(text[first])
    for k in range(width):
        h = mix(h + words[first + k])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(width):
        out[first[twice] + k] = True
    return out


def count_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """COUNTS of each text, as arrays."""
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    hashes = list(word_hashes(texts, letters=AS_WRITTEN))
    sizes = np.array([len(h) for h in hashes], np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate([np.empty(0, np.uint64), *hashes])
    text = np.repeat(np.arange(len(texts)), sizes)
    out["n_words"] = sizes
    out["n_repeat_words"] = np.bincount(text[repeat_words(words, starts)], minlength=len(texts))
    out["n_next_words"] = np.bincount(text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])], minlength=len(texts))
    distinct = np.unique(mix(words + _mark(text)), return_index=True)[1]
    out["n_distinct_words"] = np.bincount(text[distinct], minlength=len(texts))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = dict(zip(_NAMES, np.bincount(_CLASS[raw], minlength=len(_NAMES)).tolist(), strict=True))
        out["word_chars"][i] = len(raw) - kinds["inner"] - kinds["space"]
        out["n_symbols"][i] = kinds["symbol"] + kinds["bar"]
        for name, kind in (("n_upper", "upper"), ("n_digits", "digit"), ("n_bars", "bar"), ("n_bangs", "bang"), ("n_points", "point"), ("n_commas", "comma"), ("n_brackets", "bracket")):
            out[name][i] = kinds[kind]
        lines = [x for x in t.split("\n") if x.strip(_SPACE)]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, COUNTS and RATIOS of its whole text. Null text counts as empty: all are zero."""

    def counts(texts: list[str]) -> list:
        return [pa.array(x, pa.int64()) for x in count_texts(texts).values()]

    return with_ratios(per_text(docs, id_col, text_col, ", ".join(f"{name} long" for name in COUNTS), counts))


def with_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns({name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0) for name, (a, b) in RATIOS.items()})


# --- rules --------------------------------------------------------------------------------


@dataclass
class RuleParams:
    """most_rows: bound of the labelled sample. A rule has at most most_conditions, and is taken if it covers at least
    `least` rows that it should and, on the rows kept for pruning, `precision` of what it covers is right."""

    most_rows: int = 20000
    most_rules: int = 24
    most_conditions: int = 4
    least: int = 8
    precision: float = 0.9
    cuts: int = 64
    seed: int = 7


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; right and wrong: rows of the sample that it covers after the rules before it."""

    conditions: tuple[Condition, ...]
    right: int = 0
    wrong: int = 0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Rules in order: the first that holds drops a text; where none holds the text stays."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """The number, from 1, of the first rule that holds; null where none does."""
        out = None
        for i, rule in enumerate(self.rules):
            out = F.when(rule.column(), i + 1) if out is None else out.when(rule.column(), i + 1)
        return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))

    def keeps(self) -> Column:
        return self.fired().isNull()

    def __str__(self) -> str:
        return "\n".join([*(f"{i + 1}. drop if {r} ({r.right} right, {r.wrong} wrong)" for i, r in enumerate(self.rules)), "else keep"])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, params: RuleParams) -> list[Condition]:
    """Conditions, the one of most information gain first, until no good row is covered or none gains."""
    conditions: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < params.most_conditions and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best: tuple[float, Condition | None] = (0.0, None)
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, below = v[order], np.cumsum(b[order])
            ends = np.flatnonzero(v[1:] > v[:-1])  # a threshold may only stand between different values
            if len(ends) > params.cuts:
                ends = np.unique(ends[np.linspace(0, len(ends) - 1, params.cuts).astype(int)])
            if not len(ends):
                continue
            p = below[ends].astype(float)
            n = ends + 1 - p
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    low, high = v[ends[k]], v[ends[k] + 1]
                    best = (float(gain[k]), Condition(name, above, float(low + (high - low) / 2) if np.isfinite(high - low) else float(low)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= best[1].holds(x)
    return conditions


def _prune(conditions: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The leading conditions that do best on rows that did not grow them; the fewest of equals."""

    def worth(k: int) -> float:
        covered = Rule(tuple(conditions[:k])).holds(x)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        return (p - n + 0.0) / (p + n) if p + n else -1.0

    return conditions[: max(range(1, len(conditions) + 1), key=lambda k: (round(worth(k), 9), -k))]


def learn_rules(x: dict[str, np.ndarray], good: np.ndarray, params: RuleParams = RuleParams()) -> DecisionList:
    """Sequential covering of the rows that are not good. One class only, or no row: no rules."""
    bad = ~good.astype(bool)
    turn = np.random.default_rng(params.seed).permutation(len(bad)) % 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < params.most_rules and (left & bad & (turn > 0)).sum() >= params.least:
        side = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        conditions = _grow(*side(left & (turn > 0)), params)
        if not conditions:
            break
        kept, seen = side(left & (turn == 0))
        rule = Rule(tuple(_prune(conditions, kept, seen)))
        covered = rule.holds(kept)
        p, n = int((covered & seen).sum()), int((covered & ~seen).sum())
        whole = rule.holds(x) & left
        right, wrong = int((whole & bad).sum()), int((whole & ~bad).sum())
        if right < params.least or right < params.precision * (right + wrong) or p < params.precision * (p + n):
            break
        rules.append(Rule(rule.conditions, right, wrong))
        left &= ~whole
    return DecisionList(rules)


# --- tables -------------------------------------------------------------------------------


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    """The fixed rules: too few words, or too large a share of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def train_rules(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams(), id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """Learns from at most most_rows labelled rows that are not held out and pass the fixed rules; repeated labels of an
    id count as their largest. Only figures of texts are inputs."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(~held_out("_id") & F.col("quality").isNotNull() & F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    wanted = known.join(F.broadcast(sample_ids(known.select("_id"), params.most_rows)), "_id")
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(wanted), "_id").select(F.struct("_id", "_y").alias("_key"), "_t")
    figures = text_statistics(rows, "_key", "_t").where(~base_failed()).select("_key._id", "_key._y", *FEATURES)
    got = figures.orderBy("_id", *FEATURES).toArrow()  # a row of FEATURES for each of the sample
    x = {name: got.column(name).to_numpy().astype(float) for name in FEATURES}
    return learn_rules(x, got.column("_y").to_numpy() > 0, params)


def apply_rules(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule, held_out.

    Words are runs of bytes other than ASCII white space, letters as written; lines are what
    \\n parts. Every row is judged alone, from its whole text. Null text counts as empty and
    fails the fixed rules, as every text of few words does; `rule` is the number of the learned
    rule that dropped a text which passed them, else null. Ids of any type, null and repeated
    ones pass through; an empty table gives no rows; other columns are ignored.
    """
    out = text_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    out = out.withColumn("rule", F.when(~F.col("base_failed"), rules.fired()))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule", held_out(id_col).alias("held_out"))


def keep_by_rules(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that pass the fixed rules and the list."""
    names = [f.name for f in docs.schema.fields]
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"), text_of(text_col).alias("_t"))
    kept = text_statistics(rows, "_row", "_t").where(~base_failed() & rules.keeps())
    return kept.select(*(F.col("_row")[n].alias(n) for n in names))
