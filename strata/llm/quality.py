"""Quality rules as a learned decision list (operator 4).

``text_stats`` measures every whole text (one Arrow pass, no shuffle).
``learn`` runs sequential covering on labelled statistics: each rule is a
conjunction of thresholds, grown by information gain on two thirds of the
labelled rows, pruned back on the remaining third, kept only if it is precise
there, and then the rows it covers leave both parts.  ``verdict`` turns the
ordered rules into one Spark conditional expression, so applying the list is a
projection.

Defined results: NULL or empty text has no words (all counts 0) and fails the
base rule; repeated rows are measured alike; an empty table gives no rows;
without usable labels the list is empty and only the base rule rejects.
Labels: NULL labels are ignored, several labels of one document are averaged
(a tie counts as good).  The learner sees at most ``max_labelled`` labelled
rows, those with the smallest hash of doc_id (the only bound; every other
figure covers all rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import textcols as X
from strata.llm.shared import fresh

#: Base figures, then what the learner may use besides.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks", "longest_word"]
STATS = BASE + MORE
MAX_LABELLED = 50_000
_BATCH = 1 << 20


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.int64)
    t[[ord(c) for c in chars]] = 1
    return t


_SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _table("0123456789")
_MARKS = _table("!?")
_STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)], dtype=np.int64)


def _per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of per-byte ``values`` over each row."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[off[1:]] - total[off[:-1]]


def _dup_lines(buf: np.ndarray, off: np.ndarray, nonspace: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines that have a word, and those among them equal to an earlier one."""
    n = len(off) - 1
    breaks = np.flatnonzero(buf == 10)
    start = np.concatenate((off[:-1], breaks + 1))
    row = np.concatenate((np.arange(n), np.searchsorted(off, breaks, side="right") - 1))
    order = np.argsort(row, kind="stable")
    start, row = start[order], row[order]
    # a line ends at the next line's start less its break, or at the end of its row
    end = np.where(np.append(row[1:] == row[:-1], False), np.append(start[1:] - 1, 0), off[1:][row])
    seen = np.concatenate(([0], np.cumsum(nonspace)))
    has = seen[end] > seen[start]
    start, end, row = start[has], end[has], row[has]
    raw = buf.tobytes()
    fp = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())),
                     np.uint64, len(start))
    order = np.lexsort((fp, row))
    again = np.zeros(len(fp), dtype=bool)
    again[1:] = (fp[order][1:] == fp[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row, minlength=n), np.bincount(row[order][again], minlength=n)


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every row of a text buffer."""
    n = len(off) - 1
    start, end, row = X.words(buf, off)
    n_words = np.bincount(row, minlength=n)
    nonspace = np.zeros(len(buf), dtype=np.int64)
    nonspace[X.ragged(start, end - start)] = 1
    starts = _STARTS[buf]
    fp = X.fingerprints(buf, start, end)
    # distinct words per row
    key = X.mix(fp, row.astype(np.uint64))
    ordered = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (fp[ordered][1:] != fp[ordered][:-1]) | (row[ordered][1:] != row[ordered][:-1])
    distinct = np.bincount(row[ordered][new], minlength=n)
    # words inside a 3-word window that the row holds twice or more
    repeated = np.zeros(len(row), dtype=bool)
    if len(row) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        tri = X.mix(X.mix(fp[at], fp[at + 1]), fp[at + 2])
        key = X.mix(tri, row[at].astype(np.uint64))
        ordered = np.argsort(key)
        same = (tri[ordered][1:] == tri[ordered][:-1]) & (row[at][ordered][1:] == row[at][ordered][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[ordered[1:][same]] = True
        twice[ordered[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    lines, dup = _dup_lines(buf, off, nonspace)
    length = np.zeros(n, dtype=np.int64)
    np.maximum.at(length, row, end - start)
    return {"n_words": n_words, "word_chars": _per_row(starts * nonspace, off), "n_symbols": _per_row(_SYMBOLS[buf], off),
            "n_dup_lines": dup, "n_repeat_words": np.bincount(row[repeated], minlength=n),
            "n_chars": _per_row(starts, off), "n_lines": lines, "n_distinct_words": distinct,
            "n_upper": _per_row(_UPPER[buf], off), "n_digits": _per_row(_DIGITS[buf], off),
            "n_marks": _per_row(_MARKS[buf], off), "longest_word": length}


def text_stats(df: DataFrame, text: str = "text", names: list[str] | None = None) -> DataFrame:
    """``df`` with the statistics of ``text`` appended under ``names`` (default: STATS)."""
    names = names or STATS

    def run(batches):
        for b in X.batches_of(batches, text, _BATCH):
            got = measure(*X.text_buffer(b.column(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(got[s].astype(np.int64)) for s in STATS)],
                                             [*b.schema.names, *names])

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    return df.mapInArrow(X.lean(run), schema)


def base_failed(names: dict[str, str] | None = None) -> Column:
    """Fewer than 50 words, or over half of them inside repeated 3-word windows."""
    c = names or {s: s for s in STATS}
    return (F.col(c["n_words"]) < 50) | (100 * F.col(c["n_repeat_words"]) > 50 * F.col(c["n_words"]))


#: Features of the rules: name -> (numerator, denominator) over the statistics.
FEATURES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"), "upper_share": ("n_upper", "n_chars"),
    "digit_share": ("n_digits", "n_chars"), "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"), "longest_word": ("longest_word", None),
}


def feature(name: str, names: dict[str, str] | None = None) -> Column:
    c = names or {s: s for s in STATS}
    a, b = FEATURES[name]
    if b is None:
        return F.col(c[a]).cast("double")
    return F.when(F.col(c[b]) > 0, F.col(c[a]) / F.col(c[b])).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self, names=None) -> Column:
        f = feature(self.feature, names)
        return f > self.value if self.above else f <= self.value

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value


@dataclass
class Rule:
    """Reject where every condition holds; figures are those on the pruning rows."""

    conditions: list[Condition]
    covered: int = 0
    precision: float = 0.0

    def column(self, names=None) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(names)
        return out

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for c in self.conditions:
            out &= c.mask(x)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.feature} {'>' if c.above else '<='} {c.value:g}" for c in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def keeps(self, names: dict[str, str] | None = None) -> Column:
        """false for the first rule that holds, else true."""
        out = None
        for r in self.rules:
            out = F.when(r.column(names), F.lit(False)) if out is None else out.when(r.column(names), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of covering p bad and n good rows of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, 0.0)


def _best(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of the largest gain over the live rows, halfway between two values."""
    best, cond = 0.0, None
    p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
    for name, values in x.items():
        v = values[live]
        order = np.argsort(v, kind="stable")
        sv, sb = v[order], bad[live][order]
        cut = np.flatnonzero(sv[1:] > sv[:-1])
        if not len(cut):
            continue
        p_low, n_low = np.cumsum(sb)[cut], np.cumsum(~sb)[cut]
        for above, g in ((False, _gain(p_low, n_low, p0, n0)), (True, _gain(p0 - p_low, n0 - n_low, p0, n0))):
            k = int(np.argmax(g))
            if g[k] > best + 1e-9:
                best, cond = float(g[k]), Condition(name, above, float((sv[cut[k]] + sv[cut[k] + 1]) / 2))
    return best, cond


def cover(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, max_rules: int = 16, max_conditions: int = 4,
          min_precision: float = 0.9, min_covered: int = 5) -> DecisionList:
    """Sequential covering over a labelled sample; ``grow`` marks the rows for growing, the rest prune."""
    out = DecisionList()
    left = np.ones(len(bad), dtype=bool)
    while len(out.rules) < max_rules:
        live, conditions = left & grow, []
        while len(conditions) < max_conditions and bad[live].any() and (~bad[live]).any():
            _, c = _best(x, bad, live)
            if c is None:
                break
            conditions.append(c)
            live = live & c.mask(x)
        if not conditions:
            break
        # prune: the prefix of the conjunction with the best (p - n) / (p + n) on the other rows
        best, keep = -2.0, 0
        for k in range(1, len(conditions) + 1):
            m = Rule(conditions[:k]).mask(x) & left & ~grow
            p, n = int(bad[m].sum()), int((~bad[m]).sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if worth > best + 1e-12:
                best, keep = worth, k
        rule = Rule(conditions[:keep])
        m = rule.mask(x) & left
        held = m & ~grow
        rule.covered, rule.precision = int(held.sum()), float(bad[held].mean()) if held.any() else 0.0
        if rule.covered < min_covered or rule.precision < min_precision:
            break
        out.rules.append(rule)
        left &= ~m
    return out


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
          max_labelled: int = MAX_LABELLED, **limits) -> DecisionList:
    """Learn a list from ``stats`` (key and STATS) and ``labels`` (key, label: 1 good, 0 bad).

    Only rows that pass the base rule are used, since the list is asked for
    no others.
    """
    lab = labels.groupBy(F.col(key).alias("__key")).agg(F.avg(F.col(label).cast("double")).alias("__y")).where("__y is not null")
    rows = stats.where(~base_failed()).join(lab, stats[key] == F.col("__key"))
    rows = rows.select(F.xxhash64(key).alias("__h"), (F.col("__y") < 0.5).alias("__bad"), *[feature(f).alias(f) for f in FEATURES])
    got = rows.orderBy("__h", *FEATURES).limit(max_labelled).toPandas()
    if not len(got):
        return DecisionList()
    x = {f: got[f].to_numpy(dtype=float) for f in FEATURES}
    grow = (got["__h"].to_numpy() // 7) % 3 != 0
    return cover(x, got["__bad"].to_numpy(dtype=bool), grow, **limits)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> tuple[DataFrame, DecisionList]:
    """(one row per document with STATS, base_failed, kept; the learned list)."""
    from strata.llm.shared import written

    stats = text_stats(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", *STATS)
    stats = written(stats, "quality")
    rules = learn(stats, labels.withColumnRenamed(key, "doc_id"), **limits)
    return judge(stats, rules), rules


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Statistics of the labelled rows with the smallest key hashes, at least those ``learn`` would choose.

    Labels are taken in the order of their hash, four times as many when too
    few of their documents pass the base rule, in the end all of them.
    """
    from strata.functions.joins import join_small
    from strata.llm.shared import written

    key = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    keys = labels.where("quality is not null and doc_id is not null").select(key.alias("doc_id")).distinct()
    n, take = keys.count(), 4 * max_labelled
    while True:
        some = keys if take >= n else keys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(take)
        rows = join_small(docs.select("doc_id", "text"), some, "doc_id", "left_semi", rows=min(take, n))
        stats = written(text_stats(rows).select("doc_id", *STATS), "labelled")
        if take >= n or stats.where(~base_failed()).count() >= max_labelled:
            return stats
        take *= 4


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **limits) -> DataFrame:
    """The rows of ``docs`` (all columns unchanged) that base rule and list keep."""
    rules = learn(_labelled(docs, labels, max_labelled), labels, max_labelled=max_labelled, **limits)
    names = dict(zip(STATS, fresh(docs, *STATS)))
    with_stats = text_stats(docs, "text", list(names.values()))
    return with_stats.where(~base_failed(names) & rules.keeps(names)).select(*docs.columns)
