"""Quality rules: decision lists learned by sequential covering, run as Spark conditional expressions.

Statistics of a text are built-in functions on its row. A list is learned from labelled
statistics: each rule is grown, one threshold condition at a time, on two thirds of the rows to
be covered, pruned on the rest, and its rows are removed; learning ends when no rule is precise
enough. The list becomes one CASE expression whose first true rule decides.

Defined cases: null text has no words and fails the base rules; so do empty texts; ties in learning go to the
first statistic by name, then the least threshold; unlabelled or null labels are not learned
from; of contrary labels of a doc_id the lower counts, of texts that share one the one of the least hash; with no label of
either kind the list is empty and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, one_text

#: At most so many labelled documents, those of the least hash of doc_id, are learned from.
SAMPLE = 4000
SYMBOLS = "#*$%&|<>"

FEATURES = ("caps_share", "dup_line_share", "mark_share", "mean_word_chars", "repeat_share", "symbol_share")


def _occurrences(text: Column, one: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(one), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, also where lambdas in the body refer to it.

    A column that a lambda refers to may be inlined by the optimizer and computed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics added; nothing is shuffled.

    Words repeated in 3-word windows are found by sorting each text's (window hash, position) pairs, so a text of
    n words costs n log n.
    """
    x = docs.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    spaced = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), WHITE, F.col("__t"))
    x = x.withColumn("__w", F.array_remove(F.split(spaced, " "), ""))
    x = x.withColumn("n_words", F.size("__w").cast("long"))
    x = x.withColumn("word_chars", F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long"))
    x = x.withColumn("n_symbols", reduce(lambda a, b: a + b, [_occurrences(F.col("__t"), s) for s in SYMBOLS]).cast("long"))
    lines = F.filter(F.split("__t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    x = x.withColumn("n_dup_lines", F.when(F.instr("__t", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long"))
    windows = let(F.col("__w"), lambda ws: F.transform(
        F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))))
    x = x.withColumn("__g", F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    pairs = F.expr("array_sort(transform(__g, (h, i) -> struct(h, i)))")
    x = x.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), pairs))
    twice = let(F.col("__s"), lambda s: F.filter(s, lambda p, k: F.coalesce(p["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get(s, k + 1)["h"], F.lit(False))))
    x = x.withColumn("__d", F.when(F.col("__s").isNotNull(), twice))
    places = F.expr("size(array_distinct(flatten(transform(__d, p -> array(p.i, p.i + 1, p.i + 2)))))")
    x = x.withColumn("n_repeat_words", F.when(F.col("__d").isNotNull(), places).otherwise(0).cast("long"))
    # Words wholly upper case but for marks: capitals are counted as characters that lower-casing changes.
    letters = F.regexp_replace("__t", r"[^\p{Lu}]+", "")
    x = x.withColumn("n_capitals", F.length(letters).cast("long"))
    x = x.withColumn("n_marks", (_occurrences(F.col("__t"), "!") + _occurrences(F.col("__t"), "?")).cast("long"))
    per = lambda a, b: F.try_divide(F.col(a), F.col(b).cast("double"))
    x = x.withColumns({
        "symbol_share": F.coalesce(per("n_symbols", "word_chars"), F.lit(0.0)),
        "caps_share": F.coalesce(per("n_capitals", "word_chars"), F.lit(0.0)),
        "mark_share": F.coalesce(per("n_marks", "word_chars"), F.lit(0.0)),
        "mean_word_chars": F.coalesce(per("word_chars", "n_words"), F.lit(0.0)),
        "repeat_share": F.coalesce(per("n_repeat_words", "n_words"), F.lit(0.0)),
        "dup_line_share": F.coalesce(F.try_divide(F.col("n_dup_lines"), F.size(F.split("__t", "\n")).cast("double")), F.lit(0.0)),
    })
    return x.drop("__t", "__w", "__g", "__s", "__d")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _candidates(rows: list[dict], feature: str) -> list[float]:
    values = sorted({r[feature] for r in rows})
    if len(values) > 64:
        values = [values[k * (len(values) - 1) // 63] for k in range(64)]
    return sorted({(a + b) / 2 for a, b in zip(values, values[1:])})


def learn(rows: list[dict], features: tuple[str, ...] = FEATURES, target: int = 0, min_precision: float = 0.9,
          min_cover: int = 4, max_conditions: int = 3, max_rules: int = 12) -> list[Rule]:
    """The decision list that names rows whose label is ``target``. rows: statistics with ``label``; order decides nothing."""
    rows = sorted(rows, key=lambda r: (r["label"], *(r[f] for f in features)))
    left, rules = rows, []
    while len(rules) < max_rules and any(r["label"] == target for r in left):
        grow = [r for k, r in enumerate(left) if k % 3]
        prune = [r for k, r in enumerate(left) if k % 3 == 0]
        rule: Rule = ()
        inside = grow
        while len(rule) < max_conditions and any(r["label"] != target for r in inside):
            base = sum(r["label"] == target for r in inside)
            best = None
            for f in features:
                for t in _candidates(inside, f):
                    for above in (True, False):
                        c = Condition(f, above, t)
                        got = [r["label"] == target for r in inside if c.holds(r)]
                        p = sum(got)
                        if p >= min_cover // 2 + 1 and len(got) < len(inside):
                            # Gain in smoothed precision, weighted by what is kept of the target.
                            score = ((p + 1) / (len(got) + 2) - (base + 1) / (len(inside) + 2)) * p
                            if best is None or score > best[0] + 1e-12:
                                best = (score, c)
            if best is None or best[0] <= 0:
                break
            rule += (best[1],)
            inside = [r for r in inside if best[1].holds(r)]
        # Pruning: the shortest beginning of the rule whose smoothed precision on the other rows is the best.
        def worth(rule: Rule) -> float:
            got = [r["label"] == target for r in prune if covers(rule, r)]
            return (sum(got) - (len(got) - sum(got))) / (len(got) + 1)

        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        if not cuts:
            break
        rule = max(cuts, key=lambda r: (round(worth(r), 9), -len(r)))
        got = [r["label"] == target for r in left if covers(rule, r)]
        if len(got) < min_cover or sum(got) / len(got) < min_precision:
            break
        rules.append(rule)
        left = [r for r in left if not covers(rule, r)]
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list as one conditional expression: true where no rule rejects."""
    if not rules:
        return F.lit(True)
    first, *rest = [reduce(lambda a, b: a & b, [c.column() for c in rule]) for rule in rules]
    case = F.when(first, F.lit(False))
    for r in rest:
        case = case.when(r, F.lit(False))
    return case.otherwise(F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """Statistics and quality of at most ``sample`` labelled rows. The bound makes the broadcast and the collection small."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label is not null")
    picked = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    mine = one_text(docs, picked)
    # Texts that the base rules reject, such as very short ones, teach nothing to the list.
    return [r.asDict() for r in statistics(mine).filter(~base_failed()).select("label", *FEATURES).collect()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with the statistics, base_failed and kept."""
    x = statistics(docs).withColumn("base_failed", base_failed())
    return x.withColumn("kept", ~F.col("base_failed") & as_column(rules))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and the statistics and verdicts of every row."""
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judged(clean, learn(labelled(clean, labels))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rules = learn(labelled(docs.select("doc_id", "text"), labels))
    x = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    # A filter moves below the statistics, with a copy of them for each use, unless its column depends on a row's place.
    kept = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return judged(x, rules).select("row", kept.alias("kept")).filter("kept").select("row.*")
