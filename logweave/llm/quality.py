"""Quality by weak supervision: rules vote in grades or abstain, EM weighs them (op 3, native).

Every rule looks at one property of a text.  Defect rules vote bad, weakly or strongly, where they
see their defect and abstain elsewhere (a text without capitals-only lines is not good for that);
support rules vote good, weakly or strongly, or abstain.  The votes of the corpus are counted by
pattern (at most 3^rules patterns, whatever the corpus size) and expectation-maximisation over
those counts estimates how often each rule votes in each grade on good and on bad texts, hence its
accuracy, and the share of good texts.  The estimates are drawn towards a prior by a fixed share, so
that rare defects stay defects in small and large corpora alike.  A document is kept if its
posterior probability of being good is at least one half, and it passes the base conditions: the
same weak defect leaves a text with strong supports and removes one without, and strong supports can
outweigh a strong defect.

The supports ``letters`` and ``closed`` ask for no language.  ``function`` knows words of four
languages only, so its silence counts in EM, where it sets the corpus's texts apart, and carries no
weight in the posterior that decides.

Only built-in functions run: one scan computes the features, which are written once; the
pattern counts are one small aggregate, written as well; all EM steps are one fold over the
pattern table, whose single row, the model, returns to the driver and enters the verdict as literals.

Defined results: null or wordless text has zero counts, fails the base and is not kept; a
repeated 8-word window is recognised by a 64-bit hash of its words; repeated rows and null
doc_ids each keep a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_GAP, materialise

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
STEPS = 40
TOLERANCE = 1e-6
GOOD, BAD = 1, -1
SILENT, WEAK, STRONG = GRADES = (0, 1, 2)
#: How far estimates are drawn towards the prior (by a share, and by so many documents that follow it), and the
#: prior rates of each grade on (good, bad) texts.
PRIOR_SHARE = 0.3
PRIOR_DOCS = 3
PRIOR_GOOD = 0.8
PRIOR = {BAD: ((0.98, 0.0195, 0.0005), (0.55, 0.15, 0.3)), GOOD: ((0.1, 0.25, 0.65), (0.25, 0.3, 0.45))}

#: Frequent function words (English, German, French, Spanish).
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an at not have "
    "der die und das von mit den ist für auf nicht ein eine sich dem des als auch "
    "le la les de des et un une du que qui dans pour par sur est pas au avec "
    "el los las del y en un una que por con para se su es al no").split()


def _spread(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _without(pattern: str) -> Column:
    return F.length(F.regexp_replace("text", pattern, ""))


def _covered(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(sorted_pairs: Column) -> Column:
        def repeated(pair: Column, j: Column) -> Column:
            before = F.get(sorted_pairs, j - 1)["h"].eqNullSafe(pair["h"])
            after = F.get(sorted_pairs, j + 1)["h"].eqNullSafe(pair["h"])
            return before | after

        return F.transform(F.filter(sorted_pairs, repeated), lambda pair: pair["i"])

    ordered = F.sort_array(_spread(pairs, starts))
    first = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW_WORDS).alias("last"))
    return F.aggregate(ordered, first, lambda a, s: F.struct(
        (a["words"] + F.least(F.lit(WINDOW_WORDS), s - a["last"])).alias("words"), s.alias("last")))["words"]


def features(texts: DataFrame) -> DataFrame:
    """``texts(text, ...)`` without the text, with the counts the rules and the base need.

    Feature columns start with ``q_`` so that they meet no column of the input by chance.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = texts.withColumn("text", text).withColumn("q_parts", F.split("text", WORD_GAP, -1))
    # An array of the words; how many pieces the cut gave tells the white space.
    worded = cut.withColumn("q_words", F.array_remove("q_parts", "")).withColumn("q_gaps", F.size("q_parts") - 1)
    n_words = F.size("q_words")
    windows = F.when(n_words >= WINDOW_WORDS, F.transform(
        F.sequence(F.lit(1), n_words - (WINDOW_WORDS - 1)),
        lambda i: F.xxhash64(F.slice("q_words", i, WINDOW_WORDS)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    closed = F.filter("q_lines", lambda line: line.rlike("[.!?:…\"'”»)।॥。！？：」』）۔؟։።၊။][\\x20\\x09-\\x0D]*$"))
    stops = F.filter("q_words", lambda w: w.isin(*FUNCTION_WORDS))
    made = worded.withColumn("q_windows", windows).withColumn("q_lines", lines)
    chars = F.length("text")
    return made.select(
        *[c for c in texts.columns if c != "text"],
        n_words.cast("long").alias("q_n_words"),
        (chars - F.col("q_gaps")).cast("long").alias("q_word_chars"),
        (chars - _without(SYMBOLS)).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), _covered(F.col("q_windows")))
        .otherwise(0).cast("long").alias("q_n_repeat_words"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        F.size(closed).cast("long").alias("q_n_closed"),
        F.size(stops).cast("long").alias("q_n_function"),
        (chars - _without("[\\p{L}\\p{M}]+")).cast("long").alias("q_n_letters"),
        (chars - _without("\\p{Lu}+")).cast("long").alias("q_n_upper"),
        (chars - _without("[!?]+")).cast("long").alias("q_n_marks"))


def base_failed() -> Column:
    return ((F.col("q_n_words") < MIN_WORDS)
            | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words")))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


@dataclass
class Rule:
    """A rule's side, the conditions of its weak and its strong vote, and whether its silence says anything of a text."""

    side: int
    weak: Column
    strong: Column
    silence_counts: bool = True

    def vote(self) -> Column:
        grade = F.when(self.strong, STRONG).when(self.weak, WEAK).otherwise(SILENT)
        return (self.side * grade).cast("int")


def rules() -> dict[str, Rule]:
    symbols, marks = _share("q_n_symbols", "q_n_words"), _share("q_n_marks", "q_n_words")
    repeats, doubled = _share("q_n_repeat_words", "q_n_words"), _share("q_n_dup_lines", "q_n_lines")
    capitals, letters = _share("q_n_upper", "q_word_chars"), _share("q_n_letters", "q_word_chars")
    length, closed = _share("q_word_chars", "q_n_words"), _share("q_n_closed", "q_n_lines")
    function = _share("q_n_function", "q_n_words")
    return {
        "symbols": Rule(BAD, symbols > 0.1, symbols > 0.25),
        "marks": Rule(BAD, marks > 0.15, marks > 0.4),
        "repeats": Rule(BAD, repeats > 0.15, repeats > 0.3),
        "lines": Rule(BAD, doubled > 0.25, doubled > 0.5),
        "capitals": Rule(BAD, capitals > 0.25, capitals > 0.5),
        "length": Rule(BAD, ~length.between(3, 12), ~length.between(2, 14)),
        "letters": Rule(GOOD, letters > 0.7, letters > 0.85),
        "closed": Rule(GOOD, closed >= 0.3, closed >= 0.7),
        "function": Rule(GOOD, function > 0.02, function > 0.08, silence_counts=False),
    }


@dataclass
class Model:
    """P(good), and for each rule how often it votes in each grade on good and on bad texts."""

    sides: dict[str, int]
    good: float
    on_good: dict[str, tuple[float, ...]]
    on_bad: dict[str, tuple[float, ...]]

    @classmethod
    def first(cls, sides: dict[str, int]) -> Model:
        return cls(sides, PRIOR_GOOD, {r: PRIOR[s][0] for r, s in sides.items()}, {r: PRIOR[s][1] for r, s in sides.items()})

    def posterior(self, vote, unheard: frozenset[str] = frozenset()) -> Column:
        """P(good | votes); ``vote(rule)`` is the rule's vote column; ``unheard`` rules' silence carries no weight."""
        logit = F.lit(math.log(self.good / (1 - self.good)))
        for rule in self.sides:
            silent, weak, strong = (math.log(g / b) for g, b in zip(self.on_good[rule], self.on_bad[rule], strict=True))
            grade = F.abs(vote(rule))
            logit = logit + (F.when(grade == STRONG, strong).when(grade == WEAK, weak)
                             .otherwise(0.0 if rule in unheard else silent))
        return 1 / (1 + F.exp(-logit))

    def accuracy(self, rule: str) -> float:
        """Share of a rule's votes that are right."""
        on = (1 - self.good) * sum(self.on_bad[rule][WEAK:]), self.good * sum(self.on_good[rule][WEAK:])
        return on[self.sides[rule] == GOOD] / sum(on)


def estimate(patterns: DataFrame, sides: dict[str, int], steps: int = STEPS) -> Model:
    """EM over ``patterns(<rule>..., n)``; stops when no estimate moves by ``TOLERANCE``.

    One job: the patterns (at most 3^rules of them) become one array, and the steps are a fold whose state is the model.
    """
    first = Model.first(sides)
    slots = [(rule, grade) for rule in sides for grade in GRADES]
    cast = F.array(*[F.when(F.abs(F.col(r)) == g, 1.0).otherwise(0.0) for r, g in slots])
    gathered = patterns.agg(F.sort_array(F.collect_list(
        F.struct(cast.alias("cast"), F.col("n").cast("double").alias("n")))).alias("rows"))

    def flat(rates: dict[str, tuple[float, ...]]) -> Column:
        return F.array(*[F.lit(float(rates[r][g])) for r, g in slots])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def weighed(rows: Column, weight) -> Column:
        """(all, hits): the sum of ``weight(row)``, and for each slot the sum over the rows that voted so."""
        weights = F.transform(rows, lambda x: F.struct(x["cast"].alias("cast"), weight(x).alias("w")))
        zero = F.struct(F.lit(0.0).alias("all"), F.array(*[F.lit(0.0)] * len(slots)).alias("hits"))
        return F.aggregate(weights, zero, lambda a, x: F.struct(
            (a["all"] + x["w"]).alias("all"), F.zip_with(a["hits"], x["cast"], lambda y, c: y + x["w"] * c).alias("hits")))

    def rates(hits: Column, mass: Column, before: Column) -> Column:
        return F.zip_with(hits, before, lambda h, b: F.round(
            (1 - PRIOR_SHARE) * (h + PRIOR_DOCS * b) / (mass + PRIOR_DOCS) + PRIOR_SHARE * b, 12))

    def change(new: Column, old: Column) -> Column:
        return F.array_max(F.zip_with(new, old, lambda x, y: F.abs(x - y)))

    def step(state: Column, rows: Column, counts: Column) -> Column:
        odds = F.struct(F.log(state["good"] / (1 - state["good"])).alias("start"),
                        F.zip_with(state["on_good"], state["on_bad"], lambda g, b: F.log(g / b)).alias("each"))

        def made(sums: Column) -> Column:
            return F.struct(
                F.round((sums["all"] + 1) / (counts["all"] + 2), 12).alias("good"),
                rates(sums["hits"], sums["all"], flat(first.on_good)).alias("on_good"),
                rates(F.zip_with(counts["hits"], sums["hits"], lambda x, y: x - y),
                      counts["all"] - sums["all"], flat(first.on_bad)).alias("on_bad"))

        sums = _spread(odds, lambda o: weighed(rows, lambda x: x["n"] / (
            1 + F.exp(-(o["start"] + total(F.zip_with(o["each"], x["cast"], lambda e, c: e * c)))))))
        return _spread(_spread(sums, made), lambda new: F.struct(
            new["good"].alias("good"), new["on_good"].alias("on_good"), new["on_bad"].alias("on_bad"),
            F.greatest(F.abs(new["good"] - state["good"]), change(new["on_good"], state["on_good"]),
                       change(new["on_bad"], state["on_bad"])).alias("moved")))

    start = F.struct(F.lit(first.good).alias("good"), flat(first.on_good).alias("on_good"),
                     flat(first.on_bad).alias("on_bad"), F.lit(1.0).alias("moved"))

    def fitted(rows: Column) -> Column:
        return _spread(weighed(rows, lambda x: x["n"]), lambda counts: F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), start,
            lambda state, _: F.when(state["moved"] < TOLERANCE, state).otherwise(step(state, rows, counts))))

    got = gathered.select(F.when(F.size("rows") > 0, _spread(F.col("rows"), fitted)).alias("model")).first()["model"]
    if got is None:
        return first

    def by_rule(values: list[float]) -> dict[str, tuple[float, ...]]:
        return {r: tuple(values[k * len(GRADES):(k + 1) * len(GRADES)]) for k, r in enumerate(sides)}

    return Model(sides, got["good"], by_rule(got["on_good"]), by_rule(got["on_bad"]))


def _judged(measured: DataFrame) -> tuple[DataFrame, Model]:
    """``measured`` with its votes (``q_vote_<rule>``), and the model of its corpus."""
    ruled = rules()
    voted = measured.withColumns({f"q_vote_{name}": rule.vote() for name, rule in ruled.items()})
    counted = (voted.where("q_n_words > 0").groupBy(*[F.col(f"q_vote_{name}").alias(name) for name in ruled])
               .agg(F.count(F.lit(1)).alias("n")))
    return voted, estimate(materialise(counted.coalesce(1), "votes"), {name: rule.side for name, rule in ruled.items()})


def _verdict(model: Model) -> tuple[Column, Column]:
    unheard = frozenset(name for name, rule in rules().items() if not rule.silence_counts)
    posterior = model.posterior(lambda r: F.col(f"q_vote_{r}"), unheard)
    quality = F.when(F.col("q_n_words") > 0, posterior).otherwise(F.lit(0.0))
    return quality, ~base_failed() & (quality >= 0.5)


def assess(docs: DataFrame) -> DataFrame:
    """Counts, base decision, posterior quality and verdict of every row of ``docs(doc_id, text)``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voted, model = _judged(materialise(features(narrow), "quality"))
    quality, kept = _verdict(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return voted.select("doc_id", *(F.col(f"q_{n}").alias(n) for n in names), base_failed().alias("base_failed"),
                        kept.alias("kept"), quality.alias("quality"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns unchanged."""
    names = docs.columns
    carried = docs.withColumn("q_row", F.struct(*[F.col(f"`{n}`") for n in names])).select("q_row", "text")
    voted, model = _judged(materialise(features(carried), "quality"))
    return voted.where(_verdict(model)[1]).select(*[F.col("q_row")[n].alias(n) for n in names])
