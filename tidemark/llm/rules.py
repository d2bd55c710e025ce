"""Quality rules as weak supervision, in DataFrame functions only.

Every rule looks at a few measures of a whole text and votes +1 (good), -1 (bad) or 0 (abstains).
Expectation-maximisation estimates, from the agreement of the rules alone, how often each rule is right on
good and on bad texts and the share of good ones.  The posterior probability of a good text replaces the
demand that every rule passes: one noisy rule cannot remove a document that the others find fine.

Bad texts are bad in different ways, and a rule looks for one of them.  So the hidden class is good
or one of the fault ``KINDS``, each with its own chance that a rule votes against the text.  Texts with
the same votes are alike to the model, so it is fitted to the counts of vote patterns, at most
3 ** len(RULES) rows however large the corpus is; they are counts of all documents.  An abstention
says nothing about the class.  Beta priors with the weight of a few votes keep rules that hardly ever
vote near their starting accuracy.  Bounds (right on good texts in 0.9 or more of the votes, on a fault
of the rule's own kind in one half or more) keep the classes from changing places.

Results of odd cases: null text has no words; texts under ten words or with over a fifth of their
words in repeated windows fail by contract whatever the posterior; with no documents the model is
the prior.  Rows that repeat others get equal results, and so do null keys.  ``judged`` keeps all columns
and adds one struct column, replacing one of that name as ``withColumn`` does.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

WINDOW = 5
SPACE = " \t\n\x0b\x0c\r"
SIGNS = r"[#*$%&|<>]"
GAP = r"[ \t\n\x0B\f\r]+"
ROUNDS = 30
TOLERANCE = 1e-3
PRIOR_GOOD = 0.85  # start of the share of good texts
AGAINST = {"good": 0.03, "own": 0.8, "other": 0.1}  # starting chance of a vote against the text
BOUNDS = {"good": (0.001, 0.1), "own": (0.5, 0.999), "other": (0.001, 0.9)}
PRIOR_VOTES = 20.0  # weight of the starting values
KEEP_FROM = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_distinct", "n_capitals", "n_marks", "n_shouts", "n_bare")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more.

    Hashes of the windows tell in one pass that nothing is repeated, which holds for most texts.
    Otherwise windows with a hash that occurs again are compared themselves, so equal hashes of
    different windows do no harm.
    """
    starts = F.sequence(F.lit(0), F.size(words) - size)

    def parts(i):
        return [F.get(words, i + k) for k in range(size)]

    def repeated(places, name):
        """Those of the sorted places whose name occurs again."""
        def neighbours(rows):
            def equal(k):
                own = F.get(rows, k).getField("w")
                return F.coalesce(own == F.get(rows, k - 1).getField("w"), F.lit(False)) | F.coalesce(
                    own == F.get(rows, k + 1).getField("w"), F.lit(False))
            return F.sort_array(F.transform(
                F.filter(F.sequence(F.lit(0), F.size(rows) - 1), equal),
                lambda k: F.get(rows, k).getField("at")))
        named = F.sort_array(F.transform(places, lambda i: F.struct(name(i).alias("w"), i.alias("at"))))
        return F.when(F.size(places) == 0, places).otherwise(let(named, neighbours))

    def covered(places):
        # each window adds the words up to the next one, the last adds all of its own
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 1), F.lit(0),
            lambda n, k: n + F.least(F.lit(size), F.coalesce(
                F.get(places, k + 1) - F.get(places, k), F.lit(size)))))

    def count(marks):
        exact = let(repeated(starts, lambda i: F.get(marks, i)),
                    lambda some: let(repeated(some, lambda i: F.concat_ws(" ", *parts(i))), covered))
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), 0).otherwise(exact)

    return F.when(F.size(words) < size, 0).otherwise(
        let(F.transform(starts, lambda i: F.xxhash64(*parts(i))), count))


def measured(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """``docs`` with the struct ``into`` of all counts, from whole texts, without a shuffle."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(body, GAP, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(SIGNS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            F.regexp_count(body, F.lit(r"[.?!…。][\"')\]]*(?=\s|$)")).cast("long").alias("n_marks"),
            F.regexp_count(body, F.lit("!!")).cast("long").alias("n_shouts"),
            F.regexp_count(body, F.lit(r"[^\p{L}\p{N}\s.,;:!?'-](?=\s|$)")).cast("long").alias("n_bare"))

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return docs.withColumn(into, let(words_of(body), lambda w: let(lines, lambda x: counts(w, x))))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes_of(m: Callable[[str], Column]) -> Column:
    """The votes of ``RULES``, an array; ``m`` gives a measure by name.  Short texts make most rules
    abstain."""
    n = m("n_words")
    chars, lines = m("word_chars"), m("n_lines")
    votes = {
        "length": _vote(n < 10, n >= 30),
        "word_length": _vote((n > 0) & ((chars < 2 * n) | (chars > 15 * n)),
                             (n > 0) & chars.between(3 * n, 11 * n)),
        "symbols": _vote((n > 0) & (10 * m("n_symbols") > n), (n > 0) & (100 * m("n_symbols") <= 2 * n)),
        # words that are or end in signs other than punctuation
        "bare_signs": _vote((n >= 10) & (5 * m("n_bare") > n), (n >= 10) & (50 * m("n_bare") <= n)),
        "line_copies": _vote((lines >= 4) & (100 * m("n_dup_lines") > 30 * lines),
                             (lines >= 4) & (100 * m("n_dup_lines") <= 5 * lines)),
        "word_copies": _vote((n >= 20) & (100 * m("n_repeat_words") > 20 * n),
                             (n >= 20) & (100 * m("n_repeat_words") <= 5 * n)),
        # distinct words grow about with the square root of the length
        "variety": _vote((n >= 30) & (m("n_distinct") * m("n_distinct") < 9 * n),
                         (n >= 30) & (m("n_distinct") * m("n_distinct") >= 16 * n)),
        "capitals": _vote((n >= 5) & (100 * m("n_capitals") > 40 * chars),
                          (n >= 5) & (100 * m("n_capitals") <= 15 * chars)),
        "shouts": _vote((n >= 5) & (20 * m("n_shouts") > n), (n >= 5) & (m("n_shouts") == 0)),
        "sentences": _vote((n >= 30) & ((m("n_marks") * 200 < n) | (m("n_marks") * 2 > n)),
                           (n >= 30) & m("n_marks").between(n / 60, n / 3)),
    }
    return F.array(*[votes[r].cast("tinyint") for r in RULES])


KINDS = {
    "noise": ("word_length", "symbols", "bare_signs"),
    "repetition": ("line_copies", "word_copies", "variety"),
    "shouting": ("capitals", "shouts"),
    "fragments": ("length", "sentences"),
}
RULES = tuple(r for rules in KINDS.values() for r in rules)
CLASSES = ("good", *KINDS)


def role(label: str, rule: str) -> str:
    """What a rule is to a class: see ``AGAINST``."""
    return "good" if label == "good" else "own" if rule in KINDS[label] else "other"


@dataclass(frozen=True)
class LabelModel:
    """Share of each class, and per class and rule the chance that a vote is against the text.

    A rule's accuracy is one minus that chance on good texts and that chance on bad ones.
    """

    share: dict[str, float] = field(default_factory=lambda: {
        c: PRIOR_GOOD if c == "good" else (1 - PRIOR_GOOD) / len(KINDS) for c in CLASSES})
    against: dict[tuple[str, str], float] = field(default_factory=lambda: {
        (c, r): AGAINST[role(c, r)] for c in CLASSES for r in RULES})

    def posteriors(self, votes: Column) -> Column:
        """Array of the probabilities of ``CLASSES`` given the array of the votes of ``RULES``."""
        width = 1 + 3 * len(RULES)
        table = []
        for c in CLASSES:
            table.append(math.log(self.share[c]))
            for r in RULES:
                p = self.against[c, r]
                table += [math.log(p), 0.0, math.log(1 - p)]

        def likelihood(numbers, c):
            return F.aggregate(
                F.sequence(F.lit(0), F.lit(len(RULES) - 1)), F.get(numbers, c * width),
                lambda total, r: total + F.get(numbers, c * width + r * 3 + 2 + F.get(votes, r).cast("int")))

        logs = let(F.array(*map(F.lit, table)), lambda numbers: F.transform(
            F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda c: likelihood(numbers, c)))
        return let(logs, lambda a: let(
            F.transform(a, lambda x: F.exp(x - F.array_max(a))),
            lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y))))

    def distance(self, other: LabelModel) -> float:
        return max(*(abs(self.share[c] - other.share[c]) for c in CLASSES),
                   *(abs(p - other.against[k]) for k, p in self.against.items()))


def patterns_of(measures: DataFrame, into: str = "measures") -> DataFrame:
    """Vote patterns and how many documents have each; folded in the map tasks, so one small file
    holds them."""
    return measures.select(votes_of(lambda name: F.col(into).getField(name)).alias("votes")).groupBy(
        "votes").agg(F.count("*").alias("n")).repartition(1)


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over a stored table of patterns; one row per class and rule per round."""
    start = model = LabelModel()
    patterns = patterns.coalesce(1)  # a few thousand rows at most, so rounds need no shuffle
    for _ in range(rounds):
        cells = patterns.select("n", "votes", F.posexplode(model.posteriors(F.col("votes"))).alias("c", "p")
                                ).select((F.col("n") * F.col("p")).alias("w"), "c",
                                         F.posexplode("votes").alias("r", "vote"))
        sums = {(CLASSES[row.c], RULES[row.r]): row for row in cells.groupBy("c", "r").agg(
            F.sum("w").alias("all"),
            F.sum(F.when(F.col("vote") < 0, F.col("w")).otherwise(0.0)).alias("against"),
            F.sum(F.when(F.col("vote") > 0, F.col("w")).otherwise(0.0)).alias("for")).collect()}
        if not sums:
            return model
        sizes = {c: sums[c, RULES[0]]["all"] for c in CLASSES}
        total = sum(sizes.values())

        def against(c, r):
            yes, no = sums[c, r]["against"], sums[c, r]["for"]
            rate = (yes + start.against[c, r] * PRIOR_VOTES) / (yes + no + PRIOR_VOTES)
            low, high = BOUNDS[role(c, r)]
            return round(min(max(rate, low), high), 9)

        new = LabelModel({c: round((sizes[c] + start.share[c] * PRIOR_VOTES) / (total + PRIOR_VOTES), 12)
                          for c in CLASSES},
                         {(c, r): against(c, r) for c in CLASSES for r in RULES})
        done = new.distance(model) < TOLERANCE
        model = new
        if done:
            break
    return model


def verdict(model: LabelModel, m: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """(base_failed, posterior, kept)."""
    failed = (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))
    posterior = F.get(let(votes_of(m), lambda v: model.posteriors(v)), F.lit(0))
    return failed, posterior, ~failed & (posterior >= KEEP_FROM)


def learn(docs: DataFrame, text: str = "text") -> LabelModel:
    """The label model of all documents."""
    narrow = measured(docs.select(F.col(f"`{text}`").alias("text"))).select("measures")
    return fit(stored(patterns_of(narrow), "rule-patterns"))


def judged(docs: DataFrame, model: LabelModel, text: str = "text", into: str = "rules") -> DataFrame:
    """``docs`` with the struct ``into``: the counts, base_failed, posterior and kept."""
    made = measured(docs, text, into)

    def m(name):
        return F.col(f"`{into}`").getField(name)
    failed, posterior, kept = verdict(model, m)
    return made.withColumn(into, F.struct(
        *[m(c).alias(c) for c in (*COUNTS, *EXTRA)], failed.alias("base_failed"),
        posterior.alias("posterior"), kept.alias("kept")))


def rules_report(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, posterior and verdict of every document; texts are read once."""
    narrow = stored(measured(docs.select("doc_id", "text")).select("doc_id", "measures"), "rule-measures")
    model = fit(stored(patterns_of(narrow), "rule-patterns"))

    def m(name):
        return F.col("measures").getField(name)
    failed, posterior, kept = verdict(model, m)
    return narrow.select("doc_id", *[m(c).alias(c) for c in COUNTS], failed.alias("base_failed"),
                         kept.alias("kept"), posterior.alias("posterior"))


def brute_force(text: str | None) -> tuple[int, ...]:
    """The contract's counts by plain lists, for tests."""
    text = text or ""
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen: dict[tuple, list[int]] = {}
    for k in range(len(words) - WINDOW + 1):
        seen.setdefault(tuple(words[k:k + WINDOW]), []).append(k)
    hit = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(WINDOW)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit))


RULES_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
pos as (select doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] as win, i
        from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select doc_id, unnest(list(i)) as i from pos group by doc_id, win having count(*) > 1),
gap as (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as g from rep),
cov as (select doc_id, sum(g) as n from gap group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
       (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
from w left join cov on w.doc_id = cov.doc_id
"""
