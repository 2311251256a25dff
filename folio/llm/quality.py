"""Statistics of document texts and a learned rule list that tells prose from the rest.

The statistics are plain column expressions. An ordered rule list is induced from
labelled documents by incremental reduced-error pruning (grow a rule on two thirds
of the rows, prune it on the rest, stop when it no longer helps); its thresholds
become one CASE expression over the statistics.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import examples, responses
from folio.llm.store import bounded_sample, spread

#: Documents from which the rule list is fitted, at most; they are labelled by ``examples`` and only fit the thresholds.
FIT_ROWS = 6000
#: Log-likelihood a trigram by which a text of the sample must fall short of its language's least usual one to be labelled as none.
UNREADABLE = 1.5
#: Share of a rule's covered rows that may be wrong after pruning.
MOST_WRONG = 0.1
#: Splits into growing and pruning rows that may fail in a row before a kind is given up.
TRIES = 12
KINDS = ("junk", "table", "list")
DEFAULT = "prose"

WHITE = r"\s\x{85}\p{Z}"
#: Characters that nobody sees; a text of nothing else is blank.
UNSEEN = r"[\s\p{Z}\p{Cc}\p{Cf}]"
END_MARK = r"[.!?؟。…:;؛،,][\"'”’»)\]*_`]*$"
SENTENCE_END = r"[.!?؟…][\"'”’»)\]*_`]*$"
ENTRY_MARK = r"^(?:[-*+•◦▪‣·–—o]|\[[ xX]\]|[(\[]?(?:\p{Nd}{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)\]:]|\p{Nd}{1,3}(?:\.\p{Nd}{1,3})+\.?|\[\p{Nd}+\])[ \t]+"
LINK_LINE = r"^(?:[-*+•] +)?\[[^\]\n]*\]\([^)\n]*\)$"
LEADERS = r"(?:\.{4,}|…{2,}|(?:\. ){3,}|_{4,})\s*\p{Nd}*$"
INDEX_LINE = r"^[^,\n]{1,60}(?:, ?\p{Nd}+(?:[–-]\p{Nd}+)?)+$"
HEX_LINE = r"^(?:[0-9a-fA-F]{6,8}:?\s+)?(?:[0-9a-fA-F]{2}\s+){6,}[0-9a-fA-F]{2}"

#: Marks in a row behind a word, consonants in a row, and marks or capitals inside a word.
MARK_RUN = r"[\p{L}\p{N}][!?;:/,]{2,}"
CLUSTER = r"(?i)[bcdfghjklmnpqrstvwxz]{5,}"
INNER_MARK = r"\p{L}[.,;!?]\p{L}|\p{Ll}\p{Lu}"

#: Characters of a line beyond which it is no entry (fixed value; a paragraph, not an item of a list).
LONGEST_ENTRY = 300

#: Statistics; of equally good tests the first one named is taken.
NAMES = (
    "hex_share", "odd_char_ratio", "mark_run_share", "cluster_share", "inner_mark_share", "symbol_ratio", "long_word_share", "cell_share", "entry_share", "short_line_share", "distinct_word_share", "words_per_line", "end_punct_share",
    "common_word_share", "digit_ratio", "sentence_share", "mean_word_length", "n_words",
)


def char_share(lines: Column, test) -> Column:
    """Share of the characters of ``lines`` that lie in lines for which ``test`` holds."""
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    held = F.aggregate(F.filter(lines, test), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(total > 0, held / total).otherwise(0.0)


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def words_in(x: Column) -> Column:
    """Words of a trimmed line."""
    return F.length(x) - F.length(F.translate(x, " ", "")) + 1


def is_cells(x: Column) -> Column:
    """A line of three or more cells: bars, tabs, commas or semicolons without space, or wide gaps.

    The plain searches come first: they spare most lines the expressions.
    """
    bars = x.contains("|") & ((F.regexp_count(x, F.lit(r"(?:^|[ \t])\|(?:[ \t]|$)")) >= 2) | x.rlike(r"^\|?[ :|+-]+\|?$"))
    rule = x.contains("--") & x.rlike(r"^[-+=|: ]{5,}$")
    commas = x.contains(",") & ~x.contains(", ") & (F.length(x) - F.length(F.translate(x, ",", "")) >= 2)
    semis = x.contains(";") & ~x.contains("; ") & (F.length(x) - F.length(F.translate(x, ";", "")) >= 2)
    tabs = x.contains("\t") & (F.regexp_count(x, F.lit("\t")) >= 2)
    gaps = x.contains("   ") & (F.regexp_count(x, F.lit(r"\S {3,}(?=\S)")) >= 2)
    letters = lambda: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) * 2 > F.length(F.translate(x, " \t", ""))
    return rule | bars | ((tabs | commas | semis | gaps) & letters())


def is_entry(x: Column) -> Column:
    """A line that lists: marked entries that are not sentences, links, contents, index and reference lines, pairs of term and value."""
    marked = x.rlike(ENTRY_MARK) & (~x.rlike(SENTENCE_END) | (words_in(x) <= 5))
    link = x.contains("](") & x.rlike(LINK_LINE)
    leaders = (x.contains("...") | x.contains("……") | x.contains(". . .") | x.contains("____")) & x.rlike(LEADERS)
    index = x.contains(",") & x.rlike(INDEX_LINE)
    reference = x.rlike(r"\p{Nd}[-–:]\p{Nd}+\.?$") & x.rlike(r"\b\p{Nd}{4}\b")
    pair = x.contains(": ") & (words_in(x) <= 9) & x.rlike(r"^[^:：\n.!?]{1,40}: \S[^.!?؟:\n]{0,60}$")
    return (F.length(x) <= LONGEST_ENTRY) & (marked | link | leaders | index | reference | pair)


def statistics(documents: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``blank`` and the statistics of every row; of null, empty and blank texts all are 0 and ``blank`` is true.

    ``common`` holds the frequent words of each language, a reference list of a few
    hundred rows; a word counts as common if it is frequent in any language. No
    shuffle; repeated rows give repeated results; other columns are left out.
    """
    # A hand-written reference list; refused beyond a size that still fits into a plan.
    rows = common.select(F.lower("word").alias("w")).distinct().limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("the list of common words must stay below 20,000 words")
    frequent = [r["w"] for r in rows if r["w"]]
    whole = F.coalesce(F.col(text), F.lit(""))
    based = spread(documents.select(key, whole.alias("t"))).withColumn("blank", F.length(F.regexp_replace("t", UNSEEN, "")) == 0)
    cut = based.select(
        key,
        "blank",
        "t",
        # Lines without what surrounds them; one pass over the text for either list.
        F.filter(F.split(F.regexp_replace("t", rf"^[{WHITE}]+|(?<![ \x{{A0}}\r\n])[ \x{{A0}}\r\n]+$", ""), rf"(?:(?<![ \x{{A0}}])[ \x{{A0}}]+)?[\r\n][{WHITE}]*"), lambda x: F.length(x) > 0).alias("lines"),
        F.filter(F.split("t", rf"[{WHITE}]+"), lambda x: F.length(x) > 0).alias("words"),
        F.length(F.regexp_replace("t", rf"[{WHITE}]", "")).alias("seen"),
    )
    n, seen, lines = F.size("words"), F.col("seen"), F.col("lines")
    # Words from their first to their last letter.
    bare = F.regexp_extract_all(F.lower("t"), F.lit(rf"\p{{L}}(?:[^{WHITE}]*\p{{L}})?"), F.lit(0))
    ratio = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    plain_words = F.filter(F.col("words"), lambda x: ~x.rlike(r"://|^!?\[|\]\("))
    return cut.select(
        key,
        "blank",
        n.alias("n_words"),
        ratio(F.aggregate("words", F.lit(0), lambda a, x: a + F.length(x)), n).alias("mean_word_length"),
        ratio(count_of(F.regexp_replace("t", r"\.{4,}|…{2,}|(?:\. ){3,}", ""), r"[^\p{L}\p{M}\p{N}\s\p{Z}\p{Cf}]"), seen).alias("symbol_ratio"),
        ratio(count_of(F.col("t"), r"\p{Nd}"), seen).alias("digit_ratio"),
        ratio(F.size(F.filter(lines, lambda x: x.rlike(END_MARK))), F.size(lines)).alias("end_punct_share"),
        ratio(F.size(F.filter(bare, lambda x: x.isin(frequent))), n).alias("common_word_share"),
        char_share(lines, is_entry).alias("entry_share"),
        char_share(lines, is_cells).alias("cell_share"),
        char_share(lines, lambda x: (words_in(x) <= 4) & ~x.rlike(END_MARK)).alias("short_line_share"),
        ratio(n, F.size(lines)).alias("words_per_line"),
        ratio(F.aggregate(F.filter(plain_words, lambda x: F.length(x) > 30), F.lit(0), lambda a, x: a + F.length(x)), seen).alias("long_word_share"),
        ratio(count_of(F.col("t"), r"[\x{FFFD}\x{2500}-\x{259F}\x{80}-\x{9F}\x{1}-\x{8}Â-ÃØÙÛ¬€^`~%°]"), seen).alias("odd_char_ratio"),
        ratio(F.size(F.array_distinct("words")), n).alias("distinct_word_share"),
        char_share(lines, lambda x: x.contains(" ") & x.rlike(HEX_LINE)).alias("hex_share"),
        *(ratio(F.regexp_count("t", F.lit(pattern)), n).alias(name) for name, pattern in (("mark_run_share", MARK_RUN), ("cluster_share", CLUSTER), ("inner_mark_share", INNER_MARK))),
        ratio(F.regexp_count("t", F.lit(rf"{SENTENCE_END[:-1]}(?=[{WHITE}]|$)")), F.sqrt(n.cast("double"))).alias("sentence_share"),
    )


class Test(NamedTuple):
    name: str
    above: bool
    limit: float


class Rule(NamedTuple):
    tests: tuple[Test, ...]
    kind: str


def covers(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for t in rule:
        column = x[:, NAMES.index(t.name)]
        held &= column >= t.limit if t.above else column < t.limit
    return held


def best_test(x: np.ndarray, y: np.ndarray) -> tuple[float, Test] | None:
    """The test with the highest gain of information (as in FOIL) over the covered rows."""
    p, n, best = y.sum(), (~y).sum(), None
    base = np.log2(p / (p + n))
    for k, name in enumerate(NAMES):
        order = np.argsort(x[:, k], kind="stable")
        values, hits = x[order, k], y[order]
        edges = np.flatnonzero(values[1:] > values[:-1])
        if not edges.size:
            continue
        limits = (values[edges] + values[edges + 1]) / 2
        below, both = np.cumsum(hits)[edges], edges + 1
        for above, ps, ts in ((False, below, both), (True, p - below, p + n - both)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ps > 0, ps * (np.log2(ps / ts) - base), -np.inf)
            top = int(np.argmax(gain))
            if best is None or gain[top] > best[0] + 1e-9:
                best = (float(gain[top]), Test(name, above, float(limits[top])))
    return best if best and best[0] > 1e-6 else None


def grown(x: np.ndarray, y: np.ndarray, most: int = 5) -> tuple[Test, ...]:
    tests: tuple[Test, ...] = ()
    while len(tests) < most:
        held = covers(tests, x)
        if not (held & ~y).any() or not (held & y).any() or (found := best_test(x[held], y[held])) is None:
            break
        tests += (found[1],)
    return tests


def pruned(tests: tuple[Test, ...], x: np.ndarray, y: np.ndarray) -> tuple[Test, ...]:
    """Drop final tests while that does not lower (p - n) / (p + n) on the pruning rows."""

    def worth(rule: tuple[Test, ...]) -> float:
        held = covers(rule, x)
        p, n = (held & y).sum(), (held & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def induce(x: np.ndarray, kinds: np.ndarray, seed: int = 3) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning; what no rule covers is prose."""
    generator, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), dtype=bool)
    for kind in KINDS:
        failed = 0
        while failed < TRIES and (left & (kinds == kind)).sum() >= 3:
            rows = generator.permutation(np.flatnonzero(left))
            two_thirds = max(1, len(rows) * 2 // 3)
            grow, prune = rows[:two_thirds], rows[two_thirds:]
            if not (kinds[grow] == kind).any():
                failed += 1
                continue
            tests = pruned(grown(x[grow], kinds[grow] == kind), x[prune], kinds[prune] == kind)
            held = covers(tests, x) & left
            right = (held & (kinds == kind)).sum()
            if not tests or right == 0 or (held.sum() - right) > MOST_WRONG * held.sum():
                failed += 1
                continue
            rules.append(Rule(tests, kind))
            left &= ~held
    return rules


def case_sql(rules: list[Rule], of: str = "") -> str:
    """The rule list as a CASE expression over the statistics, which are columns, or fields of ``of``."""
    if not rules:
        return f"'{DEFAULT}'"
    when = " ".join(f"WHEN {' AND '.join(f'{of}{t.name} {">=" if t.above else "<"} {t.limit!r}D' for t in r.tests)} THEN '{r.kind}'" for r in rules)
    return f"CASE {when} ELSE '{DEFAULT}' END"


def fit(documents: DataFrame, common: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> list[Rule]:
    """The rule list of a bounded sample of labelled documents (the ``rows`` with the smallest hash of their key)."""
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    sample = bounded_sample(documents.where(F.col(text).isNotNull()).select(key, text, lang.alias("lang")), key, rows)
    models = responses.fitted([(r[text], code) for r in sample if (code := responses.code_of(r["lang"])) in responses.CODES])
    texts, labels = examples.labelled([r[text] for r in sample], unreadable=lambda t: responses.shortfall(t, models) > UNREADABLE)
    if not texts:
        return []
    spark: SparkSession = documents.sparkSession
    made = statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8), common)
    values = sorted(made.select("doc_id", *NAMES).collect())
    x = np.array([[float(v) for v in r[1:]] for r in values])
    return induce(x, np.array(labels))


def kinds(documents: DataFrame, common: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id``, ``kind`` and the statistics; the kind of blank texts is null."""
    rules = fit(documents, common) if rules is None else rules
    return statistics(documents, common).withColumn("kind", F.when(~F.col("blank"), F.expr(case_sql(rules))))


def not_prose(documents: DataFrame, common: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``kind`` of the documents that are no natural prose.

    The statistics that rules use are fields of one value and the kinds are exploded,
    so that the optimizer neither writes a statistic out at each of its tests nor
    repeats the whole rule list in a filter.
    """
    rules = fit(documents, common) if rules is None else rules
    used = sorted({t.name for r in rules for t in r.tests})
    held = statistics(documents, common, key).select(key, F.struct("blank", *used).alias("s"))
    found = F.expr(f"filter(transform(array(s), x -> CASE WHEN x.blank THEN '{DEFAULT}' ELSE {case_sql(rules, 'x.')} END), k -> k <> '{DEFAULT}')")
    return held.select(key, F.explode(found).alias("kind"))
