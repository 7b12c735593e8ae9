"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule is a condition under which a document is rejected. Rules differ in what they cost and in how many documents they reject, so their cost
and their selectivity are estimated on a sample, and they are tried in the order of rejections per cost: at each place the rule that, of the
documents that the rules before it leave, rejects most for its time. A document's first failure ends its evaluation (``CASE WHEN`` evaluates no
further branch). Since a document is kept if no rule rejects it, the order decides what the verdicts cost, never what they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import WORD, staged

#: Documents on which cost and selectivity are estimated, about; and how often each rule is timed there.
SAMPLE, TIMINGS = 1_000, 2
#: Characters that count as symbols, and what begins or ends a line of a list or of cut text.
SYMBOLS = "#*$%&|<>"
BULLET, CUT = r"^[\x20\x09-\x0D]*(?:[-•*·‣]|[0-9]+[.)])[\x20\x09]", r"(?:…|\.\.\.)[\x20\x09-\x0D]*$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often it occurs."""
    return F.transform(F.array(value), then)[0]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def _share_of_lines(text: Column, condition: Callable[[Column], Column], tenths: int) -> Column:
    """More than so many tenths of the lines with a word fulfil the condition."""
    return let(_lines(text), lambda x: F.size(F.filter(x, condition)) * 10 > F.size(x) * tenths)


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows that begin at these (sorted) places cover together."""
    none = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(width), x - acc["last"])).alias("n"))
    return F.aggregate(starts, none, add, lambda acc: acc["n"].cast("bigint"))


def repeated_words(text: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text.

    Windows are compared by their 64-bit hashes. Most texts repeat none, which a set of hashes shows; only in others are the windows sorted by hash,
    so that equal ones are neighbours. Sorting holds some 100 bytes a word of one text.
    """

    def repeats(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return _covered(F.sort_array(let(placed, lambda s: F.transform(twice(s), lambda x: x["i"]))), 3)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(repeats(h))))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), windows)


#: Counts of a text that rules use and that can be had as columns too.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: _count(t, WORD),
    "word_chars": lambda t: F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint"),
    "n_symbols": lambda t: (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
    "n_dup_lines": lambda t: let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    "n_repeat_words": repeated_words,
}

#: name -> condition that rejects, from the text and a function that gives a statistic.
Rules = Mapping[str, Callable[[Column, Callable[[str], Column]], Column]]

#: The two rules that reject whatever the others say.
BASE: Rules = {
    "too_short": lambda t, s: s("n_words") < 50,
    "repeated_words": lambda t, s: s("n_repeat_words") * 100 > s("n_words") * 50,
}
RULES: Rules = BASE | {
    "symbols": lambda t, s: s("n_symbols") * 10 > s("n_words"),
    "word_length": lambda t, s: (s("word_chars") < s("n_words") * 2) | (s("word_chars") > s("n_words") * 20),
    "repeated_lines": lambda t, s: let(_lines(t), lambda x: s("n_dup_lines") * 2 > F.size(x)),
    "few_letters": lambda t, s: _count(t, r"\p{L}") * 2 < s("word_chars"),
    "capitals": lambda t, s: _count(t, r"\p{Lu}") * 2 > _count(t, r"\p{L}"),
    "bullets": lambda t, s: _share_of_lines(t, lambda x: x.rlike(BULLET), 9),
    "cut_lines": lambda t, s: _share_of_lines(t, lambda x: x.rlike(CUT), 3),
}


class Estimate(NamedTuple):
    rule: str
    seconds: float
    rejected: int


def _conditions(rules: Rules, text: Column, columns: Mapping[str, str]) -> dict[str, Column]:
    """Each rule as a condition; columns: statistics that the table has already, by name."""
    stat = lambda name: F.col(f"`{columns[name]}`") if name in columns else STATISTICS[name](text)
    return {name: F.coalesce(rule(text, stat), F.lit(False)) for name, rule in rules.items()}


def _seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def estimate(docs: DataFrame, rules: Rules = RULES, text_col: str = "text", columns: Mapping[str, str] | None = None, sample: int = SAMPLE) -> list[Estimate]:
    """The rules in the order in which they should run, each with its time on the sample and how many documents of it that it is the first to reject.

    Time is that of evaluating the rule on the sample less that of reading the sample, the least of TIMINGS runs. Selectivity is counted once for all rules,
    from the combinations of verdicts, so that a rule which rejects the same documents as an earlier one ranks for what it adds. Of equal rules the one
    named first goes first. An empty table gives the order of the rules.
    """
    columns = columns or {}
    n = docs.count()
    share = min(1.0, sample / n) if n else 1.0
    kept = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), *[F.col(f"`{c}`") for c in columns.values()])
    some = staged(kept if share == 1.0 else kept.sample(share, seed=7), "quality-sample")
    conditions = _conditions(rules, F.col("__text"), columns)
    alone = min(_seconds(some.select(F.octet_length("__text") > 0)) for _ in range(TIMINGS))
    seconds = {name: max(1e-3, min(_seconds(some.select(c)) for _ in range(TIMINGS)) - alone) for name, c in conditions.items()}
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    left = {r["bits"]: r["n"] for r in some.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each combination
    place, order = {name: i for i, name in enumerate(rules)}, []
    while len(order) < len(place):
        gains = {name: sum(n for b, n in left.items() if b >> i & 1) for name, i in place.items() if name not in {e.rule for e in order}}
        best = max(gains, key=lambda name: (gains[name] / seconds[name], -place[name]))
        order.append(Estimate(best, seconds[best], gains[best]))
        left = {b: n for b, n in left.items() if not b >> place[best] & 1}
    return order


def cascade(docs: DataFrame, rules: Rules = RULES, order: list[str] | None = None, text_col: str = "text", columns: Mapping[str, str] | None = None, into: str = "failed_rule") -> DataFrame:
    """docs with one more column: the first rule, in that order, that rejects the document; null if none does, so the document stays.

    Without order it is estimated first. columns names statistics that docs has already (statistic -> column); others are computed where a rule needs
    them, and not for documents that an earlier rule has rejected. A null text counts as empty. Rules that can't be decided (null) reject nothing.
    Repeated rows are judged each; an empty table gives an empty result. A column of docs that is named as into is replaced; others stay, whatever their names.
    """
    columns = columns or {}
    order = [e.rule for e in estimate(docs, rules, text_col, columns)] if order is None else order
    conditions = _conditions(rules, F.coalesce(F.col(f"`{text_col}`"), F.lit("")), columns)
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(conditions[name], F.lit(name)).otherwise(verdict)
    return docs.withColumn(into, verdict)


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with a column for each of STATISTICS, named with the prefix; columns that have these names are replaced. A null text has zeros."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumns({f"{prefix}{name}": s(text) for name, s in STATISTICS.items()})


def op12_cascade(spark, sf_dir):
    """Every document with its statistics, whether a base rule rejects it, and whether the cascade of all RULES keeps it.

    Statistics of all documents are returned, so they are computed before the cascade, whose rules on the text run for what is left only.
    Null and empty texts fail the base rules; rows without doc_id and repeated rows are judged each; an empty table gives an empty result.
    """
    docs = with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    judged = cascade(docs, columns={name: name for name in STATISTICS}, order=_order(spark, sf_dir))
    base = F.lit(False)
    for c in _conditions(BASE, F.col("text"), {name: name for name in STATISTICS}).values():
        base = base | c
    return judged.select("doc_id", *STATISTICS, base.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


def _order(spark, sf_dir) -> list[str]:
    """The order for documents whose statistics are there already, from a sample of the documents for which alone they are computed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = docs.count()
    some = staged(with_statistics(docs.sample(min(1.0, SAMPLE / n), seed=7) if n else docs), "quality-statistics")
    return [e.rule for e in estimate(some, columns={name: name for name in STATISTICS})]


ORACLE = r"""
WITH D AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
W AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM D),
P AS (SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM W WHERE len(w) > 3),
G AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM P),
C AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM G WHERE n > 1) GROUP BY r),
S AS (SELECT W.r, doc_id, t, l, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(C.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '\p{Lu}')) AS upper
  FROM W LEFT JOIN C ON W.r = C.r),
B AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM S)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > len(l) OR 2 * letters < word_chars OR 2 * upper > letters
    OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(?:[-•*·‣]|[0-9]+[.)])[\x20\x09]'))) > 9 * len(l)
    OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(?:…|\.\.\.)[\x20\x09-\x0D]*$'))) > 3 * len(l)) AS kept
FROM B
"""
