"""Quality rules in a short-circuit cascade (operator 5), with DataFrame functions only.

``measured`` adds the counts that the rules look at. ``order_rules`` estimates, on a sample of the texts, what each rule costs and what it rejects,
and puts the rules in the order of rejections per cost among the texts that the rules before it leave. Its cost is the work that it does: what it looks at
(characters, words), counted on the sample, at a price for each. So the order follows from the sample alone and is the same in every run. ``judged`` evaluates
the chain: a later rule is only looked at if all earlier ones hold. The order changes the cost and never the verdict.

Windows of three words are told apart by 64 bits of hash within their text.

Defined results: null texts have no words; an empty sample leaves the rules in their given order; rules that reject nothing come last, the cheapest first;
repeated rows get equal verdicts; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed, table, unpacked

#: Rows of the sample, about.
SAMPLE = 2000
#: White space between words, and what isn't.
_BLANK, _INK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A name, the SQL condition under which a text fails, and the SQL of the work that looking at it takes beside the measures; 1 is a comparison of two numbers."""

    name: str
    fails: str
    work: str = "1"


#: What the conditions may use: integers, and text and words.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: The conditions are integer comparisons on the measures and the text. Of the work, a character costs 1 where bytes are searched and 10 under a pattern, a distinct word 20.
RULES = (
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "2"),
    Rule("repeated_lines", "3 * n_dup_lines > n_lines"),
    Rule("shouting", r"2 * length(regexp_replace(text, r'[^\p{Lu}]', '')) > word_chars", "10 * octet_length(text)"),
    Rule("exclamations", "3 * (octet_length(text) - octet_length(replace(text, '!', ''))) > n_words", "octet_length(text)"),
    Rule("distinct_words", "5 * size(array_distinct(words)) < least(n_words, 1000)", "20 * n_words"),
)


def _repeats() -> str:
    """The words in windows that stand twice or more: windows as (hash, place), sorted, so that equal ones are neighbours."""
    ordered = "sort_array(transform(windows, (h, i) -> struct(h, i)))"
    like_before = "zip_with(s, concat(array(cast(null as struct<h:bigint,i:int>)), slice(s, 1, size(s) - 1)), (x, y) -> struct(x.i as i, coalesce(x.h = y.h, false) as again))"
    like_either = "zip_with(e, concat(slice(e, 2, size(e) - 1), array(struct(0 as i, false as again))), (x, y) -> if(x.again or y.again, x.i, null))"
    found = f"element_at(transform(transform(array({ordered}), s -> {like_before}), e -> {like_either}), 1)"
    places = f"sort_array(filter({found}, i -> i is not null))"
    # a window adds three words, less those that the next one has too
    return f"element_at(transform(array({places}), p -> 3L + aggregate(zip_with(slice(p, 2, size(p)), slice(p, 1, size(p) - 1), (a, b) -> least(3, a - b)), 0L, (a, x) -> a + x)), 1)"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of docs), text (null as empty), words (array) and the MEASURES (longs)."""
    out = packed(docs, F.coalesce(col(text), F.lit("")).alias("text"))
    out = out.withColumn("words", F.expr(f"array_remove(split(text, r'{_BLANK}', -1), '')"))
    out = out.withColumn("lines", F.expr(rf"filter(split(text, '\n', -1), x -> x rlike r'{_INK}')"))
    without = "text"
    for sign in "#*$%&|<>":
        without = f"replace({without}, '{sign}', '')"
    hashes = out.withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
    pair = "zip_with(slice(h, 1, size(h) - 2), slice(h, 2, size(h) - 2), (a, b) -> xxhash64(a, b))"
    out = hashes.withColumn("windows", F.expr(f"if(size(h) < 3, cast(array() as array<bigint>), zip_with({pair}, slice(h, 3, size(h) - 2), (a, b) -> xxhash64(a, b)))"))
    return out.select(
        "row",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr(f"cast(octet_length(text) - octet_length({without}) as bigint)").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(array_distinct(windows)) = size(windows), 0L, {_repeats()})").alias("n_repeat_words"),
    )


def order_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample: int = SAMPLE, first: Sequence[Rule] = ()) -> list[Rule]:
    """The rules by rejections per work, on about so many sampled texts; those in first stand before them in any case.

    The sample is drawn before it is measured. Of its rows, counts and work by what they fail come back: 2 ** rules rows at most.
    """
    rows = docs.count()
    taken = table(docs.select(col(text).alias("text")).sample(fraction=min(1.0, sample / max(1, rows)), seed=5), "rule-sample")
    rated = measured(taken).where(" and ".join(["true", *(f"not ({r.fails})" for r in first)]))
    fails = F.array(*(F.expr(f"coalesce({r.fails}, false)") for r in rules)).alias("fails")
    work = [F.sum(F.expr(f"cast({r.work} as double)")).alias(f"w{i}") for i, r in enumerate(rules)]
    left = rated.groupBy(fails).agg(F.count("*").alias("n"), *work).collect()
    order: list[int] = []
    while len(order) < len(rules):
        there = [r for r in left if not any(r["fails"][i] for i in order)]

        def rank(i: int) -> tuple:
            rejected, done = sum(r["n"] for r in there if r["fails"][i]), sum(r[f"w{i}"] for r in there)
            return -rejected / max(1.0, done), done, i

        order.append(min((i for i in range(len(rules)) if i not in order), key=rank))
    return [*first, *(rules[i] for i in order)]


def first_failure(order: Sequence[Rule]) -> Column:
    """The name of the first rule in the chain that a text fails, else null; needs what measured() gives."""
    chain = F.lit(None).cast("string")
    for rule in reversed(order):
        chain = F.when(F.expr(rule.fails), F.lit(rule.name)).otherwise(chain)
    return chain


def judged(docs: DataFrame, order: Sequence[Rule], text: str = "text", added: str = "quality") -> DataFrame:
    """docs with a struct of the added name, which replaces a column of that name: the MEASURES, and failed, the first rule that a text fails, or null."""
    kept = [c for c in docs.columns if c.lower() != added.lower()]
    return measured(docs, text).select(*unpacked(kept), F.struct(*MEASURES, first_failure(order).alias("failed")).alias(added))
