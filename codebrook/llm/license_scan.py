"""License scans by an exact set-similarity join, with DataFrame functions only.

Templates and text blocks are sets of words. Blocks are the lines, and, for notices that
are wrapped, all runs of words of a template's length (over `percent`, so that some
words may stand between) wherever lines end. A block matches a template when
it holds at least `percent` of the template's words. Words are ordered by how many
documents of the whole table hold them, rarest first; a block can only reach the
threshold if it shares one of the template's first `size - required + 1` words in
that order (prefix filter), has `required` words (length filter), and has enough
words left on both sides after the first shared one (positional filter). What passes
is compared word by word, so the result is exact. Runs are only looked at around the
places of those first words: any run that matches holds one of them.

Templates are parameters, so their words (a few hundred) are the bound of all that is
broadcast or collected.

Edge cases: a null text is empty, has no words and no labels; repeated rows, and rows
without a doc_id, are scanned each; equal template words count once; words that equally
many documents hold are ordered by themselves; a one-line document of any length is one
block, and a very long one has a hit for each of its seeds only; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed value: what stands between words once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def template_words(text: str) -> list[str]:
    """The distinct words of an ASCII template."""
    plain = "".join(c if c.isalnum() else " " for c in text.lower())
    return sorted(set(plain.split()))


def prefixes(templates, percent: int, frequency: dict[str, int]) -> list[tuple]:
    """Rows (template, label, word, position, size, required, ordered words) of all prefixes."""
    rows = []
    for k, (label, text) in enumerate(templates):
        ordered = sorted(template_words(text), key=lambda w: (frequency.get(w, 0), w))
        required = ceil(percent * len(ordered) / 100)
        rows += [(k, label, w, p, len(ordered), required, ordered) for p, w in enumerate(ordered[: len(ordered) - required + 1])]
    return rows


def _index(docs: DataFrame, templates, percent: int) -> tuple[DataFrame, list[str], list[str], int]:
    """Prefixes of all templates as a table, their words, all words in order, and the longest run."""
    vocabulary = sorted({w for _, text in templates for w in template_words(text)})
    held = docs.select(F.explode(F.array_intersect("w", F.array(*map(F.lit, vocabulary)))).alias("word"))
    frequency = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    rows = prefixes(templates, percent, frequency)
    lengths = run_lengths(templates, percent)
    index = docs.sparkSession.createDataFrame([(*r, lengths[r[0]]) for r in rows], "template int, label string, word string, position int, size int, required int, ordered array<string>, length int")
    return index, sorted({r[2] for r in rows}), sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)), max(lengths, default=1)


def run_lengths(templates, percent: int) -> list[int]:
    """Words of a run that is compared with each template."""
    return [ceil(100 * len("".join(c if c.isalnum() else " " for c in text).split()) / percent) for _, text in templates]


_HIT = "array<struct<block: int, word: string, at: int, n: int, known: array<string>, near: array<string>>>"


def _hits(seeds: list[str], order: list[str], longest: int) -> Column:
    """Places of seeds in a document: in its lines (with the line's known words), and in the words around them.

    `at` is the seed's place among the known words of the line, or in `near`.
    """
    seeds, order = (F.array(*map(F.lit, x)) for x in (seeds, order))
    known = lambda line: F.struct(F.size(F.array_distinct(words(line))).alias("n"), F.array_intersect(order, words(line)).alias("known"))
    lines = F.transform(F.split("low", "\n"), lambda line, b: F.struct(b.alias("block"), known(line).alias("k")))
    lines = F.filter(lines, lambda x: F.arrays_overlap(x["k"]["known"], seeds))
    none = F.lit(None).cast("array<string>")
    of_line = lambda x: F.transform(F.filter(F.transform(x["k"]["known"], lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: F.array_contains(seeds, p["w"])), lambda p: F.struct(x["block"].alias("block"), p["w"].alias("word"), p["i"].alias("at"), x["k"]["n"].alias("n"), x["k"]["known"].alias("known"), none.alias("near")))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(seeds, F.get("w", i)))
    near = lambda i: F.slice("w", F.greatest(i - (longest - 2), F.lit(1)), F.least(i, F.lit(longest - 1)) + longest)
    around = F.transform(at, lambda i: F.struct(F.lit(None).cast("int").alias("block"), F.get("w", i).alias("word"), F.least(i, F.lit(longest - 1)).alias("at"), F.lit(0).alias("n"), none.alias("known"), near(i).alias("near")))
    return F.when(F.arrays_overlap("w", seeds), F.concat(F.flatten(F.transform(lines, of_line)).cast(_HIT), around.cast(_HIT))).otherwise(F.lit(None).cast(_HIT))


def _overlap() -> Column:
    """Words that a block around a seed shares with the template: of a line, or the best run; 0 where a filter says no."""
    required, at, ordered = F.col("required"), F.col("at"), F.col("ordered")
    fits = (F.col("n") >= required) & (F.least(F.col("size") - F.col("position"), F.size("known") - at) >= required)
    line = F.when(fits, F.size(F.array_intersect("known", "ordered"))).otherwise(0)
    # runs that hold the seed begin at most a length before it
    begin = F.greatest(at - F.col("length") + 1, F.lit(0))
    near = F.slice("near", begin + 1, at - begin + F.col("length"))
    held = F.transform(F.sequence(begin, at), lambda s: F.size(F.array_intersect(ordered, F.slice("near", s + 1, F.col("length")))))
    run = F.when(F.size(F.array_intersect(ordered, near)) >= required, F.array_max(held)).otherwise(0)
    return F.when(F.col("block").isNotNull(), line).otherwise(run)


def block_matches(docs: DataFrame, templates=TEMPLATES, percent: int = 80) -> DataFrame:
    """Rows (doc_id, block, template, label, overlap, containment) of all matching lines and runs.

    `docs` has doc_id, `_row`, `low` (the lower-cased text) and `w` (its words). A run has
    no block number.
    """
    index, seeds, order, longest = _index(docs, templates, percent)
    hits = docs.select("doc_id", "_row", F.explode(_hits(seeds, order, longest)).alias("h")).select("doc_id", "_row", "h.*")
    pairs = hits.join(F.broadcast(index), "word").withColumn("overlap", _overlap()).where("overlap >= required")
    return pairs.select("doc_id", "_row", "block", "template", "label", "overlap", (F.col("overlap") / F.col("size")).alias("containment")).distinct()


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = 80, phrases=PHRASES) -> DataFrame:
    """Per document: words, phrase places, labels of phrases and of matching blocks, score.

    The score is the best containment of a template, and 1 where a phrase stands. After
    the words' frequencies, one pass splits each text once and finds all of it; what is
    shuffled are counts, labels and scores, by row.
    """
    low = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    read = docs.select("doc_id", low.alias("low")).withColumn("w", words(F.col("low")))
    index, seeds, order, longest = _index(read, templates, percent)

    def places(phrase: str) -> Column:
        """Word positions where the phrase begins."""
        parts = phrase.split()
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - len(parts), F.lit(0)))
        fits = lambda i: F.forall(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts))), lambda x: F.get("w", i + x["k"]).eqNullSafe(x["p"]))
        return F.when(F.col("low").contains(parts[-1]) & F.col("low").contains(parts[0]), F.filter(starts, fits)).otherwise(F.array().cast("array<int>"))

    base = read.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.size("w").cast("long").alias("n_words"), *(places(p).alias(f"_p{k}") for k, (p, _) in enumerate(phrases)), _hits(seeds, order, longest).alias("_hits"))
    every = F.concat(*(F.col(f"_p{k}") for k in range(len(phrases))))
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))))))
    base = base.select("doc_id", "_row", "n_words", F.struct(F.size(every).alias("n"), F.array_min(every).alias("a"), F.array_max(every).alias("b")).alias("_all"), labels.alias("_base"), F.explode_outer("_hits").alias("h"))
    pairs = base.select("doc_id", "_row", "n_words", "_all", "_base", "h.*").join(F.broadcast(index), "word", "left").withColumn("overlap", F.when(F.col("template").isNotNull(), _overlap()))
    good = F.col("overlap") >= F.col("required")
    found = pairs.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "n_words", "_all", "_base")),
        F.collect_set(F.when(good, F.col("label"))).alias("found"), F.max(F.when(good, F.col("overlap") / F.col("size"))).alias("best"),
    )
    both = F.array_sort(F.array_union("_base", "found"))
    return found.select(
        "doc_id", "n_words", F.col("_all.n").cast("long").alias("n_base"), F.col("_all.a").cast("long").alias("first_word"), F.col("_all.b").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("_all.n") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
