"""Quality rules as column expressions: base rules, and divergence from the references of the language.

Each document has two histograms: shares of character classes among its word characters, and shares of the common words of
its language among its words. References are the pooled histograms of all documents of the language, computed by grouped
aggregation. A document is kept if the base rules pass and, where it is long enough for a histogram to say something, its
Jensen-Shannon distance to the reference stays under the bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, let, table, white_words

# Very common words of each language, in alphabetical order.
COMMON_WORDS = {
    "de": ["als", "auch", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "be", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you"],
    "es": ["a", "al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "y"],
    "fr": ["au", "dans", "de", "des", "du", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
#: Character classes that are counted; the last class of a histogram is all other word characters.
CLASSES = {"n_symbols": "#*$%&|<>", "n_upper": "A-Z", "n_digits": "0-9", "n_points": ".,;:!?'\"()\\-"}
#: Documents with fewer word characters, or words, than this are not judged by the respective histogram.
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest distance (root of the divergence in bits, 0 to 1) of a kept document's classes, and largest divergence of its
#: words beyond the part that a sample of so few words shows by chance, which is (bins - 1) / (8 n ln 2).
MAX_CLASS_DISTANCE, MAX_WORD_EXCESS = 0.28, 0.05


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds at least twice.

    Windows are sorted by hash together with their places; neighbours with equal hashes repeat. Of the sorted places of
    repeated windows each covers the words up to the next one, 3 at most. Texts without a repeat skip that part.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places_of_repeats(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k)["h"], F.lit(False))
        repeated = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def of_hashes(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, places_of_repeats), covered))

    def of_words(w: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), of_hashes)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(of_words(w)))


def _common_counts(text: Column, lang: Column) -> Column:
    """Counts of the common words of the language, in the list's order, then of all other words; null for other languages."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    words = F.filter(F.split(F.lower(text), "[ \\t-\\r.,;:!?'\"()]+"), lambda w: w != "")

    def counts(w: Column) -> Column:
        def of(listed: list[str]) -> Column:
            return let(F.filter(w, lambda x: x.isin(every)), lambda c: F.transform(F.array(*[F.lit(x) for x in listed]), lambda x: F.size(F.filter(c, lambda y: y == x))))

        out = F.lit(None).cast("array<int>")
        for k, listed in COMMON_WORDS.items():
            out = F.when(lang == k, of(listed)).otherwise(out)
        return let(out, lambda c: F.concat(c, F.array(F.size(w) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))

    return let(words, counts)


def document_counts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Counts of each document's whole text: the base counts and the two histograms (class_counts, word_counts).

    With whole, column row holds the document's own columns.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    kept_row = ["row"] if whole else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    only = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long")
    lines = let(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"), *row)
    rows = rows.select(
        *kept_row,
        "doc_id",
        F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise("").alias("lang"),
        (F.length("text") - F.length(F.regexp_replace("text", "[^ \\t-\\r]+", ""))).cast("long").alias("word_chars"),
        *[only(v).alias(k) for k, v in CLASSES.items()],
        lines.cast("long").alias("n_dup_lines"),
        let(white_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("of_words"),
        _common_counts(F.col("text"), F.col("lang")).alias("word_counts"),
    )
    named = F.array(*CLASSES)
    other = F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0))
    return rows.select(*kept_row, "doc_id", "lang", "of_words.*", "word_chars", "n_symbols", "n_dup_lines", F.concat(named, F.array(other)).alias("class_counts"), F.col("word_counts").cast("array<long>").alias("word_counts"))


def references(counts: DataFrame) -> DataFrame:
    """Pooled histograms of each language, as shares: lang, class_ref, word_ref. At most one row per listed language and one for all others."""
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))).cast("double") for i in range(n)])
    words = 1 + max(map(len, COMMON_WORDS.values()))
    shares = lambda c: let(F.col(c), lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), lambda s: F.transform(a, lambda x: F.when(s > 0, F.coalesce(x, F.lit(0.0)) / s).otherwise(0.0))))
    pooled = counts.groupBy("lang").agg(sums("class_counts", len(CLASSES) + 1).alias("class_ref"), sums("word_counts", words).alias("word_ref"))
    return pooled.select("lang", shares("class_ref").alias("class_ref"), shares("word_ref").alias("word_ref"))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts to a reference of shares; null if there are no counts."""
    term = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def of(total: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda c, q: let(c / total, lambda p: (term(p, q) + term(q, p)) / 2))
        return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))))

    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), of)


def quality_rules(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances, and kept, for every row of docs (columns doc_id, text, lang).

    Null or blank texts have no words and fail the base rules. Documents of null or unlisted languages share one reference
    of character classes and are not judged by words. Repeated rows are judged each; other columns are ignored; an empty
    table gives an empty result; a text of any length is read whole, as one cell. Windows are told apart by 64-bit hashes, so
    two different ones of a text of n words meet with a chance below n * n / 2**65. With whole, column row holds the
    document's own columns.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    # each text is counted once; writing a document beside its counts costs far less than counting it again
    counts = scratch.save(document_counts(docs, whole), "counts")
    refs = F.broadcast(scratch.save(references(counts), "references"))  # five rows at most
    rows = counts.join(refs, "lang").select(
        *(["row"] if whole else []),
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        js_distance(F.col("class_counts"), F.col("class_ref")).alias("class_distance"),
        F.when(F.col("word_counts").isNotNull(), js_distance(F.col("word_counts"), F.col("word_ref"))).alias("word_distance"),
        "word_ref",
    )
    odd_class = (F.col("word_chars") >= MIN_CHARS) & F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False))
    by_chance = (F.size("word_ref") - 1) / (8 * math.log(2) * F.col("n_words"))
    odd_words = (F.col("n_words") >= MIN_WORDS) & F.coalesce(F.col("word_distance") * F.col("word_distance") > MAX_WORD_EXCESS + by_chance, F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd_class & ~odd_words).drop("word_ref")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lists = " ".join(f"WHEN {quote(k)} THEN [{', '.join(map(quote, v))}]" for k, v in COMMON_WORDS.items())
    only = ", ".join(f"length(regexp_replace(t, '[^{v.replace(chr(39), chr(39) * 2)}]+', '', 'g')) AS {k}" for k, v in CLASSES.items())
    classes, words = len(CLASSES) + 1, 1 + max(map(len, COMMON_WORDS.values()))
    ref = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])::DOUBLE" for i in range(n)) + "]"
    share = lambda c: f"list_transform({c}, lambda x: CASE WHEN list_sum({c}) > 0 THEN coalesce(x, 0.0) / list_sum({c}) ELSE 0.0 END)"

    def distance(c: str, r: str) -> str:
        p, q = f"({c}[i]::DOUBLE / list_sum({c}))", f"{r}[i]"
        term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
        return f"CASE WHEN list_sum({c}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len({c}) + 1), lambda i: ({term(p, q)} + {term(q, p)}) / 2)))) END"

    return f"""
WITH base AS (
  SELECT doc_id, CASE WHEN lang IN ({', '.join(map(quote, COMMON_WORDS))}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(regexp_split_to_array(lower(t), '[ \t-\r.,;:!?''"()]+'), lambda x: x <> '') AS cw,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls,
    CASE lang {lists} END AS common
  FROM base
), tri AS (
  SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) FROM repeated) GROUP BY doc_id
), counts AS (
  SELECT split.doc_id, lang, len(w)::BIGINT AS n_words, (length(t) - length(regexp_replace(t, '[^ \t-\r]+', '', 'g')))::BIGINT AS word_chars,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, {only},
    CASE WHEN common IS NULL THEN NULL ELSE list_append(list_transform(common, lambda x: len(list_filter(cw, lambda y: y = x))), len(list_filter(cw, lambda y: NOT list_contains(common, y)))) END AS word_counts
  FROM split LEFT JOIN covered USING (doc_id)
), hist AS (
  SELECT *, [{', '.join(CLASSES)}, word_chars - {' - '.join(CLASSES)}] AS class_counts FROM counts
), sums AS (
  SELECT lang, {ref('class_counts', classes)} AS cs, {ref('word_counts', words)} AS ws FROM hist GROUP BY lang
), refs AS (SELECT lang, {share('cs')} AS class_ref, {share('ws')} AS word_ref FROM sums),
judged AS (
  SELECT hist.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    {distance('class_counts', 'class_ref')} AS cd, {distance('word_counts', 'word_ref')} AS wd
  FROM hist JOIN refs USING (lang)
)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= {MIN_CHARS} AND coalesce(cd > {MAX_CLASS_DISTANCE}, false))
  AND NOT (n_words >= {MIN_WORDS} AND coalesce(wd * wd > {MAX_WORD_EXCESS} + {words - 1} / (8 * ln(2) * n_words), false)) AS kept
FROM judged
"""


OP7_SQL = _sql()
