"""Quality rules with thresholds learned per language and source.

Every document is measured with built-in functions. Each (language, source) keeps a mergeable
quantile sketch of each measure; sketches of sources merge into those of languages and of all
documents, which stand in for groups too small to judge by. A document fails a rule when a measure
lies further from its group's median than ``width`` times the spread on the group's ordinary side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import SPACES, stored, table, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
SKETCH_SIZE = 4096
SMALL_GROUP = 40
WIDTH = 4.0
#: Measure, the least spread that counts as one, and whether low values fail as well.
RULES = (
    ("symbol_share", 0.01, False),
    ("upper_share", 0.05, False),
    ("dup_line_share", 0.1, False),
    ("repeat_share", 0.05, False),
    ("word_size", 0.4, True),
)
RANKS = (0.1, 0.5, 0.9)


def _let(value: Column, body) -> Column:
    """The value computed once and used several times by ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more; a document's windows are told apart by 64-bit hashes."""
    n = F.size(words) - WINDOW
    keys = F.when(
        n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        sizes = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(sizes, F.lit(0), lambda a, b: a + b)

    def repeated(order: Column) -> Column:
        key = lambda j: F.get(order, j)["key"]
        again = F.filter(
            F.sequence(F.lit(0), F.size(order) - 1),
            lambda j: F.coalesce(key(j) == key(j - 1), F.lit(False)) | F.coalesce(key(j) == key(j + 1), F.lit(False)),
        )
        return _let(F.sort_array(F.transform(again, lambda j: F.get(order, j)["at"])), covered)

    def count(k: Column) -> Column:
        order = F.sort_array(F.transform(k, lambda key, i: F.struct(key.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(_let(order, repeated))

    return _let(keys, count)


def measures(docs: DataFrame) -> DataFrame:
    """The counts of each text, and the shares that the rules judge. NULL text has no word."""
    text = text_or_empty()
    words = _let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counts = docs.select(
        "doc_id", "lang", "source",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("again"))).alias("_w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
    ).select(
        "doc_id", "lang", "source", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_upper",
        F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"), F.col("_w.again").alias("n_repeat_words"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counts.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("word_size"),
    )


def thresholds(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """Highest and lowest value allowed by (lang, source), from the documents that pass the base rules.

    One pass builds the sketches; languages and the whole merge them.
    """
    names = [name for name, *_ in RULES]
    own = stored(
        measured.where(~F.col("base_failed")).groupBy("lang", "source").agg(
            F.count("*").alias("n"), *[F.kll_sketch_agg_double(name, SKETCH_SIZE).alias(name) for name in names]
        ),
        "sketches",
    )
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(name, SKETCH_SIZE).alias(name) for name in names]]
    by_lang = own.groupBy("lang").agg(*merged)
    whole = own.agg(*merged)

    def limits(sketches: DataFrame, prefix: str) -> DataFrame:
        out = [c for c in ("lang", "source") if c in sketches.columns]
        cols = [F.col("n").alias(f"{prefix}_n")]
        for name, least, low in RULES:
            q = [F.kll_sketch_get_quantile_double(name, F.lit(r)) for r in RANKS]
            cols.append((q[1] + width * F.greatest(q[1] - q[0], F.lit(least))).alias(f"{prefix}_{name}_max"))
            if low:
                cols.append((q[1] - width * F.greatest(q[2] - q[1], F.lit(least))).alias(f"{prefix}_{name}_min"))
        return sketches.select(*out, *cols)

    g, by = limits(own, "g"), limits(by_lang, "l").withColumnRenamed("lang", "_lang")
    overall = limits(whole.where("n > 0"), "a").first()  # one row, or none
    joined = g.join(by, F.col("lang").eqNullSafe(F.col("_lang")))

    def pick(what: str) -> Column:
        return (
            F.when(F.col("g_n") >= SMALL_GROUP, F.col(f"g_{what}")).when(F.col("l_n") >= SMALL_GROUP, F.col(f"l_{what}"))
            .otherwise(F.lit(overall[f"a_{what}"] if overall else None)).cast("double").alias(what)
        )

    picked = [pick(f"{name}_{side}") for name, _, low in RULES for side in (("max", "min") if low else ("max",))]
    return joined.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *picked)


def judged(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """All measures with ``base_failed`` and ``kept``. NULL languages and sources are groups as well."""
    measured = stored(measures(docs), "measures")
    limits = stored(thresholds(measured, width), "thresholds")
    within = F.lit(True)
    for name, _, low in RULES:
        within = within & (F.col(name) <= F.col(f"{name}_max"))
        if low:
            within = within & (F.col(name) >= F.col(f"{name}_min"))
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    joined = measured.join(limits, same, "left")  # a group whose documents all fail has no limits
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their base counts, ``base_failed`` and ``kept``.

    Empty and NULL texts fail the base rules; repeated rows are judged each; an empty table gives none.
    """
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_SPACE_SQL = r"[\x20\x09-\x0D]+"


def _limits_sql(group: str, prefix: str) -> str:
    parts = []
    for name, least, low in RULES:
        q = [f"quantile_disc({name}, {r})" for r in RANKS]
        parts.append(f"{q[1]} + {WIDTH}::DOUBLE * greatest({q[1]} - {q[0]}, {least}::DOUBLE) AS {prefix}_{name}_max")
        if low:
            parts.append(f"{q[1]} - {WIDTH}::DOUBLE * greatest({q[2]} - {q[1]}, {least}::DOUBLE) AS {prefix}_{name}_min")
    by = f"GROUP BY {group}" if group else ""
    return f"SELECT {group + ',' if group else ''} count(*) AS {prefix}_n, {', '.join(parts)} FROM m WHERE NOT base_failed {by}"


def _within_sql() -> str:
    out = []
    for name, _, low in RULES:
        for side, sign in (("max", "<="),) + ((("min", ">="),) if low else ()):
            what = f"{name}_{side}"
            out.append(f"{name} {sign} CASE WHEN g_n >= {SMALL_GROUP} THEN g_{what} WHEN l_n >= {SMALL_GROUP} THEN l_{what} ELSE a_{what} END")
    return " AND ".join(out)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE_SQL}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SPACE_SQL}', '', 'g') <> '') AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE_SQL}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
m AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols::DOUBLE / word_chars::DOUBLE END AS symbol_share,
  CASE WHEN word_chars = 0 THEN 0 ELSE n_upper::DOUBLE / word_chars::DOUBLE END AS upper_share,
  CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines::DOUBLE / n_lines::DOUBLE END AS dup_line_share,
  CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words::DOUBLE / n_words::DOUBLE END AS repeat_share,
  CASE WHEN n_words = 0 THEN 0 ELSE word_chars::DOUBLE / n_words::DOUBLE END AS word_size FROM c),
g AS ({_limits_sql("lang, source", "g")}), l AS ({_limits_sql("lang", "l")}), a AS ({_limits_sql("", "a")})
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce({_within_sql()}, false)) AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""
