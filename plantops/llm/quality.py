"""Quality rules: a threshold table compiled into one Spark projection.

Everything here is a Column expression over one row: no user function, no
shuffle, no join.  ``metrics`` measures a text; ``RULES`` says between which
bounds a ratio of those measures must lie; ``verdict`` compiles the table to
one boolean Column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantops.llm.common import fresh, whole_text

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = """the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als
le la les de des et en un une du que est pour qui dans par sur au avec il
el los las del y se por con su para al lo como más que un una es no""".split()

#: (ratio, its numerator, its denominator, least, most, from how many words it holds).  None: no bound.
RULES: list[tuple[str, str, str, float | None, float | None, int]] = [
    ("word_length", "word_chars", "n_words", 2.0, 15.0, 10),
    ("symbols", "n_symbols", "n_words", None, 0.2, 10),
    ("stop_words", "n_stop_words", "n_words", 0.005, None, 100),
    ("dup_lines", "n_dup_lines", "n_lines", None, 0.6, 10),
]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _bind(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once in each row: the lambda's
    variable holds it, where a plain expression would run for every element."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more.

    Windows are compared by their 64-bit hash.  Most texts repeat none, which
    one hash set shows; else (hash, position) is sorted, windows beside an
    equal hash are repeated, and from their sorted positions the length of
    the covered stretches follows."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[words[i + k] for k in range(window)]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x) + window

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.when(k > 0, F.get(s, k - 1)["h"]).eqNullSafe(x["h"])) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))
        return _bind(_bind(pairs, positions), covered)

    found = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h)))
    return F.when(F.size(words) < window, 0).otherwise(found)


def metrics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of the measures, and that
    column's name, which no column of ``docs`` has.  The words and lines are
    split once, in a projection of their own."""
    t, w, ls, m = fresh(docs.columns, "__t", "__w", "__l", "__m")
    split = docs.withColumn(t, whole_text(text)).withColumn(w, split_words(F.col(t)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(w)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # one array element each: a filter on the measures stays above the generator,
    # where a plain column would be measured anew in every condition
    return split.withColumn(ls, lines).select("*", F.explode(F.array(measures)).alias(m)).drop(t, w, ls), m


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def verdict(m: Column, rules=RULES) -> Column:
    """True where every rule of the table holds."""
    ok = F.lit(True)
    for _, top, bottom, least, most, from_words in rules:
        ratio = m[top] / F.greatest(m[bottom], F.lit(1))
        holds = F.lit(True)
        if least is not None:
            holds = holds & (ratio >= least)
        if most is not None:
            holds = holds & (ratio <= most)
        ok = ok & ((m["n_words"] < from_words) | holds)
    return ok


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row: doc_id, the measures, base_failed and kept.

    Null and empty texts have no words: all measures are zero and the base
    check fails.  Rows with null ids and repeated rows keep their row; an
    empty table gives no row; other columns are left out."""
    measured, name = metrics(docs.select("doc_id", "text"))
    m = F.col(name)
    out = measured.select("doc_id", f"{name}.*", base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged; columns of any name and type may be among them."""
    measured, name = metrics(docs)
    m = F.col(name)
    return measured.where(~base_failed(m) & verdict(m, rules)).drop(name)


#: DuckDB SQL for ``score`` over ``documents`` with RULES.
def oracle_sql(rules=RULES) -> str:
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    checks = []
    for _, top, bottom, least, most, from_words in rules:
        ratio = f"({top}::DOUBLE / greatest({bottom}, 1))"
        holds = " AND ".join([f"{ratio} >= {least}"] * (least is not None) + [f"{ratio} <= {most}"] * (most is not None))
        checks.append(f"(n_words < {from_words} OR ({holds}))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM s, unnest(generate_series(1, len(w) - 4)) AS u(i)),
dup AS (SELECT r, i FROM win WINDOW q AS (PARTITION BY r, g) QUALIFY count(*) OVER q > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM dup) GROUP BY r),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({words})))::BIGINT AS n_stop_words
      FROM s LEFT JOIN cover USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(checks)} AS kept FROM f"""
