"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Everything is DataFrame functions.  Text statistics are computed inside the row.  The statistic vectors are put on integer grids,
so that every sum is exact and the verdict does not depend on the order of rows.  For each (language, source), nulls being a
value like others, the minimum covariance determinant is approached by concentration steps: from two starts (median and
median deviation; mean and covariance of all), the mean and covariance of the closest share of the documents are taken again
and again, until no group's determinant changes, and the start with the smaller determinant wins.  A document goes if its squared
Mahalanobis distance is beyond LIMIT, a quantile of the chi-squared distribution.  Only a group's 14 sums are gathered, by partial
aggregates; no group's documents meet in one task.

Shares of symbols, of repeated lines and of repeated words are zero in most documents, so a covariance of the closest share would be singular
there: these have a smallest spread.  Word length has none to speak of; a group's own estimate decides.  A group of few
documents counts as having PRIOR more, of a common spread.

Cases: a null, empty or wordless text has zero words and fails the base rules; null languages and sources form groups; a
group of one document is its own centre; repeated rows count each and get the same verdict; ties in distance fall on
the same side; an empty table gives an empty result.  Extra columns, whatever their names, are kept by ``keep_good``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BLANKS, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: Transformed statistics, each on a grid of integers from 0 to GRID: name and the smallest spread, which keeps covariances regular.
GRID = 4095
FEATURES = {"word_length": 2.0, "symbols": 150.0, "dup_lines": 400.0, "repeats": 300.0}
#: Share of a group's documents that the estimate rests on, and what makes up for the rest's absence
#: (the share divided by the chi-squared distribution with 6 degrees at its 75 % point with 4).
SUPPORT, CONSISTENCY = 0.75, 1.486
#: Documents that a group counts as having beside its own, and their spread in each statistic.
PRIOR, PRIOR_SPREAD = 4.0, {"word_length": 45.0, "symbols": 150.0, "dup_lines": 400.0, "repeats": 300.0}
#: Concentration steps at most; two at a time, until no group's determinant changes.
STEPS = 16
#: Rings of distance to a unit of its logarithm, by which the closest share is counted.
RINGS = 64
#: How often four normal variables exceed the limit.
TAIL = 1e-6


def chi_squared_limit(tail: float) -> float:
    """The value that a chi-squared variable with four degrees exceeds with a chance of ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if math.exp(-middle / 2) * (1 + middle / 2) > tail else (low, middle)
    return round(high, 6)


LIMIT = chi_squared_limit(TAIL)


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """Adds _n_words, _word_chars, _n_symbols, _n_lines, _n_dup_lines and _n_repeat_words, and drops nothing."""
    blanks = F.lit(BLANKS)
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_trim", F.btrim("_text", blanks))
    none = F.array().cast("array<string>")
    out = out.withColumn("_words", F.when(F.col("_trim") == "", none).otherwise(F.split("_trim", r"[\x20\x09-\x0D]+")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, blanks) != ""))
    out = out.select(
        "*", F.size("_words").cast("long").alias("_n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("_n_symbols"), F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_run1"),
    ).drop("_text", "_trim", "_words", "_lines")
    for k in (1, 2, 4):  # the hash of 2k words from those of k words, k places apart
        run = F.col(f"_run{k}")
        n = F.greatest(F.size(run) - k, F.lit(0))
        out = out.withColumn(f"_run{2 * k}", F.zip_with(F.slice(run, F.lit(1), n), F.slice(run, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))).drop(run)
    run = F.col(f"_run{WINDOW}")
    some = F.size(F.array_distinct(run)) < F.size(run)
    # Only texts with a repeated window go on: their windows sorted by hash, those equal to a neighbour, in order of place.
    by_hash = F.sort_array(F.transform(run, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_by", F.when(some, by_hash)).drop(run)
    last = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_by", F.lit(1), F.greatest(F.size("_by") - 1, F.lit(0))))
    follow = F.slice("_by", F.lit(2), F.greatest(F.size("_by"), F.lit(1)))
    out = out.withColumn("_eq", F.zip_with("_by", last, lambda a, b: F.struct(a.i.alias("i"), a.h.alias("h"), (a.h == b.h).alias("e"))))
    out = out.withColumn("_eq", F.zip_with("_eq", follow, lambda a, b: F.when(F.coalesce(a.e, F.lit(False)) | F.coalesce(a.h == b.h, F.lit(False)), a.i)))
    out = out.withColumn("_at", F.sort_array(F.array_compact("_eq"))).drop("_by", "_eq")
    gaps = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))


def _grid(x: Column) -> Column:
    return F.least(F.greatest(F.round(x), F.lit(0)), F.lit(GRID)).cast("long")


def features() -> dict[str, Column]:
    """The transformed statistics on their grids; of use where there are words."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("_n_words", "_word_chars", "_n_lines"))
    return {
        "word_length": _grid(512 * F.log(chars / n)),
        "symbols": _grid(GRID * F.sqrt(F.col("_n_symbols") / (chars + F.col("_n_symbols")))),
        "dup_lines": _grid(GRID * F.col("_n_dup_lines") / lines),
        "repeats": _grid(GRID * F.col("_n_repeat_words") / n),
    }


NAMES = list(FEATURES)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
GROUP = ("_lang", "_source")


def _matched(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group; nulls are equal."""
    renamed = groups.withColumnsRenamed({k: f"{k}_of" for k in GROUP})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in GROUP])
    return rows.join(renamed, same, how).drop(*(f"{k}_of" for k in GROUP))


def _with_factor(sums: DataFrame) -> DataFrame:
    """From n, sums and sums of products of each group and start: centre m0.., lower factor l<i><j> and log determinant."""
    n = F.col("n").cast("double")
    out = sums.select(*GROUP, "start", "n", *((F.col(f"s{i}").cast("double") / n).alias(f"m{i}") for i in range(len(NAMES))), *(f"p{i}{j}" for i, j in PAIRS))
    for i, j in PAIRS:
        own = CONSISTENCY * (F.col(f"p{i}{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
        # The prior's documents weigh less the more a group has of its own; the smallest spread stays.
        own = own * F.col("n") / (F.col("n") + PRIOR)
        if i == j:
            own = F.greatest(own, F.lit(0.0)) + FEATURES[NAMES[i]] ** 2 + PRIOR_SPREAD[NAMES[i]] ** 2 * PRIOR / (F.col("n") + PRIOR)
        out = out.withColumn(f"c{i}{j}", own)
    for j in range(len(NAMES)):  # Cholesky
        for i in range(j, len(NAMES)):
            rest = reduce(lambda x, k: x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{j}{i}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(lambda x, y: x + y, [F.log(f"l{i}{i}") for i in range(len(NAMES))])
    return out.select(*GROUP, "start", F.round(det, 9).alias("log_det"), *(f"m{i}" for i in range(len(NAMES))), *(f"l{i}{j}" for j in range(len(NAMES)) for i in range(j, len(NAMES))))


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector x0.. to its estimate, by forward substitution."""
    z: list[Column] = []
    for i in range(len(NAMES)):
        rest = reduce(lambda x, k: x - F.col(f"l{i}{k}") * z[k], range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        z.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda x, y: x + y, [v * v for v in z])


def _sums(vectors: DataFrame) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(len(NAMES))]
    w = F.col("w")
    return vectors.groupBy(*GROUP, "start").agg(
        F.sum(w).alias("n"), *(F.sum(w * x[i]).alias(f"s{i}") for i in range(len(NAMES))), *(F.sum(w * x[i] * x[j]).alias(f"p{i}{j}") for i, j in PAIRS)
    )


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Of vectors x0.. with their group and weight w (rows with that vector): the minimum covariance determinant estimate of each group."""
    x = [f"x{i}" for i in range(len(NAMES))]
    # Medians over grids: at most GRID + 1 values in a group's state.
    medians = vectors.groupBy(*GROUP).agg(*(F.percentile(c, 0.5, F.col("w")).alias(f"med{i}") for i, c in enumerate(x)))
    spread = _matched(vectors, medians).groupBy(*GROUP).agg(
        F.sum("w").alias("n"), *(F.first(f"med{i}").alias(f"m{i}") for i in range(len(x))),
        *(F.percentile(F.round(F.abs(F.col(c) - F.col(f"med{i}"))).cast("long"), 0.5, F.col("w")).alias(f"d{i}") for i, c in enumerate(x)),
    )
    by_median = spread.select(
        *GROUP, F.lit(0).alias("start"), F.lit(0.0).alias("log_det"), *(f"m{i}" for i in range(len(x))),
        *(F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + FEATURES[NAMES[i]] ** 2 + PRIOR_SPREAD[NAMES[i]] ** 2 * PRIOR / (F.col("n") + PRIOR)).alias(f"l{i}{i}") if i == j else F.lit(0.0).alias(f"l{i}{j}") for j in range(len(x)) for i in range(j, len(x))),
    )
    by_all = _with_factor(_sums(vectors.withColumn("start", F.lit(1))))

    def step(estimate: DataFrame) -> DataFrame:
        near = _matched(vectors, estimate).select(*GROUP, *x, "w", "start", F.floor(RINGS * F.log(_distance() + 1e-6)).cast("int").alias("ring"))
        # The closest share, by rings of distance: about a thousand rings a group.
        rings = near.groupBy(*GROUP, "start", "ring").agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(c)).alias(f"s{i}") for i, c in enumerate(x)),
            *(F.sum(F.col("w") * F.col(x[i]) * F.col(x[j])).alias(f"p{i}{j}") for i, j in PAIRS))
        own = Window.partitionBy(*GROUP, "start")
        inner = rings.withColumn("before", F.sum("n").over(own.orderBy("ring")) - F.col("n")).withColumn("all", F.sum("n").over(own))
        kept = inner.where(F.col("before") < SUPPORT * F.col("all"))
        sums = kept.groupBy(*GROUP, "start").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(x))), *(F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in PAIRS))
        return _with_factor(sums)

    estimate = written(by_median.unionByName(by_all), "estimates")
    for _ in range(STEPS // 2):
        # Steps come in twos, so a table is written and looked at half as often.
        now = written(step(step(estimate)), "estimates")
        same = _matched(now, estimate.select(*GROUP, F.col("start").alias("_start"), F.col("log_det").alias("_was"))).where("start = _start")
        moved, estimate = same.where("abs(log_det - _was) > 1e-9"), now
        if moved.isEmpty():
            break
    best = Window.partitionBy(*GROUP).orderBy("log_det", "start")
    return estimate.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "start", "log_det")


def judged(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A struct ``_row`` of the columns ``keep`` of every row, its statistics, _base_failed, _distance (null: none) and _kept."""
    rows = docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in keep)).alias("_row"), docs[text].alias("_in"), docs[lang].alias("_lang"), docs[source].alias("_source"))
    stated = statistics(rows, "_in").drop("_in").withColumn("_base_failed", base_failed())
    stated = written(stated.select("*", *(c.alias(f"x{i}") for i, c in enumerate(features().values()))), "statistics")
    vectors = stated.where(~F.col("_base_failed")).groupBy(*GROUP, *(f"x{i}" for i in range(len(NAMES)))).agg(F.count("*").alias("w"))
    best = robust_estimates(written(vectors, "vectors"))
    joined = _matched(stated, best, "left").select(*stated.columns, F.when(~F.col("_base_failed"), _distance()).alias("_distance"))
    return joined.withColumn("_kept", ~F.col("_base_failed") & (F.coalesce(F.col("_distance"), F.lit(0.0)) <= LIMIT))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance of every document."""
    out = judged(docs, ["doc_id"])
    return out.select(
        F.col("_row.doc_id").alias("doc_id"), *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        F.col("_kept").alias("kept"), F.round("_distance", 4).alias("distance"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judged(docs, docs.columns).where("_kept").select("_row.*")


def oracle() -> str:
    """The same in SQL, over a table documents whose ids are distinct."""
    d = range(len(NAMES))
    floors = [f"{v}::double" for v in FEATURES.values()]
    word = r"[^\x20\x09-\x0D]+"
    grid = lambda x: f"least(greatest(round({x}), 0), {GRID})::bigint"
    sums = ", ".join([*(f"sum(n * x{i})::bigint as s{i}" for i in d), *(f"sum(n * x{i} * x{j})::bigint as p{i}{j}" for i, j in PAIRS)])
    again = ", ".join([*(f"sum(s{i})::bigint as s{i}" for i in d), *(f"sum(p{i}{j})::bigint as p{i}{j}" for i, j in PAIRS)])
    own = {(i, j): f"({CONSISTENCY}::double * (p{i}{j}::double / n - m{i} * m{j}))" for i, j in PAIRS}
    spread = lambda i: f"{floors[i]} * {floors[i]} + {list(PRIOR_SPREAD.values())[i] ** 2}::double * {PRIOR}::double / (n + {PRIOR}::double)"
    cov = [f"greatest({own[i, j]} * n / (n + {PRIOR}::double), 0.0::double) + {spread(i)} as c{i}{j}" if i == j else f"{own[i, j]} * n / (n + {PRIOR}::double) as c{i}{j}" for i, j in PAIRS]
    low = []
    for j in d:
        for i in range(j, len(NAMES)):
            rest = f"c{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            low.append(f"sqrt(greatest({rest}, 1.0::double)) as l{i}{j}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    factor = ", ".join([*(f"s{i}::double / n as m{i}" for i in d), *cov, *low, "round(" + " + ".join(f"ln(l{i}{i})" for i in d) + ", 9) as log_det"])
    fields = ", ".join(["lang", "source", "start", "log_det", *(f"m{i}" for i in d), *(f"l{i}{j}" for j in d for i in range(j, len(NAMES)))])
    z = ", ".join(f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} as z{i}" for i in d)
    distance = " + ".join(f"z{i} * z{i}" for i in d)
    group = "v.lang is not distinct from e.lang and v.source is not distinct from e.source"
    diagonal = ", ".join([*(f"med{i}::double as m{i}" for i in d), *(f"sqrt((1.4826::double * d{i}) * (1.4826::double * d{i}) + {spread(i)}) as l{i}{i}" if i == j else f"0.0::double as l{i}{j}" for j in d for i in range(j, len(NAMES)))])
    steps = []
    for k in range(1, STEPS + 1):
        steps.append(f"""r{k} as (select v.lang, v.source, start, n, {", ".join(f"x{i}" for i in d)}, {z}, floor({RINGS} * ln({distance} + 1e-6::double)) as ring from v join e{k - 1} e on {group}),
  q{k} as (select lang, source, start, ring, sum(n)::bigint as n, {sums} from (select lang, source, start, ring, n, {", ".join(f"x{i}" for i in d)} from r{k}) group by lang, source, start, ring),
  k{k} as (select *, sum(n) over (partition by lang, source, start order by ring) - n as before, sum(n) over (partition by lang, source, start) as total from q{k}),
  t{k} as (select lang, source, start, sum(n)::bigint as n, {again} from k{k} where before < {SUPPORT}::double * total group by lang, source, start),
  e{k} as (select {fields} from (select *, {factor} from t{k}))""")
    return f"""with a as (
    select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from documents),
  win as (select doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) as i, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) as x from a where len(w) >= {WINDOW}),
  many as (select doc_id, i from win qualify count(*) over (partition by doc_id, x) > 1),
  covered as (select doc_id, count(distinct i + k) as n from many, unnest(range({WINDOW})) o(k) group by doc_id),
  st as (select a.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words from a left join covered using (doc_id)),
  f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, {grid("512 * ln(word_chars::double / n_words)")} as x0, {grid(f"{GRID} * sqrt(n_symbols::double / (word_chars + n_symbols))")} as x1,
    {grid(f"{GRID} * n_dup_lines::double / n_lines")} as x2, {grid(f"{GRID} * n_repeat_words::double / n_words")} as x3 from st where n_words > 0 union all by name select *, true as base_failed, 0 as x0, 0 as x1, 0 as x2, 0 as x3 from st where n_words = 0),
  v as (select lang, source, {", ".join(f"x{i}" for i in d)}, count(*) as n from f where not base_failed group by all),
  docs as (select lang, source, {", ".join(f"x{i}" for i in d)} from f where not base_failed),
  md as (select lang, source, {", ".join(f"median(x{i}) as med{i}" for i in d)} from docs group by lang, source),
  sp as (select v.lang, v.source, {", ".join(f"any_value(med{i}) as med{i}, median(round(abs(x{i} - med{i}))) as d{i}" for i in d)}, count(*) as n from docs v join md e on {group} group by v.lang, v.source),
  t0 as (select lang, source, sum(n)::bigint as n, 1 as start, {sums} from v group by lang, source),
  e0 as (select lang, source, 0 as start, 0.0::double as log_det, {diagonal} from sp union all by name select {fields} from (select *, {factor} from t0)),
  {", ".join(steps)},
  best as (select * from e{STEPS} qualify row_number() over (partition by lang, source order by log_det, start) = 1),
  told as (select doc_id, {distance} as distance from (select v.doc_id, {z} from f v join best e on {group} where not base_failed))
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(distance, 0) <= {LIMIT}::double as kept, round(distance, 4) as distance from f left join told using (doc_id)"""


ORACLE = oracle()
