"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares an integer feature ratio with a cutoff from a fixed grid, ordered from lenient to strict. The labelled
documents that pass the base rules are the holdout. For every stratum and rule, cutoffs are tested in that fixed order: a cutoff
stands if the exact binomial (Clopper-Pearson) upper bound of its false-rejection rate, at ``delta`` divided by the number of
strata times rules (Bonferroni), is at most ``epsilon`` divided by the number of rules; testing stops at the first that doesn't, so nested
cutoffs need no further correction. The strictest standing cutoff of which at least ``min_precision`` of the rejected holdout is bad is used.
A document is rejected if any rule rejects it, and the rules' rates add up to ``epsilon`` at most: with probability 1 - ``delta`` no stratum
loses more than ``epsilon`` of its good documents to all rules together.

Null text: no words, so the base rules fail. Null stratum: a stratum of its own, apart from an empty one. Repeated labels of a document: it is good
only if all say so. Documents without a label are judged but don't calibrate. No labels: only base rules reject. No documents: no rows. Repeated
rows and ties: judged alike. Very long texts: read whole. Other columns aren't read, but for those to ``carry``, whose names must differ from the results'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut

BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: name: (numerator, factor, denominator, above, cutoffs from lenient to strict); rejects if factor * numerator > (or <) cutoff * denominator
RULES: dict[str, tuple[str, int, str, bool, list[int]]] = {
    "symbols": ("n_symbols", 100, "n_words", True, [400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 15, 10]),
    "repeats": ("n_repeat_words", 100, "n_words", True, [45, 40, 35, 30, 25, 20, 15, 10]),
    "dup_lines": ("n_dup_lines", 1000, "n_words", True, [200, 150, 100, 80, 60, 50, 40, 30, 20, 10]),
    "long_words": ("word_chars", 10, "n_words", True, [200, 150, 120, 110, 100, 95, 90, 85, 80, 75, 70, 65, 60]),
    "short_words": ("word_chars", 10, "n_words", False, [15, 20, 25, 28, 30, 32, 34, 36, 38, 40]),
}


def text_features(text: str = "text") -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text.

    Lambda arguments bind the word and hash arrays once a row; the sort runs only where a 3-word window repeats.
    """
    body = f"coalesce({text}, '')"
    covered = """
        aggregate(sort_array(transform(filter(sequence(0, size(s) - 1),
            i -> (i > 0 and s[i - 1].h = s[i].h) or (i < size(s) - 1 and s[i + 1].h = s[i].h)), i -> s[i].p)),
          named_struct('n', 0L, 'to', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.to), 'to', p + 3), a -> a.n)"""
    repeats = f"""
        if(size(w) < 3, 0L, transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
          if(size(array_distinct(h)) = size(h), 0L,
            transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i)))), s -> {covered})[0]))[0])"""
    lines = f"""
        transform(array(filter(split({body}, '\\n'), x -> length(translate(x, ' \\t\\n\\u000b\\u000c\\r', '')) > 0)),
          x -> cast(size(x) - size(array_distinct(x)) as bigint))[0]"""
    return F.expr(f"""
        transform(array(filter(split({body}, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')), w -> named_struct(
          'n_words', cast(size(w) as bigint),
          'word_chars', cast(length(translate({body}, ' \\t\\n\\u000b\\u000c\\r', '')) as bigint),
          'n_symbols', cast(length({body}) - length(translate({body}, '{SYMBOLS}', '')) as bigint),
          'n_dup_lines', {lines},
          'n_repeat_words', {repeats}))[0]""")


def with_features(docs: DataFrame, id_col: str, text_col: str, stratum_col: str | None, carry: tuple[str, ...] = ()) -> DataFrame:
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")) if stratum_col else F.lit("")
    f = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), *carry, text_features(f"`{text_col}`").alias("f")).select("id", "stratum", *carry, "f.*")
    return f.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def rejects(rule: str, cutoff: Column) -> Column:
    top, factor, below, above, _ = RULES[rule]
    a, b = factor * F.col(top), cutoff * F.col(below)
    return a > b if above else a < b


def binomial_at_most(k: str, n: str, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), exact but for rounding: a running log-sum over the terms."""
    return F.expr(f"""
        aggregate(sequence(0, cast({k} as int)), named_struct('t', {n} * ln(1 - {p}D), 's', double('-Infinity')),
          (a, i) -> named_struct(
            't', a.t + ln(greatest({n} - i, 1) / (i + 1D)) + ln({p}D / (1 - {p}D)),
            's', greatest(a.s, a.t) + ln(1 + exp(least(a.s, a.t) - greatest(a.s, a.t)))),
          a -> a.s)""")


def select_cutoffs(features: DataFrame, labels: DataFrame, epsilon: float, delta: float, min_precision: float) -> DataFrame:
    """(stratum, rule, cutoff) chosen from the holdout: one row at most for a stratum and rule."""
    share = epsilon / len(RULES)
    holdout = features.join(labels.groupBy("id").agg(F.min("good").alias("good")), "id").where("not base_failed")
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).cast("long").alias("cutoff")) for r, spec in RULES.items() for i, c in enumerate(spec[4])]))
    hit = F.lit(False)
    for rule in RULES:
        hit = F.when(F.col("rule") == rule, rejects(rule, F.col("cutoff"))).otherwise(hit)
    counts = (
        holdout.select("stratum", "good", *[c for c in features.columns if c.startswith(("n_", "word"))], steps.alias("s")).select("*", "s.*")
        .groupBy("stratum", "rule", "step", "cutoff")
        .agg(F.sum("good").cast("long").alias("n"), F.sum(F.when(hit, F.col("good")).otherwise(0)).cast("long").alias("k"), F.sum(F.when(hit, 1 - F.col("good")).otherwise(0)).cast("long").alias("bad"))
    )
    m = counts.agg(F.count_distinct("stratum", "rule").alias("m"))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    tested = counts.crossJoin(F.broadcast(m)).withColumn("stands", (F.col("k") < share * F.col("n")) & F.coalesce(F.when(F.col("k") < share * F.col("n"), binomial_at_most("k", "n", share)) <= F.log(F.lit(delta) / F.col("m")), F.lit(False)))
    chain = tested.withColumn("stands", F.min(F.col("stands").cast("int")).over(order) == 1)
    good = chain.where(F.col("stands") & (F.col("bad") > 0) & (F.col("bad") >= min_precision * (F.col("bad") + F.col("k"))))
    return good.groupBy("stratum", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_id: str = "doc_id", label_good: str = "quality", epsilon: float = 0.01, delta: float = 0.05, min_precision: float = 0.9, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id``, its features, ``base_failed``, the rules that reject it, ``kept`` and the columns ``carry``.

    Labels hold 1 for good and 0 for bad; null labels are left out. The result of the holdout is a small table (strata times rules).
    """
    features = cut(with_features(docs, id_col, text_col, stratum_col, carry), "features")
    known = labels.select(F.col(label_id).alias("id"), F.col(label_good).cast("int").alias("good")).where("id is not null and good is not null")
    chosen = select_cutoffs(features, known, epsilon, delta, min_precision)
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES])
    wide = cut(wide, "cutoffs")
    judged = features.join(wide, "stratum", "left")
    judged = judged.withColumn("failed_rules", F.expr("filter(array(" + ", ".join(f"case when {_sql(r)} then '{r}' end" for r in RULES) + "), x -> x is not null)"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept", *carry)


def _sql(rule: str) -> str:
    top, factor, below, above, _ = RULES[rule]
    return f"{factor} * {top} {'>' if above else '<'} c_{rule} * {below}"


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules(docs, labels)
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    grid = ", ".join(f"('{r}', {i}, {c})" for r, spec in RULES.items() for i, c in enumerate(spec[4]))
    hit = "case rule " + " ".join(f"when '{r}' then {f} * {t} {'>' if a else '<'} cutoff * {b}" for r, (t, f, b, a, _) in RULES.items()) + " end"
    return rf"""
with recursive d as (select doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where c > 1) group by doc_id),
dup as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
f as (select d.doc_id, stratum, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from d join w using (doc_id) left join rep using (doc_id) left join dup using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
grid(rule, step, cutoff) as (values {grid}),
h as (select b.*, good from b join (select doc_id, min(quality) as good from labels where quality is not null group by doc_id) using (doc_id) where not base_failed),
c as (select stratum, rule, step, cutoff, sum(good) as n, sum(case when {hit} then good else 0 end) as k, sum(case when {hit} then 1 - good else 0 end) as bad from h, grid group by all),
m as (select count(distinct (stratum, rule)) as m from c),
p as (select stratum, rule, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.002) + (n - i) * ln(0.998))) as p from (select *, unnest(range(0, cast(k + 1 as bigint))) as i from c where k < 0.002 * n) group by all),
t as (select c.*, min(case when p.p <= 0.05 / m then 1 else 0 end) over (partition by stratum, rule order by step) as stands from c cross join m left join p using (stratum, rule, step)),
chosen as (select stratum, rule, max_by(cutoff, step) as cutoff from t where stands = 1 and bad > 0 and bad >= 0.9 * (bad + k) group by all),
failed as (select distinct doc_id from b join chosen using (stratum) where {hit})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from failed) as kept from b"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": _oracle()}
