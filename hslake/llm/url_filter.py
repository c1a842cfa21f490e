"""URL filter by path-template trees and labelled purity, in DataFrame functions only.

Explicit rules come first; the longest that fits wins. Other URLs get the verdict of their host's path template: segments of digits or
hexadecimal ids become wildcards, then, level by level, so do segments that are one of very many below their node and segments whose
labelled bad share does not differ from their siblings' (two standard errors): similar branches are merged. A template is blocked if its
bad share, smoothed towards the overall share, is at least ``block_share``.

Counts per (host, typed path) are made before any level, so a hot host costs its distinct paths. Every level of every path is read; paths that have
ended leave the loop, so a few deep paths cost a few small rounds. Null URL or no ``://``: empty host and path, judged like any other. Null ids
stay. No labels: nothing but rules blocks. No pages: no rows. Repeated rows: each is returned. Very long URLs: read whole. Ties between rules can't
be, as one of equal length that fits is the same rule. Other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, join_measured

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern, verdict)
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MANY_CHILDREN, ERRORS = 24, 2.0


def host_path(url: str) -> tuple[Column, Column]:
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, what in sorted(rules, key=lambda r: len(r[0])):
        name, slash, tail = pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def typed_path(path: Column) -> Column:
    """Segments of digits become {n}, of eight or more hexadecimal digits {x}; an extension stays."""
    path = F.regexp_replace(path, r"(?<=/)[0-9]+(?=[/.]|\z)", "{n}")
    return F.regexp_replace(path, r"(?<=/)[0-9a-f]{8,}(?=[/.]|\z)", "{x}")


def templates(typed: DataFrame) -> DataFrame:
    """(host, typed, n, lab, bad, template) from (host, typed, n, lab, bad), one row per distinct typed path."""
    now, ended, level = typed.withColumn("segs", F.split("typed", "/")).withColumn("template", F.lit("")), [], 2
    while True:
        ended.append(now.where(F.size("segs") < level).drop("segs"))
        here = now.where(F.size("segs") >= level).withColumn("seg", F.col("segs")[level - 1])
        if not here.head(1):
            break
        child = here.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        node = child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
        share = F.col("all_bad") / F.col("all_lab")
        differs = (F.col("lab") > 0) & (F.abs(F.col("bad") / F.when(F.col("lab") > 0, F.col("lab")) - share) > ERRORS * F.sqrt(share * (1 - share) / F.when(F.col("lab") > 0, F.col("lab"))))
        wild = (F.col("kids") > 1) & (((F.col("kids") >= MANY_CHILDREN) & (F.col("n") * MANY_CHILDREN < F.col("all_n"))) | ~F.coalesce(F.when(F.col("all_lab") > 0, differs), F.lit(False)))
        named = child.join(node, ["host", "template"]).select("host", "template", "seg", F.concat("template", F.lit("/"), F.when(wild, F.lit("*")).otherwise(F.col("seg"))).alias("grown"))
        now = cut(here.join(named, ["host", "template", "seg"]).drop("seg", "template").withColumnRenamed("grown", "template"), "level")
        level += 1
    return reduce(DataFrame.unionByName, ended)


def filter_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_good: str = "quality", rules: list[tuple[str, str]] = RULES, weight: float = 4.0, block_share: float = 0.5) -> DataFrame:
    """(id, host, path, rule, template, bad_share, verdict), one row per page. Labels: 1 good, 0 bad."""
    host, path = host_path(url_col)
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("typed", typed_path(F.col("path")))
    known = labels.where(F.col(label_good).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg((F.min(label_good) == 0).cast("long").alias("bad"))
    typed = parts.join(known, "id", "left").groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    tree = cut(templates(cut(typed, "typed")), "tree")
    total = tree.agg((F.sum("bad") / F.when(F.sum("lab") > 0, F.sum("lab"))).alias("prior"))
    pure = tree.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total))
    pure = pure.select("host", "template", ((F.col("bad") + weight * F.coalesce("prior", F.lit(0.0))) / (F.col("lab") + weight)).alias("bad_share"))
    judged = cut(tree.join(pure, ["host", "template"]).select("host", "typed", "template", "bad_share"), "judged")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = join_measured(parts, judged, ["host", "typed"], "left")
    return out.select("id", "host", "path", rule.alias("rule"), "template", "bad_share", F.coalesce(verdict, F.when(F.col("bad_share") >= block_share, "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return filter_urls(pages, labels).select(F.col("id").alias("page_id"), "host", "path", "rule", "template", F.round("bad_share", 9).alias("bad_share"), "verdict")


def _oracle(levels: int = 8) -> str:
    """SQL for tables whose paths have at most ``levels`` levels; the given ones have three."""
    rule, verdict = "null", "null"
    for pattern, what in sorted(RULES, key=lambda r: len(r[0])):
        name, slash, tail = pattern.partition("/")
        fits = f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{tail}')"
        rule, verdict = f"case when {fits} then '{pattern}' else {rule} end", f"case when {fits} then '{what}' else {verdict} end"
    sql = f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
s as (select *, list_transform(string_split(path, '/'), lambda x, i: case when i > 1 and regexp_matches(x, '^[0-9]+([.].*)?$') then regexp_replace(x, '^[0-9]+', '{{n}}')
  when i > 1 and regexp_matches(x, '^[0-9a-f]{{8,}}([.].*)?$') then regexp_replace(x, '^[0-9a-f]{{8,}}', '{{x}}') else x end) as segs from p),
k as (select doc_id, case when min(quality) = 0 then 1 else 0 end as bad from labels where quality is not null group by doc_id),
t1 as (select host, segs, count(*) as n, count(bad) as lab, coalesce(sum(bad), 0) as bad, '' as template from s left join k on doc_id = page_id group by host, segs)"""
    for d in range(2, levels + 2):
        sql += f""",
c{d} as (select host, template, segs[{d}] as seg, sum(n) as n, sum(lab) as lab, sum(bad) as bad from t{d - 1} where len(segs) >= {d} group by all),
v{d} as (select *, count(*) over w as kids, sum(n) over w as all_n, sum(lab) over w as all_lab, sum(bad) over w as all_bad from c{d} window w as (partition by host, template)),
w{d} as (select host, template, seg, kids > 1 and ((kids >= {MANY_CHILDREN} and n * {MANY_CHILDREN} < all_n) or not coalesce(lab > 0 and abs(bad / lab - all_bad / all_lab) > {ERRORS} * sqrt((all_bad / all_lab) * (1 - all_bad / all_lab) / lab), false)) as wild from v{d}),
t{d} as (select t.host, segs, n, lab, bad, t.template || '/' || case when wild then '*' else seg end as template from t{d - 1} t join w{d} w on w.host = t.host and w.template = t.template and w.seg = t.segs[{d}] where len(segs) >= {d}
  union all select host, segs, n, lab, bad, template from t{d - 1} where len(segs) < {d})"""
    return sql + f""",
u as (select host, segs, lab, bad, template from t{levels + 1}),
g as (select host, template, (sum(bad) + 4.0 * (select sum(bad) / sum(lab) from u)) / (sum(lab) + 4.0) as bad_share from u group by all)
select page_id, s.host, path, {rule} as rule, u.template, round(bad_share, 9) as bad_share, coalesce({verdict}, case when bad_share >= 0.5 then 'block' else 'allow' end) as verdict
from (select page_id, host, path, segs from s) s join (select distinct host, segs, template from u) u on u.host = s.host and u.segs = s.segs join g on g.host = u.host and g.template = u.template""".replace("{rule}", rule).replace("{verdict}", verdict)


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": _oracle().replace("case when (host", "case when (s.host").replace(" ends_with(host", " ends_with(s.host")}
