"""Nested documents as rows of path and value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hslake.sources.shared import stored

MOST_DEPTH = 16
#: Characters of the distinct documents together, by estimate, up to which they are read once each and broadcast.
FEW = 1 << 21


def by_document(rows: DataFrame, doc: str, read: Callable[[DataFrame], DataFrame], few: int = FEW) -> DataFrame:
    """``read(rows)``, where ``read`` adds columns (or rows) that depend on the text ``doc`` alone and keeps the others.

    Many connections share few documents: then each distinct one is read once and meets its rows by a broadcast. Where an estimate says that they are many, every row's is read.
    """
    n, longest = rows.agg(F.approx_count_distinct(doc), F.coalesce(F.max(F.length(doc)), F.lit(0))).first()
    if n * longest > few:
        return read(rows)
    once = stored(read(rows.select(doc).distinct()), "documents")
    same = F.col(doc).eqNullSafe(F.col("_doc"))
    return rows.join(F.broadcast(once.withColumnRenamed(doc, "_doc")), same).drop("_doc")


def leaves(df: DataFrame, doc: Column, depth: int = MOST_DEPTH) -> DataFrame:
    """``df`` with a row for every leaf of a JSON document: ``path`` (members joined by dots, elements as [n]), ``value`` as text and ``place``, which orders a document's leaves as recorded.

    Levels are opened one after the other while any row holds a deeper one, ``depth`` at most; what lies deeper is one value, its JSON text. Empty objects and lists and nulls
    are leaves of empty text. Unreadable documents have no rows.
    """
    names = df.columns
    text = F.when(F.schema_of_variant("_v") == "VOID", "").otherwise(F.coalesce(F.try_variant_get("_v", "$", "string"), F.lit("")))
    level = df.withColumn("_v", F.try_parse_json(doc)).where("_v is not null").select(*names, F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), "_v")
    out = []
    for k in range(depth):
        kind = F.schema_of_variant("_v")
        typed = level.withColumn("_kind", F.when(F.startswith(kind, F.lit("OBJECT<")), "o").when(F.startswith(kind, F.lit("ARRAY<")), "a"))
        members = F.transform(F.map_entries(F.from_json(F.to_json("_v"), "map<string,variant>")), lambda e: F.struct(F.when(F.col("path") == "", e["key"]).otherwise(F.concat("path", F.lit("."), e["key"])).alias("p"), e["value"].alias("v")))
        listed = F.transform(F.from_json(F.to_json("_v"), "array<variant>"), lambda e, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("p"), e.alias("v")))
        inner = F.when(F.col("_kind") == "o", members).when(F.col("_kind") == "a", listed)
        typed = typed.withColumn("_inner", inner)
        open_ = F.coalesce(F.size("_inner") > 0, F.lit(False))
        out.append(typed.where(~open_).select(*names, "path", F.when(F.col("_kind").isNull(), text).otherwise("").alias("value"), "place"))
        level = typed.where(open_).select(*names, "place", F.posexplode("_inner").alias("_i", "_e")).select(*names, F.col("_e.p").alias("path"), F.concat("place", F.array(F.col("_i"))).alias("place"), F.col("_e.v").alias("_v"))
    nested = F.rlike(F.schema_of_variant("_v"), F.lit("^(OBJECT|ARRAY)<"))
    out.append(level.select(*names, "path", F.when(nested, F.to_json("_v")).otherwise(text).alias("value"), "place"))
    return reduce(DataFrame.unionByName, out)


def xml_leaves(doc: Column) -> Column:
    """Array of (name, value) of the elements of an XML text that hold text and no elements, but for ``System``: the name is their Name attribute or else their own.

    XPath gives the values and the attributes; own names are read from the tags in the same order. Null for what isn't XML.
    """
    tag = r"<([A-Za-z_][\w.:-]*)((?:\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*>([^<]+)</\1\s*>"
    found = F.regexp_extract_all(doc, F.lit(tag), F.lit(0))
    name = lambda t: F.regexp_extract(t, tag, 1)
    given = lambda t: F.regexp_extract(t, r"\sName\s*=\s*[\"']([^\"']*)[\"']", 1)
    local = lambda t: F.regexp_extract(name(t), r"([^:]*)$", 1)
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    rows = F.transform(found, lambda t: F.struct(F.coalesce(F.nullif(given(t), F.lit("")), local(t)).alias("name"), plain(F.regexp_extract(t, tag, 3)).alias("value")))
    return F.filter(rows, lambda r: r["name"] != "System")
