"""What publishing does to components and pages: trust scored anew, table names normalised, profiles merged, figures audited."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rounding import half_up
from tessera.functions.text import alias_key_query
from tessera.operators import trust as T

#: The least change of trust that is an event, and the entity types that are tables already.
TRUST_EVENT = 0.05
TABLE_TYPES = ["table", "config_table"]


# trust -------------------------------------------------------------------------------------------
def republish(inputs: DataFrame, stored: DataFrame, changed: DataFrame, published_at: Column) -> DataFrame:
    """(component_id, before, trust_score, trust_status, recomputed, event, delta) of all components after publishing. Only ``changed`` ones are scored anew, with
    the publishing as their audit; the others keep what is ``stored`` (component_id, trust_score, trust_status). ``inputs`` are the rows that
    :func:`tessera.operators.trust.trust` scores, with path and kind; nothing of the others is read into a score. A change of 0.05 or more from a known
    score is an event."""
    ids = changed.select("component_id").distinct()
    own = inputs.join(ids, "component_id", "left_semi").withColumn("audited", published_at.cast("timestamp"))
    fresh = own.withColumn("freshness", T.freshness_score(F.col("audited"), published_at, T.half_life(F.col("path"), F.col("kind"))))
    scored = T.trust(fresh).select("component_id", "trust_score", "trust_status", F.lit(True).alias("recomputed"))
    kept = stored.join(ids, "component_id", "left_anti").select("component_id", "trust_score", "trust_status", F.lit(False))
    before = stored.select("component_id", F.col("trust_score").alias("before"))
    delta = F.col("trust_score") - F.col("before")
    out = scored.union(kept).join(before, "component_id", "left")
    event = F.col("recomputed") & F.coalesce(F.abs(delta) >= TRUST_EVENT, F.lit(False))
    return out.select("component_id", "before", "trust_score", "trust_status", "recomputed", event.alias("event"), half_up(delta).alias("delta"))


# table names -------------------------------------------------------------------------------------
def normalise_pages(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pages whose table names are the canonical ones, wherever they stand. ``pages``: (component_id, title, facts map, entities array of (name, type),
    relationships array of (source, relation, target), dependencies array of names); ``aliases``: (table, alias).

    All names of all pages are resolved in one join on their keys. The tables that a page means are those its fact ``config_table`` names,
    its entities and relationships once resolved, and its dependencies; they become the fact in the order of their names, and every one gets an
    entity and a relationship ``configured_in`` from the page unless it has them."""
    known = aliases.select("table", alias_key_query(F.col("alias")).alias("k")).union(aliases.select("table", alias_key_query(F.col("table"))))
    known = known.where("k <> ''").groupBy("k").agg(F.min("table").alias("canonical"))
    named = lambda kind, names: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    fact = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("facts", F.lit("config_table")), F.lit("")), r"[,，;；、\n]"), lambda x: F.trim(x)), lambda x: x != "")
    ends = lambda side: F.transform("relationships", lambda r: r[side])
    names = F.concat(named("fact", fact), named("entity", F.transform("entities", lambda e: e["name"])), named("end", ends("source")), named("end", ends("target")), named("dependency", F.col("dependencies")))
    wanted = pages.select("component_id", F.explode(F.array_distinct(names)).alias("n")).select("component_id", "n.kind", "n.name", alias_key_query(F.col("n.name")).alias("k"))
    met = wanted.join(known, "k")
    # a relationship's end means a table only where its name changes
    means = (F.col("kind") != "end") | (F.col("canonical") != F.col("name"))
    found = met.groupBy("component_id").agg(F.map_from_entries(F.collect_set(F.struct("name", "canonical"))).alias("names"), F.array_sort(F.collect_set(F.when(means, F.col("canonical")))).alias("tables"))
    joined = pages.join(found, "component_id", "left")
    tables, of = F.coalesce("tables", F.array().cast("array<string>")), lambda n: F.coalesce(F.try_element_at(F.col("names"), n), n)
    kind = lambda e: F.when(F.try_element_at(F.col("names"), e["name"]).isNull() | e["type"].isin(*TABLE_TYPES), e["type"]).otherwise("config_table")
    entities = F.transform("entities", lambda e: F.struct(of(e["name"]).alias("name"), kind(e).alias("type")))
    relations = F.transform("relationships", lambda r: F.struct(of(r["source"]).alias("source"), r["relation"].alias("relation"), of(r["target"]).alias("target")))
    out = joined.select("component_id", "title", "facts", "dependencies", tables.alias("tables"), entities.alias("entities"), relations.alias("relationships"))
    missing = F.filter("tables", lambda t: ~F.exists("entities", lambda e: (e["name"] == t) & (e["type"] == "config_table")))
    more = F.filter("tables", lambda t: ~F.exists("relationships", lambda r: (r["source"] == F.col("title")) & (r["relation"] == "configured_in") & (r["target"] == t)))
    facts = F.map_concat(F.map_filter("facts", lambda k, v: k != "config_table"), F.create_map(F.lit("config_table"), F.array_join("tables", ", ")))
    return out.select(
        "component_id", "title", F.when(F.size("tables") > 0, facts).otherwise(F.col("facts")).alias("facts"),
        F.concat("entities", F.transform(missing, lambda t: F.struct(t.alias("name"), F.lit("config_table").alias("type")))).alias("entities"),
        F.concat("relationships", F.transform(more, lambda t: F.struct(F.col("title").alias("source"), F.lit("configured_in").alias("relation"), t.alias("target")))).alias("relationships"),
        "tables",
    )


# profiles ----------------------------------------------------------------------------------------
class Field(NamedTuple):
    """A field that profiles may set: its path, its type (number, int, bool, text or one of ``values``), and bounds of numbers."""

    path: str
    kind: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()


#: Profiles that a task merges, about.
MERGED = 100_000


def leaves(profiles: DataFrame, depth: int = 8, known: list[str] | None = None) -> DataFrame:
    """(project_id, level, path, value) of JSON records (project_id, level, config): one row for each value that is no record, its path with dots. What is
    no JSON record has no rows. Records are opened step by step in one pass, in which values stay as they are; ``known``: the only paths that are wanted."""
    object_ = F.schema_of_variant("v").startswith("OBJECT")
    rows = profiles.select("project_id", "level", F.lit("").alias("path"), F.try_parse_json("config").alias("v")).where(F.col("v").isNotNull()).withColumn("rec", object_).where("rec")
    for _ in range(depth):
        rows.createOrReplaceTempView("_profile_level")
        opened = rows.sparkSession.sql(
            "SELECT p.project_id, p.level, CASE WHEN p.rec THEN concat_ws('.', nullif(p.path, ''), e.key) ELSE p.path END AS path, CASE WHEN p.rec THEN e.value ELSE p.v END AS v "
            "FROM _profile_level p, LATERAL variant_explode_outer(CASE WHEN p.rec THEN p.v END) e WHERE NOT p.rec OR e.key IS NOT NULL"
        )
        rows = opened.withColumn("rec", object_)
        if known is not None:
            above = sorted({"", *(k[:i] for k in known for i, c in enumerate(k) if c == ".")})
            rows = rows.where(F.when(F.col("rec"), F.col("path").isin(*above)).otherwise(F.col("path").isin(*known)))
    return rows.where("NOT rec").select("project_id", "level", "path", F.to_json("v").alias("value"))


def merge_profiles(profiles: DataFrame, fields: list[Field]) -> DataFrame:
    """(project_id, path, value, level): the effective value of each field of each project. Of several levels (0 defaults, 1 project, 2 patch) the highest that
    has a value of the field's type wins; numbers are clamped to their bounds, whole numbers rounded half up first; unknown fields and values of another
    type are passed over, as is all that lies below a field. Values are JSON. Projects are dealt once to tasks of a bounded number of profiles, in which
    all that follows by project happens."""
    spark = profiles.sparkSession
    profiles = profiles.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-profiles.count() // MERGED)), "project_id")
    known = spark.createDataFrame([(f.path, f.kind, *(None if x is None else float(x) for x in (f.low, f.high)), list(f.values)) for f in fields], "path string, kind string, low double, high double, options array<string>")
    rows = leaves(profiles, known=[f.path for f in fields]).join(F.broadcast(known), "path")  # as many rows as there are fields
    number, text = F.col("value").try_cast("double"), F.col("value").startswith('"')
    is_number = number.isNotNull() & ~text & ~F.isnan(number)
    bare = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    fine = (
        F.when(F.col("kind").isin("number", "int"), is_number).when(F.col("kind") == "bool", F.col("value").isin("true", "false"))
        .when(F.col("kind") == "choice", text & F.array_contains("options", bare)).otherwise(text)
    )
    whole = F.floor(number + 0.5)
    clamped = F.least(F.greatest(F.when(F.col("kind") == "int", whole).otherwise(number), "low"), "high")
    shown = F.when(F.col("kind") == "int", clamped.cast("long").cast("string")).when(F.col("kind") == "number", F.to_json(F.struct(clamped.alias("v")))).otherwise(F.col("value"))
    plain = F.when(F.col("kind") == "number", F.get_json_object(shown, "$.v")).otherwise(shown)
    return rows.where(fine).withColumn("value", plain).groupBy("project_id", "path").agg(F.max_by(F.struct("value", "level"), F.struct("level", "value")).alias("best")).select("project_id", "path", "best.value", "best.level")


def nested(values: DataFrame, key: str = "project_id", deepest: int | None = None) -> DataFrame:
    """(key, config): the rows (key, path, value) as JSON records again, keys in the order of their names. ``deepest``: steps of the longest path, looked for if
    not given. A record's members are joined while all other rows stay as they are, so the rows are computed once."""
    rows = values.select(key, F.split("path", r"\.").alias("steps"), "value")
    if deepest is None:
        deepest = rows.agg(F.max(F.size("steps"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        quoted = F.concat(F.lit('"'), F.replace(F.replace(F.element_at("steps", -1), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'))
        own = F.size("steps") == depth
        member = F.struct(F.element_at("steps", -1).alias("k"), F.when(own, F.concat(quoted, "value")).otherwise(F.col("value")).alias("kv"))
        dealt = rows.select(key, F.when(own, F.slice("steps", 1, depth - 1)).otherwise(F.col("steps")).alias("steps"), own.alias("own"), member.alias("m"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["kv"]), ",")
        rows = dealt.groupBy(key, "steps", "own").agg(joined.alias("j")).select(key, "steps", F.when(F.col("own"), F.concat(F.lit("{"), "j", F.lit("}"))).otherwise(F.col("j")).alias("value"))
    return rows.select(key, F.col("value").alias("config"))


# figures -----------------------------------------------------------------------------------------
class Figure(NamedTuple):
    """A figure that is recomputed: its name, its table, an aggregate in SQL, and how far it may be from what was stated."""

    name: str
    table: str
    sql: str
    tolerance: float = 0.0


def figures(tables: dict[str, DataFrame], wanted: list[Figure]) -> DataFrame:
    """(name, value): all figures of a table in one aggregate over one scan of it."""
    out = None
    for table in sorted({f.table for f in wanted}):
        own = [f for f in wanted if f.table == table]
        row = tables[table].agg(*(F.expr(f.sql).cast("double").alias(f"f{i}") for i, f in enumerate(own)))
        rows = row.select(F.inline(F.array(*(F.struct(F.lit(f.name).alias("name"), F.col(f"f{i}").alias("value")) for i, f in enumerate(own)))))
        out = rows if out is None else out.union(rows)
    return out


def audit_figures(tables: dict[str, DataFrame], wanted: list[Figure], stated: DataFrame) -> DataFrame:
    """(name, value, stated, consistent): a figure agrees with what was stated (name, stated) within its tolerance, relative or absolute;
    one without a value (of no rows) agrees where none was stated for it."""
    limits = reduce(lambda acc, f: acc.when(F.col("name") == f.name, F.lit(float(f.tolerance))), wanted[1:], F.when(F.col("name") == wanted[0].name, F.lit(float(wanted[0].tolerance))))
    joined = figures(tables, wanted).join(stated.withColumn("_named", F.lit(True)), "name", "left")
    nothing = F.col("_named") & F.col("value").isNull() & F.col("stated").isNull()
    fine = F.coalesce(nothing, F.lit(False)) | (F.abs(F.col("value") - F.col("stated")) <= F.greatest(limits * F.abs(F.col("stated")), limits))
    return joined.select("name", "value", "stated", F.coalesce(fine, F.lit(False)).alias("consistent"))
