"""Merkle manifest of a dataset, with an inclusion proof for every document.

Leaves take their place without a global sort: histograms of the digits of their keys, one more
byte a level, add up to the exact number of leaves before each bucket, and only buckets of a
bounded size are ordered inside. The digits of a place to the base of the fanout are the path to
a trie node; nodes are reduced level by level on the prefix that they share, and paths go down
again from the root, one row for each run of leaves.

Defined results: leaves of a language ascend by doc_id, null first, then by their digest; rows
that are equal in all five columns are leaves of their own at neighbouring places. A null is
written ``-``, so it differs from an empty value. A null doc_id is never tampered with. Texts of any length are hashed
whole; an empty table gives no rows; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep

#: Leaves that a bucket may hold before its keys are told apart by one more byte.
BUCKET = 4096
SIGN = -(2**63)


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*(encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), encoded(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered, copies): equal rows are one row here. ``tampered`` is the digest
    with A-Z of the text in lower case where 3 divides the CRC-32 of the doc_id."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = docs.select("lang", "doc_id", "source", "n_chars", F.col("text").cast("string").alias("text"))
    # a third of the documents is hashed twice, and only those that hold A-Z
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").rlike("[A-Z]")
    hashed = rows.select("lang", "doc_id", leaf_digest(F.col("text")).alias("leaf"), F.when(changed, leaf_digest(F.translate("text", upper, lower))).alias("tampered"))
    return hashed.groupBy("lang", "doc_id", "leaf").agg(F.first("tampered").alias("tampered"), F.count("*").alias("copies"))


def id_key(column: str) -> Column:
    """Hexadecimal digits that sort as the long ids do, null first."""
    digits = F.lpad(F.hex(F.col(column).bitwiseXOR(F.lit(SIGN))), 16, "0")
    return F.when(F.col(column).isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), digits))


def radix_ranks(rows: DataFrame, group: str, key: str, copies: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with ``place`` (long): how many rows of the group, copies counted, have a smaller key. Keys are
    strings of hexadecimal byte pairs, different within a group."""
    ends = rows.agg(F.min(key), F.max(key), F.max(F.length(key))).first()
    if ends[0] is None:
        return rows.withColumn("place", F.lit(0).cast("long"))
    width, longest = len(os.path.commonprefix(ends[:2])) // 2 * 2, ends[2]
    above = None
    while True:
        counts = rows.groupBy(F.col(group).alias("group"), F.substring(key, 1, width).alias("prefix")).agg(F.sum(copies).alias("n"), F.count("*").alias("keys"))
        if above is None:
            # at the common prefix there is one bucket a group
            placed = counts.select("group", "prefix", "keys", F.lit(0).cast("long").alias("before"))
        else:
            before = Window.partitionBy("group", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
            inside = counts.withColumn("parent", F.substring("prefix", 1, width - 2)).withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
            upper = above.select(F.col("group").alias("g"), F.col("prefix").alias("parent"), F.col("before").alias("base"))
            placed = inside.join(upper, (inside["group"].eqNullSafe(upper["g"])) & (inside["parent"] == upper["parent"])).select("group", "prefix", "keys", (F.col("base") + F.col("inside")).alias("before"))
        above = keep(placed, "digit-counts")
        if width >= longest or above.agg(F.max("keys")).first()[0] <= bucket:
            break
        width += 2
    buckets = above.select(F.col("group").alias("_group"), F.col("prefix").alias("_bucket"), F.col("before").alias("_before"))
    joined = rows.withColumn("_prefix", F.substring(key, 1, width)).join(buckets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_prefix") == F.col("_bucket")))
    smaller = Window.partitionBy(group, "_prefix").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("place", F.col("_before") + F.coalesce(F.sum(copies).over(smaller), F.lit(0))).drop("_group", "_bucket", "_prefix", "_before")


def each_copy(rows: DataFrame, block: int = 4096) -> DataFrame:
    """A row for every copy, at neighbouring places; blocks keep the arrays short."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))))
    last = F.least(F.col("copies") - 1, (F.col("block") + 1) * block - 1)
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * block, last))).withColumn("place", F.col("place") + F.col("copy")).drop("block", "copy", "copies")


def grown(nodes: DataFrame, fanout: int, inner: tuple[str, ...] = ()) -> list[DataFrame]:
    """Levels of the tries over (group, place, n, digest), n being the group's nodes: level k has (group, place, n,
    digest, kids), kids in order with their digests and the columns ``inner`` of the first level. A group
    goes up as long as it has several nodes."""
    levels, columns = [], inner
    while True:
        kid = F.struct("place", "digest", *columns)
        runs = nodes.where("n > 1").groupBy("group", F.floor(F.col("place") / fanout).alias("up")).agg(F.first("n").alias("below"), F.sort_array(F.collect_list(kid)).alias("kids"))
        joined = F.sha2(F.concat_ws("", F.transform("kids", lambda x: x["digest"])), 256)
        level = keep(runs.select("group", F.col("up").alias("place"), F.ceil(F.col("below") / fanout).alias("n"), joined.alias("digest"), "kids"), "trie-level")
        levels.append(level)
        columns = ()
        if level.where("n > 1").isEmpty():
            return levels
        nodes = level.select("group", "place", "n", "digest")


def kid_paths(nodes: DataFrame) -> DataFrame:
    """A row for each kid of (kids, path): the kid, and its own path with the digests left and right of it first."""
    others = lambda k, from_, to: F.concat_ws("", F.transform(F.filter("kids", lambda x: (x["place"] >= from_) & (x["place"] < to)), lambda x: x["digest"]))
    kid = nodes.select("group", "path", "kids", F.explode("kids").alias("kid"))
    at = F.col("kid.place")
    step = F.struct(others("kids", F.lit(-1), at).alias("l"), others("kids", at + 1, F.lit(2**62)).alias("r"))
    return kid.select("group", "kid", F.concat(F.array(step), F.col("path")).alias("path"))


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(group, kid, path) of the first level's kids; ``tops`` is (group, path) of the roots."""
    tops = tops.select(F.col("group").alias("g"), F.col("path").alias("top"))
    below = None
    for level in reversed(levels):
        ended = level.where("n = 1")
        nodes = ended.join(tops, F.col("group").eqNullSafe(F.col("g"))).select("group", F.col("top").alias("path"), "kids")
        if below is not None:
            inner = level.where("n > 1")
            given = below.select(F.col("group").alias("g"), F.col("kid.place").alias("at"), "path")
            nodes = nodes.unionByName(inner.join(given, F.col("group").eqNullSafe(F.col("g")) & (F.col("place") == F.col("at"))).select("group", "path", "kids"))
        below = kid_paths(nodes)
        if level is not levels[0]:
            below = keep(below.select("group", F.struct("kid.place").alias("kid"), "path"), "trie-paths")
    return below


def manifest(docs: DataFrame, fanout: int = 8) -> DataFrame:
    """(doc_id, lang, leaf, tampered, subroot, root, path): path lists, from the leaf to the root, the digests left
    (l) and right (r) of the node in its run, joined."""
    found = keep(leaves(docs).withColumn("key", F.concat(id_key("doc_id"), F.col("leaf"))), "leaves")
    sizes = keep(found.groupBy("lang").agg(F.sum("copies").alias("n")), "languages")
    ranked = each_copy(radix_ranks(found, "lang", "key", "copies"))
    sized = ranked.join(sizes.withColumnRenamed("lang", "g"), F.col("lang").eqNullSafe(F.col("g")))
    first = sized.select(F.col("lang").alias("group"), "place", "n", F.col("leaf").alias("digest"), "doc_id", "tampered")
    levels = grown(first, fanout, ("doc_id", "tampered"))
    single = first.where("n = 1")
    subroots = single.select("group", "digest")
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1").select("group", "digest"))
    # languages are few or many: they take their places in the same way
    named = keep(subroots.select(F.lit(0).alias("all"), F.when(F.col("group").isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), F.hex(F.col("group").cast("binary")))).alias("key"), F.lit(1).cast("long").alias("copies"), F.col("group").alias("lang"), "digest"), "subroots")
    n_langs = named.count()
    tops = radix_ranks(named, "all", "key", "copies").select(F.col("all").alias("group"), "place", F.lit(n_langs).cast("long").alias("n"), "digest", "lang")
    empty_path = F.array().cast("array<struct<l:string,r:string>>")
    if n_langs > 1:
        upper = grown(tops, fanout, ("lang",))
        top_row = upper[-1].where("n = 1").select("group", F.col("digest").alias("root"))
        root = top_row.first()["root"]
        down = paths(upper, top_row.select("group", empty_path.alias("path")))
        tops = keep(down.select(F.col("kid.lang").alias("group"), F.col("kid.digest").alias("subroot"), "path"), "subroot-paths")
    else:
        root = next(iter(named.select("digest").collect()), [None])[0]
        tops = keep(named.select(F.col("lang").alias("group"), F.col("digest").alias("subroot"), empty_path.alias("path")), "subroot-paths")
    below = paths(levels, tops.select("group", "path")).select(F.col("group").alias("lang"), "kid.doc_id", F.col("kid.digest").alias("leaf"), "kid.tampered", "path")
    named_tops = tops.select(F.col("group").alias("g"), "subroot", F.col("path").alias("top"))
    alone = single.join(named_tops, F.col("group").eqNullSafe(F.col("g"))).select(F.col("group").alias("lang"), "doc_id", F.col("digest").alias("leaf"), "tampered", F.col("top").alias("path"))
    out = below.unionByName(alone)
    return out.join(named_tops.drop("top"), F.col("lang").eqNullSafe(F.col("g"))).select("doc_id", "lang", "leaf", "tampered", "subroot", F.lit(root).alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its path give."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x["l"], digest, x["r"]), 256))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda x: F.concat(x["l"], x["r"]))), 256)
    out = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT *, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
                      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         -- CRC-32 of the decimal doc_id: a byte goes in, then eight steps follow
         4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(lowered) || ':' || lowered END) END AS tampered
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
trie AS (
  SELECT lang, 0 AS lvl, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT lang, lvl + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 7) // 8 FROM trie WHERE n > 1 GROUP BY lang, lvl, place // 8),
subroots AS (SELECT lang, lvl AS depth, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM trie WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, place, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 7) // 8 FROM upper WHERE n > 1 GROUP BY lvl, place // 8),
beside AS (
  SELECT lang, lvl, place, coalesce(string_agg(digest, '') OVER a, '') AS l, coalesce(string_agg(digest, '') OVER b, '') AS r FROM trie WHERE n > 1
  WINDOW a AS (PARTITION BY lang, lvl, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY lang, lvl, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
above AS (
  SELECT lvl, place, coalesce(string_agg(digest, '') OVER a, '') AS l, coalesce(string_agg(digest, '') OVER b, '') AS r FROM upper WHERE n > 1
  WINDOW a AS (PARTITION BY lvl, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY lvl, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
steps AS (
  SELECT p.lang, p.place, b.lvl, b.l, b.r FROM placed p JOIN beside b ON p.lang IS NOT DISTINCT FROM b.lang AND b.place = p.place // CAST(pow(8, b.lvl) AS BIGINT)
  UNION ALL
  SELECT p.lang, p.place, s.depth + a.lvl, a.l, a.r FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN above a ON a.place = s.place // CAST(pow(8, a.lvl) AS BIGINT)),
proofs AS (SELECT lang, place, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM steps GROUP BY lang, place),
folds AS (
  SELECT lang, place, 0 AS lvl, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.lang, f.place, f.lvl + 1, sha256(s.l || f.digest || s.r) FROM folds f
  JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.place = f.place AND s.lvl = f.lvl),
ends AS (SELECT lang, place, max_by(digest, lvl) AS folded FROM folds GROUP BY lang, place)
SELECT p.doc_id, p.leaf, s.digest AS subroot, u.digest AS root, coalesce(f.proof, sha256('')) AS proof_sha256,
       e.folded AS folded_root, e.folded = u.digest AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT digest FROM upper WHERE n = 1) u ON true
JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.place = p.place
LEFT JOIN proofs f ON f.lang IS NOT DISTINCT FROM p.lang AND f.place = p.place
"""
