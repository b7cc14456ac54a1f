"""Personal data by fixed forms and by contexts that known identifiers induce, in DataFrame functions only.

Spans of the four base forms are the seeds. Words that look like identifiers are instances, the
words around them patterns, and both form a graph: a pattern counts for the share of identifiers among
all different words that stand in its place, an instance for the best pattern it is found by. An instance that no pattern
has spoken for yet is neither for nor wholly against a pattern: it weighs a quarter of a plain word. Scores go back
and forth for a fixed number of rounds in whole millionths, so results do not depend on the order of sums.
Instances of patterns that stay at ``min_confidence`` with ``min_support`` different identifiers are new spans.

Forms of patterns: the word before, the two words before, the word before with the word after, and the two words
after. Words are taken in lower case and by their 32 nearest code points. An identifier has 4 to 64 code points, and
a digit, an underscore, an at sign (or its paraphrase) or a dot between letters.

Defined results: a null or empty text has no spans. Offsets count code points. Rows are judged one by one and
repeated rows get equal results; a null doc_id is an id of its own. Copies of a text count once in the graph, since only
different identifiers and different words do. New spans that overlap a base span are left out. Texts of any length are read whole;
an empty table gives no rows; extra columns play no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep

# fixed values: the base forms, written so that no text makes a match step back over what it has read
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

MARK = "\x01"
BLANK = "\x20\t\n\x0b\f\r"
SHAPED = r"[0-9@_]|[A-Za-z]\.[A-Za-z]|[\[(][Aa][Tt][\])]"
#: A word with the shape of an identifier and the numbers after it, or a paraphrased address.
CANDIDATE = (
    r"(?<!\S)(?:\S++\x20(?:at|\[at\]|\(at\))\x20\S++\x20(?:dot|\[dot\]|\(dot\))\x20\S++"
    r"|(?=\S*?(?:" + SHAPED + r"))\S++(?:\x20\(?[0-9][0-9().-]*+(?!\S))*+)"
)
NEAR = 64
#: Elements that prefix sums take at a time.
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def running_starts(lengths: Column) -> Column:
    """For each element the sum of those before it; in blocks, so that long arrays take n^1.5 steps instead of n^2."""
    size = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    before = lambda xs: F.aggregate(xs, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum")), lambda a, x: F.struct(F.array_append(a["out"], a["sum"]).alias("out"), (a["sum"] + x).alias("sum")))
    inner = F.transform(blocks, before)
    outer = before(F.transform(inner, lambda x: x["sum"]))["out"]
    return F.flatten(F.zip_with(inner, outer, lambda x, o: F.transform(x["out"], lambda v: v + o)))


def _pieces(text: Column, form: str) -> Column:
    """The text cut so that every second piece is a match."""
    return F.split(F.regexp_replace(text, F.lit(f"({form})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))).between(0, 3) & (F.coalesce(F.right(x, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _forms() -> list[tuple[str, str]]:
    return list(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))


def _matches(n: int, kind: str) -> Column:
    """Spans of one kind from its pieces and their places."""
    every = F.zip_with(f"pieces_{kind}", f"starts_{kind}", lambda p, s: F.struct(s.alias("start"), F.lit(n).alias("kind"), (s + F.char_length(p)).alias("end"), p.alias("value")))
    found = F.filter(every, lambda x, i: (i % 2 == 1) & _valid(kind, x["value"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: an array of (start, kind, end), kinds by their place in :data:`KINDS`."""
    out = docs
    for kind, form in _forms():
        sign = {"email": "@", "phone": "+", "ip": "."}.get(kind, "")  # no match lacks it
        out = out.withColumn(f"pieces_{kind}", F.when(F.contains(F.col(text), F.lit(sign)), _pieces(F.col(text), form)).otherwise(F.array().cast("array<string>")))
    for kind, _ in _forms():
        starts = running_starts(F.transform(f"pieces_{kind}", F.char_length))
        out = out.withColumn(f"starts_{kind}", F.when(F.size(f"pieces_{kind}") > 1, starts).otherwise(F.array().cast("array<int>")))
    spans = [_matches(n, kind) for n, kind in enumerate(KINDS)]
    helpers = [f"{x}_{kind}" for x in ("pieces", "starts") for kind in KINDS]
    return out.withColumn("base", F.array_sort(F.concat(*spans)).cast(SPAN)).drop(*helpers)


def _cleaned(docs: DataFrame, *columns: str) -> DataFrame:
    """The text with the mark replaced by another control character, so that offsets stay."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, "\x03")
    return docs.select(*columns, text.alias("text"))


def _patterns(l2: Column, l1: Column, r1: Column, r2: Column) -> Column:
    """The patterns of a place from the words around it; an absent word makes what needs it null."""
    joined = lambda form, *words: F.concat(F.lit(form), words[0], *(F.concat(F.lit(" "), w) for w in words[1:]))
    return F.array(joined("1:", l1), joined("2:", l2, l1), joined("b:", l1, r1), joined("r:", r1, r2))


def _short(word: Column, after: bool) -> Column:
    return F.left(word, F.lit(32)) if after else F.right(word, F.lit(32))


def candidates(docs: DataFrame) -> DataFrame:
    """(id, text_key, start, end, value, kind, patterns) of all identifier-shaped words; kind is that of a base form inside it,
    else null."""
    cut = _cleaned(docs, "id", "text_key").withColumn("pieces", _pieces(F.col("text"), CANDIDATE)).where("size(pieces) > 1").select("id", "text_key", "pieces")
    placed = cut.withColumn("starts", running_starts(F.transform("pieces", F.char_length)))
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    at = F.sequence(F.lit(1), F.size("pieces") - 1, F.lit(2))
    whole = F.transform(at, lambda i: F.struct(
        F.get("starts", i).alias("start"), piece(i).alias("value"),
        F.concat(*(F.right(piece(i - k), F.lit(NEAR)) for k in (3, 2, 1))).alias("left"),
        F.concat(*(F.left(piece(i + k), F.lit(NEAR)) for k in (1, 2, 3))).alias("right")))
    rows = placed.select("id", "text_key", F.inline(whole))
    # punctuation around the word is not part of it, but for a plus sign and brackets round a number
    lead = F.length(F.regexp_extract("value", r"^(?:(?!\([0-9]+\))[\p{Punct}&&[^+]])*+", 0))
    core = F.regexp_replace(F.expr(f"substring(value, {1} + lead)"), r"(?<!\p{Punct})\p{Punct}++$", "")
    rows = rows.where(F.char_length("value") <= 2 * NEAR).withColumn("lead", lead).withColumn("core", core).where(F.char_length("core").between(4, NEAR))
    # where the word is not cut off from its neighbours, they are whole words too
    before = F.filter(F.split(F.lower("left"), f"[{BLANK}]+"), lambda w: w != "")
    after = F.filter(F.split(F.lower("right"), f"[{BLANK}]+"), lambda w: w != "")
    kind = reduce(lambda rest, k: F.when(_holds(*k), F.lit(KINDS.index(k[0]))).otherwise(rest), reversed(_forms()), F.lit(None).cast("int"))
    words = rows.select("id", "text_key", (F.col("start") + F.col("lead")).alias("start"), F.col("core").alias("value"), before.alias("before"), after.alias("after"))
    near = words.select("id", "text_key", "start", (F.col("start") + F.char_length("value")).alias("end"), "value", kind.alias("kind"), _patterns(
        *(_short(F.try_element_at("before", F.lit(-k)), False) for k in (2, 1)), *(_short(F.try_element_at("after", F.lit(k)), True) for k in (1, 2))).alias("patterns"))
    return near


def _holds(kind: str, form: str) -> Column:
    found = F.regexp_extract("value", f"({form})", 1)
    return (found != "") & _valid(kind, found)


def places(docs: DataFrame, before: list[str] | None = None, after: list[str] | None = None) -> DataFrame:
    """(pattern, word): each word by the patterns of its place. With ``before`` and ``after`` only places next to these words."""
    words = F.split(F.btrim(F.lower("text"), F.lit(BLANK)), f"[{BLANK}]+", -1)
    listed = _cleaned(docs).select(words.alias("w")).where("size(w) > 1")
    absent = lambda n: F.array(*[F.lit(None).cast("string")] * n)
    behind = lambda n: F.slice("w", n + 1, F.size("w"))
    around = F.arrays_zip(F.col("w"), F.concat(absent(2), "w"), F.concat(absent(1), "w"), behind(1), behind(2))
    rows = listed.select(F.inline(around).alias("word", "l2", "l1", "r1", "r2")).where("word IS NOT NULL")
    l2, l1, r1, r2 = (_short(F.col(c), c[0] == "r") for c in ("l2", "l1", "r1", "r2"))
    if before is not None:
        rows = rows.where(l1.isin(before) | r1.isin(after))
    return rows.select(F.explode(_patterns(l2, l1, r1, r2)).alias("pattern"), F.left("word", F.lit(NEAR)).alias("word")).where("pattern IS NOT NULL")


def plain_words(docs: DataFrame, patterns: DataFrame, few: int = 10_000) -> DataFrame:
    """(pattern, plain): how many different words without an identifier's shape stand in the place of each pattern. No more than
    ``few`` patterns are broadcast, and the words next to their places looked for first; more are joined by a shuffle."""
    if patterns.count() <= few:
        # the neighbouring word is the last one of patterns that look back, and the first one of those that look on
        back, first = F.col("pattern").rlike("^[12b]"), F.substring("pattern", 3, 1 << 20)
        near = F.when(F.col("pattern").startswith("2"), F.split_part(first, F.lit(" "), F.lit(2))).otherwise(F.split_part(first, F.lit(" "), F.lit(1)))
        sides = patterns.select(back.alias("back"), near.alias("word")).distinct().collect()
        every = places(docs, [r["word"] for r in sides if r["back"]], [r["word"] for r in sides if not r["back"]]).join(F.broadcast(patterns), "pattern")
    else:
        every = places(docs).join(patterns, "pattern")
    # the shape is looked at last: only few words stand in these places
    counts = every.distinct().groupBy("pattern").agg(F.count(F.when(~F.col("word").rlike(SHAPED), 1)).alias("n"))
    return patterns.join(counts, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("plain"))


def seeded(docs: DataFrame) -> DataFrame:
    """Documents that hold a base form."""
    return docs.where(reduce(lambda a, b: a | b, (F.col("text").rlike(form) for form in (EMAIL, IP, r"[0-9](?:[\x20-]?+[0-9]){13}", PHONE))))


def looked_up(docs: DataFrame, patterns: DataFrame, min_confidence: float) -> DataFrame:
    """(pattern, plain) of (pattern, ids). The words of documents with a base form alone show that most patterns cannot reach the
    confidence, since no pattern's score is over its ids; only the others are looked up in all documents."""
    some = keep(patterns.join(plain_words(seeded(docs), patterns.select("pattern")), "pattern"), "plain-words")
    open_ = F.col("ids") >= min_confidence * (F.col("ids") + F.col("plain")) - 1e-6
    left = some.where(open_).select("pattern")
    out = some.where(~open_).select("pattern", "plain")
    return out if left.isEmpty() else keep(out.unionByName(plain_words(docs, left)), "plain-words")


def accepted_patterns(docs: DataFrame, edges: DataFrame, rounds: int, min_confidence: float, min_support: int) -> DataFrame:
    """(pattern, confidence, order) of the accepted patterns, confidence in millionths; order is 3 less the place of the kind, so that the
    largest (confidence, order) is the best kind listed first. ``edges``: (pattern, value, kind), different pairs."""
    million, least = 1_000_000, int(min_confidence * 1_000_000)
    kinds = range(len(KINDS))
    reach = plain = None
    for _ in range(rounds):
        if reach is None:
            scores = edges.select("pattern", (F.lit(3) - F.col("kind")).alias("order"), F.when(F.col("kind").isNotNull(), million).otherwise(0).alias("score"))
        else:
            score = F.when(F.col("kind").isNotNull(), million).otherwise(F.coalesce("best.confidence", F.lit(0)))
            scores = edges.join(reach, "value", "left").select("pattern", F.coalesce(F.lit(3) - F.col("kind"), "best.order").alias("order"), score.alias("score"))
        weights = [F.sum(F.when(F.col("order") == 3 - k, F.col("score")).otherwise(0)).alias(f"w{k}") for k in kinds]
        sums = scores.groupBy("pattern").agg(F.sum("score").alias("total"), F.count(F.when(F.col("score") >= least, 1)).alias("support"), F.count("*").alias("ids"), F.sum(F.when(F.col("score") > 0, 4).otherwise(1)).alias("quarters"), *weights)
        # a pattern's place is looked up once it has support enough
        able = keep(sums.where(F.col("support") >= min_support), "able-patterns")
        fresh = able.select("pattern", "ids") if plain is None else able.select("pattern", "ids").join(plain, "pattern", "left_anti")
        if plain is None or not fresh.isEmpty():
            counted = looked_up(docs, fresh, min_confidence)
            plain = counted if plain is None else plain.unionByName(counted)
        best = F.greatest(*(f"w{k}" for k in kinds))
        order = reduce(lambda rest, k: F.when(F.col(f"w{k}") == best, F.lit(3 - k)).otherwise(rest), reversed(kinds), F.lit(0))
        confidence = F.call_function("div", F.col("total") * 4, F.col("quarters") + F.col("plain") * 4)
        accepted = keep(able.join(plain, "pattern").select("pattern", confidence.alias("confidence"), order.alias("order")).where(F.col("confidence") >= least), "patterns")
        if accepted.isEmpty():
            break
        reach = edges.where("kind IS NULL").join(accepted, "pattern").groupBy("value").agg(F.max(F.struct("confidence", "order")).alias("best"))
    return accepted


def discovered(docs: DataFrame, rounds: int = 3, min_confidence: float = 0.5, min_support: int = 3) -> DataFrame:
    """(id, text_key, start, kind, end) of the identifiers that patterns find beyond the base forms."""
    found = keep(candidates(docs), "candidates")
    edges = keep(found.select("value", "kind", F.explode("patterns").alias("pattern")).where("pattern IS NOT NULL").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pattern-edges")
    accepted = accepted_patterns(docs, edges, rounds, min_confidence, min_support)
    open_ = found.where("kind IS NULL").select("id", "text_key", "start", "end", F.explode("patterns").alias("pattern"))
    best = F.max(F.struct("confidence", "order"))["order"]
    return open_.join(accepted, "pattern").groupBy("id", "text_key", "start", "end").agg((F.lit(3) - best).cast("int").alias("kind")).select("id", "text_key", "start", "kind", "end")


def personal_data(docs: DataFrame, rounds: int = 3, min_confidence: float = 0.5, min_support: int = 3) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end), in order; ``spans`` holds the base ones and the new ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").alias("id"), "text", F.sha2(text, 256).alias("text_key"))
    base = base_spans(_cleaned(named, "id", "text_key")).drop("text")
    new = discovered(named, rounds, min_confidence, min_support).groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    other = new.select(F.col("id").alias("other_id"), F.col("text_key").alias("other_key"), "new")
    joined = base.join(other, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("text_key") == F.col("other_key")), "left")
    free = F.filter(F.coalesce("new", F.array().cast(SPAN)), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    return joined.select(F.col("id").alias("doc_id"), "base", F.array_sort(F.concat("base", free)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op13_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
