"""Personal data: patterns, and terms that give a protected value away, in DataFrame functions only.

Values found by the patterns are the protected entities.  Every term of a document that mentions an entity, of any length
and at any distance, is judged over the whole corpus by its pointwise mutual information with it:
``PMI(e; t) = log2(p(e, t) / (p(e) p(t)))`` against what the entity itself carries, ``IC(e) = -log2 p(e)``.  A term that
discloses at least ``share`` of that information, in at least ``contexts`` documents of different terms, is found in every
document that mentions the entity: it is removed if it discloses everything, else generalised.  Copies of one document
are one of these documents, so a term is not blamed for being copied along.

Only documents with a protected value are joined with their terms; they are written once, so that patterns are not searched again
for every step, and all others pass with a projection.  A document gets those disclosing terms that it holds.  Joins by entity
are salted, for one entity may be in a large part of all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from specband.functions.scale import cut
from specband.llm.quality_rules import let

# The kinds in their order.  A look-behind or \G (end of the last match) starts a match where the plain
# pattern would start it, without trying every later character of a run; possessive loops keep the matcher's stack flat.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text has where a pattern matches; looked for first, at a fraction of the cost.
HINTS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: F.rlike(t, F.lit("[0-9][.][0-9]")), "card": lambda t: F.rlike(t, F.lit("[0-9][ -]?[0-9]")),
         "phone": lambda t: F.contains(t, F.lit("+"))}
OCTETS = rf"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})\.){{3}}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})$"
TERM = r"[\p{L}\p{N}]++"
GAP = r"[^\p{L}\p{N}]+"
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
SALTS = 16  # parts of the documents of one entity


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.rlike(m, F.lit(OCTETS))
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, k: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of a pattern's matches that ``keep`` accepts: what lies between matches and the matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(ms: Column) -> Column:
        zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(ms)).alias("gap"), ms.alias("m"))
        step = lambda acc, z: let(F.struct((acc["at"] + F.length(z["gap"])).alias("s"), F.length(z["m"]).alias("n")), lambda p: F.struct(
            (p["s"] + p["n"]).alias("at"),
            F.when(keep(z["m"]), F.concat(acc["out"], F.array(F.struct(p["s"].alias("s"), F.lit(k).alias("k"), (p["s"] + p["n"]).alias("e"), z["m"].alias("v")))))
            .otherwise(acc["out"]).cast(SPAN).alias("out")))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    return let(found, lambda ms: F.when(F.size(ms) == 0, F.array().cast(SPAN)).otherwise(place(ms)))


def base_spans(text: Column) -> Column:
    """All spans of the four patterns, by start, then kind."""
    each = []
    for k, kind in enumerate(KINDS):
        spans = matches(text, PATTERNS[kind], k, lambda m, kind=kind: valid(kind, m))
        each.append(F.when(HINTS[kind](text), spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*each))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: F.length(w) > 0)


def mentions(found: DataFrame) -> DataFrame:
    """``key, words, context, entity``: every different value of every row, with the row's terms; rows of equal terms are one context."""
    value = lambda b: F.struct(b["k"].alias("k"), F.when(b["k"] > 0, digits(b["v"])).otherwise(F.lower(b["v"])).alias("v"))
    rows = found.select("key", F.array_sort(F.array_distinct(terms(F.col("text")))).alias("words"), F.array_distinct(F.transform("base", value)).alias("entities"))
    return rows.select("key", "words", F.xxhash64("words").alias("context"), F.explode("entities").alias("entity"))


def by_entity(seen: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of ``seen`` whose entity is in ``few`` (one row an entity, repeated for every salt), with its columns."""
    parts = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return seen.withColumn("salt", F.pmod(F.hash("context", "key"), F.lit(SALTS))).join(parts, ["entity", "salt"]).drop("salt")


def disclosing_terms(docs: DataFrame, seen: DataFrame, share: float, contexts: int) -> DataFrame:
    """``entity, term, all``: terms that disclose an entity; ``all``: completely.

    Every figure counts rows, whole texts of all of them: df(t) of the corpus, df(e) and df(e, t) of those that mention the entity.
    An entity in fewer than ``contexts`` contexts has no term in so many, so its terms are not listed.
    """
    total = docs.select(F.count(F.lit(1)).alias("n"))
    ent = seen.groupBy("entity", "context").agg(F.count("*").alias("m")).groupBy("entity").agg(F.count("*").alias("c"), F.sum("m").alias("df_e"))
    ent = ent.where(F.col("c") >= contexts).select("entity", "df_e")
    groups = by_entity(seen, ent).groupBy("entity", "df_e", "context").agg(F.count("*").alias("m"), F.first("words").alias("words"))
    both = groups.select("entity", "df_e", "m", F.explode("words").alias("term")).groupBy("entity", "df_e", "term").agg(F.count("*").alias("c"), F.sum("m").alias("co"))
    words = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    n = total.scalar().cast("double")
    joined = both.where(F.col("c") >= contexts).join(words, "term")
    pmi = F.log2(F.col("co") * n / (F.col("df_t") * F.col("df_e")))
    ic = F.log2(n / F.col("df_e"))
    return joined.where((ic > 0) & (pmi >= ic * share)).select("entity", "term", (F.col("co") == F.col("df_t")).alias("all"))


def sanitise(docs: DataFrame, share: float = 0.8, contexts: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, base, added, clean_text`` and the columns of ``keep`` (in ``in``) for every row.

    ``base`` are the pattern spans, ``added`` those of disclosing terms (kind 4), both as (start, kind, end, value) in code points,
    end exclusive.  In ``clean_text`` a value is its kind in brackets, a generalised term ``[TERM]``, a removed one nothing.
    Null and empty texts have no spans and stay as they are; repeated rows get equal results; values count once per row.
    Texts are judged whole at any length; an empty table gives no rows.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), carried.alias("in"))
    found = src.withColumn("base", base_spans(F.coalesce("text", F.lit(""))))
    none = F.array().cast("array<string>")
    hits = cut(found.where(F.size("base") > 0).withColumn("key", F.monotonically_increasing_id()))
    seen = mentions(hits.select("key", "text", "base"))
    risky = cut(disclosing_terms(src.select("text"), seen, share, contexts))
    mine = by_entity(seen, risky.select("entity").distinct()).select("key", "entity", F.explode("words").alias("term"))
    per_doc = mine.join(risky, ["entity", "term"]).groupBy("key").agg(F.collect_set("term").alias("risky"), F.collect_set(F.when(F.col("all"), F.col("term"))).alias("gone"))
    hits = hits.join(per_doc, "key", "left").drop("key").withColumns({c: F.coalesce(c, none) for c in ("risky", "gone")})
    clean = found.where(F.size("base") == 0).select("doc_id", "in", "base", F.array().cast(SPAN).alias("added"), F.col("text").alias("clean_text"))
    listed = matches(F.col("text"), TERM, 4, lambda m: F.array_contains("risky", F.lower(m)))
    outside = lambda spans: F.filter(spans, lambda s: ~F.exists("base", lambda b: (b["s"] < s["e"]) & (s["s"] < b["e"])))
    hits = hits.withColumn("added", F.when(F.size("risky") == 0, F.array().cast(SPAN)).otherwise(outside(listed)))
    return hits.select("doc_id", "in", "base", "added", replaced().alias("clean_text")).union(clean).select(
        "doc_id", "base", "added", "clean_text", *(["in"] if keep else []))


def replaced() -> Column:
    """``text`` with all spans replaced, overlapping ones by the first of them."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.when((s["k"] == 4) & F.array_contains("gone", F.lower(s["v"])), F.lit("")).otherwise(F.element_at(tags, s["k"] + 1))
        put = F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["s"] - acc["at"], F.lit(0))), F.when(s["s"] >= acc["at"], tag).otherwise("")).alias("out"),
                       F.greatest(acc["at"], s["e"]).alias("at"))
        return put

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(F.array_sort(F.concat("base", "added")), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["s"].cast("string"), s["e"].cast("string"))), ",")


def digest(out: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("bigint")
    return out.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                      written(F.array_sort(F.concat("base", "added"))).alias("spans"))
