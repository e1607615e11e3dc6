"""Line-first quality rules in DataFrame functions only.

Every line is judged alone; lines that fail go, and a document goes when too much of its text went or when it
fails a rule about the whole text.  Documents are never moved: there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from specband.llm.common import id_text

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Phrases of boilerplate lines, lower case: this library's own choice.
BOILERPLATE = (
    "licensed under the", "all rights reserved", "copyright (c)", "terms of service", "terms of use", "privacy policy", "cookie policy",
    "accept cookies", "use of cookies", "enable javascript", "lorem ipsum", "click here to", "subscribe to our", "sign up for our",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds; a line or text fails beyond them."""

    min_words: int = 50
    max_repeat_percent: int = 50  # words inside repeated three-word windows
    line_symbols_per_word: float = 0.2  # decorated prose has one or more symbols a word
    nav_cells: int = 3  # separators that make a line a menu or table row
    upper_percent: int = 70  # capitals among letters of a line, once it has min_shout_letters
    min_shout_letters: int = 40
    max_lost_percent: int = 30  # characters of failed lines
    max_dup_line_percent: int = 30  # repeated lines among lines with a word, from min_dup_lines on
    min_dup_lines: int = 3
    min_mean_chars: float = 2.0
    max_mean_chars: float = 15.0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Words covered by three-word windows that occur twice or more: sort window hashes, keep the equal neighbours."""

    def covered(ix: Column) -> Column:
        # sorted window starts: each adds min(3, distance to the next start), the last one 3
        return F.aggregate(ix, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("end")),
                           lambda acc, s: F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] + 3 - s)).cast("bigint").alias("n"), s.alias("end")),
                           lambda acc: acc["n"])

    def windows(ws: Column) -> Column:
        return F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, ws[i + 1], ws[i + 2]))

    def placed(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeats(s: Column) -> Column:
        prev = F.concat(F.array(F.lit(None).cast("bigint")), s["h"])
        nxt = F.concat(F.slice(s["h"], 2, F.size(s)), F.array(F.lit(None).cast("bigint")))
        pairs = F.arrays_zip(s.alias("s"), prev.alias("p"), nxt.alias("q"))
        hit = F.filter(pairs, lambda z: F.coalesce(z["s"]["h"] == z["p"], F.lit(False)) | F.coalesce(z["s"]["h"] == z["q"], F.lit(False)))
        return F.array_sort(F.transform(hit, lambda z: z["s"]["i"]))

    def counted(h: Column) -> Column:
        # most texts repeat no window: only the others are sorted
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(placed(h), lambda s: let(repeats(s), covered)))

    return F.when(F.size(ws) < 3, F.lit(0).cast("bigint")).otherwise(let(windows(ws), counted))


def count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are among ``chars`` (ASCII)."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


NAVIGATION = "|»›•"


def holds(text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def suspicious(text: Column, rules: Rules = Rules()) -> Column:
    """False only for texts none of whose lines can fail: what every failing line needs is looked for in the whole text.

    A line without k capitals in a row (other signs between them do not count) has at most (k - 1) / k of its letters and one more as
    capitals, so under the default thresholds a shouting line has three.
    """
    share = lambda k: (k - 1) / k * (1 + 1 / rules.min_shout_letters) * 100
    capitals = r"[^\p{L}]*".join([r"\p{Lu}"] * max([k for k in (1, 2, 3) if share(k) <= rules.upper_percent], default=0))
    return (count_of(text, SYMBOLS) > 2) | holds(text, NAVIGATION) | F.rlike(text, F.lit(capitals)) | holds(F.lower(text), BOILERPLATE)


def line_verdicts(text: Column, rules: Rules = Rules()) -> Column:
    """Array of (line, kept) structs, one per line of the text; dear conditions stand behind cheap ones that they imply."""

    def judge(line: Column) -> Column:
        symbols = count_of(line, SYMBOLS)
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        nav = holds(line, NAVIGATION) & (count_of(line, NAVIGATION) >= rules.nav_cells)
        punctuation = (symbols > 2) & (symbols > rules.line_symbols_per_word * F.size(F.split(F.trim(line), SPACES)) + 2)
        shout = (F.length(line) >= rules.min_shout_letters) & (letters >= rules.min_shout_letters) & (upper * 100 > letters * rules.upper_percent)
        boiler = (F.length(line) < 200) & holds(F.lower(line), BOILERPLATE)
        return F.struct(line.alias("line"), (~(nav | punctuation | boiler | shout)).alias("ok"))

    return F.transform(F.split(text, "\n"), judge)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: base counts, ``base_failed``, ``kept`` and ``clean_text`` (the lines that passed).

    Null and empty texts have no words and fail; lines without words always pass and count nothing; repeated rows
    are judged alike.  ``keep`` names input columns to carry along; they are nested while the rules run.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"), carried.alias("in"))
    # arrays are built once per row: each step is behind a generator-free projection the optimizer cannot inline into lambdas
    w = base.select("doc_id", "t", "in", let(words(F.col("t")), lambda ws: F.struct(
        F.size(ws).cast("bigint").alias("n_words"), repeated_words(ws).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("bigint").alias("word_chars"), count_of(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0),
            lambda ls: F.struct(F.size(ls).cast("bigint").alias("lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("dups"))).alias("l"),
        F.when(suspicious(F.col("t"), rules), let(line_verdicts(F.col("t"), rules), lambda v: F.struct(
            F.aggregate(v, F.lit(0), lambda a, x: a + F.when(x["ok"], 0).otherwise(F.length(x["line"]))).alias("lost"),
            F.array_join(F.transform(F.filter(v, lambda x: x["ok"]), lambda x: x["line"]), "\n").alias("clean")))).otherwise(
            F.struct(F.lit(0).alias("lost"), F.col("t").alias("clean"))).alias("v"))
    n, rep = F.col("w.n_words"), F.col("w.n_repeat_words")
    failed = (n < rules.min_words) | (rep * 100 > n * rules.max_repeat_percent)
    lost = F.col("v.lost") * 100 > F.length("t") * rules.max_lost_percent
    dups = (F.col("l.dups") >= rules.min_dup_lines) & (F.col("l.dups") * 100 > F.col("l.lines") * rules.max_dup_line_percent)
    shape = (F.col("word_chars") < n * rules.min_mean_chars) | (F.col("word_chars") > n * rules.max_mean_chars)
    out = w.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.dups").alias("n_dup_lines"), rep.alias("n_repeat_words"),
                   failed.alias("base_failed"), (~failed & ~lost & ~dups & ~shape).alias("kept"), F.col("v.lost").cast("bigint").alias("n_lost_chars"),
                   F.col("v.clean").alias("clean_text"), "in")
    return out if keep else out.drop("in")
