"""Quality rules, line first, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import SPACE

# The line rules.
ENDS = [".", "!", "?", ":", ";", ",", ")", "]", "}", '"', "'", "\u2019", "\u201d", "\u2026", "\u3002"]
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|\u00bb\u203a\u2022>"
SIGNS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "accept cookies", "use cookies", "use of cookies",
    "cookie consent", "enable javascript", "lorem ipsum", "subscribe to our newsletter",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl\u00e4rung", "cookies akzeptieren", "verwendet cookies", "verwendung von cookies",
    "tous droits r\u00e9serv\u00e9s", "conditions d'utilisation", "politique de confidentialit\u00e9", "accepter les cookies", "utilise des cookies",
    "todos los derechos reservados", "t\u00e9rminos de uso", "pol\u00edtica de privacidad", "aceptar cookies", "utiliza cookies", "uso de cookies",
]
NOTICE = "(\u00a9|[(][cC][)]) ?(19|20)[0-9]{2}"
BLANK = " \t\n\x0b\x0c\r"
#: Words of a line that may belong to a menu, of a field between separators, and characters of a line that may be boilerplate.
MENU_WORDS, FIELD_WORDS, NOTICE_CHARS = 3, 4, 200


def _words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def _bare(line: Column) -> Column:
    """A line without white space at its ends; only lines that have some are trimmed, which costs more."""
    edge = F.substring(line, 1, 1).isin(*BLANK) | F.substring(line, -1, 1).isin(*BLANK)
    return F.when(edge, F.btrim(line, F.lit(BLANK))).otherwise(line)


def _count(t: Column, chars: str) -> Column:
    return F.length(t) - F.length(F.translate(t, chars, ""))


def _any_of(low: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for x in phrases:
        found = found | low.contains(x)
    return found


def _lines(text: Column) -> Column:
    """Array of (line, t, seps, n, short): t is the bare line; n, its words, is counted where a rule asks for it; short, whether it
    could be an entry of a menu."""
    # one step after another, so that no part is worked out twice for a line
    bare = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _bare(x).alias("t")))
    ends = F.transform(
        bare,
        lambda s: F.struct(
            s["line"].alias("line"),
            s["t"].alias("t"),
            _count(s["t"], SEPARATORS).alias("seps"),
            ((s["t"] != "") & ~F.substring(s["t"], -1, 1).isin(ENDS)).alias("open"),
        ),
    )
    counted = F.transform(
        ends,
        lambda s: F.struct(
            s["line"].alias("line"),
            s["t"].alias("t"),
            s["seps"].alias("seps"),
            s["open"].alias("open"),
            F.when(s["open"] | (s["seps"] >= 2), F.size(F.split(s["t"], SPACE + "+"))).alias("n"),
        ),
    )
    return F.transform(
        counted,
        lambda s: F.struct(
            s["line"].alias("line"),
            s["t"].alias("t"),
            s["seps"].alias("seps"),
            s["n"].alias("n"),
            (s["open"] & (s["n"] <= MENU_WORDS)).alias("short"),
        ),
    )


def _judged(lines: Column, phrases: list[str] | None) -> Column:
    """Array of (line, t, why): why is the reason why the line goes, or null: punctuation, navigation or boilerplate.

    phrases: None if the text holds no notice or phrase at all; its lines are then not searched for one.
    """

    def why(s: Column, i: Column) -> Column:
        t = s["t"]
        beside = F.coalesce(F.get(lines, i - 1)["short"], F.lit(False)) | F.coalesce(F.get(lines, i + 1)["short"], F.lit(False))
        noted = F.lit(False) if phrases is None else t.rlike(NOTICE) | _any_of(F.lower(t), phrases)
        return (
            F.when(t == "", F.lit(None))
            .when((10 * _count(t, SYMBOLS) > F.length(t)) | (2 * _count(t, SIGNS) > F.length(t)), F.lit("punctuation"))
            .when(((s["seps"] >= 2) & (s["n"] <= FIELD_WORDS * (s["seps"] + 1))) | (s["short"] & beside), F.lit("navigation"))
            .when((F.length(t) <= NOTICE_CHARS) & noted, F.lit("boilerplate"))
            .when(s["short"] & (s["n"] < 3), F.lit("punctuation"))
        )

    return F.transform(lines, lambda s, i: F.struct(s["line"].alias("line"), s["t"].alias("t"), why(s, i).alias("why")))


def _repeat_words(n: Column, hashes: Column) -> Column:
    """Words in 8-word windows that stand twice or more in the text."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(hashes)
    shifted = lambda a, k: F.slice(a, 1 + k, size - 1)
    # (h, i) sorted: a window repeats if its neighbour on either side has its hash
    after = F.zip_with(shifted(pairs, 0), shifted(pairs, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull()))))
    return F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(8), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def judge_quality(docs: DataFrame, text: str = "text", max_lost: float = 0.5, phrases: list[str] = PHRASES) -> DataFrame:
    """Struct `row` (all columns), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean (the text of the lines that stay), n_bad_lines, lost (share of the word characters removed), kept.

    Line rules come first. Punctuation: over a tenth of a line are symbols, over half of it is no letter, or it
    is one or two words without closing punctuation. Navigation: two or more separators with a few words a field, or a
    line of up to three words without closing punctuation next to another such line. Boilerplate: a line of up to 200
    characters with a copyright notice of a year or one of `phrases` (lower case; those given are of four languages, other corpora
    pass their own). A document is then kept if it didn't fail the base rules and lost at most
    max_lost of its word characters. Windows of eight words are compared within a text by 64-bit
    hashes. No shuffle and no Python. A null or empty text has no words: base_failed, clean is null or
    empty, lost is 0. Repeated rows are judged one by one.
    """
    src = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("t"))
    src = src.select("row", "t", F.lower("t").alias("low"), _words(F.col("t")).alias("w"), _lines(F.col("t")).alias("l"))
    noted = F.col("t").rlike(NOTICE) | _any_of(F.col("low"), phrases)  # once a text, so not inside the function of a line
    src = src.select("row", "t", "w", F.when(noted, _judged(F.col("l"), phrases)).otherwise(_judged(F.col("l"), None)).alias("l"))
    n = F.coalesce(F.greatest(F.size("w"), F.lit(0)), F.lit(0))
    chars = lambda c: F.length(F.regexp_replace(c, SPACE + "+", ""))
    src = src.select(
        "row",
        "t",
        "l",
        n.cast("long").alias("n_words"),
        F.when(n >= 9, F.transform("w", lambda x: F.xxhash64(x))).alias("h"),
        F.array_join(F.transform(F.filter("l", lambda x: x["why"].isNull()), lambda x: x["line"]), "\n").alias("clean"),
    )
    for k in (1, 2, 4):  # hashes of one word, then of two, four and eight
        size = F.size("h") - k
        pairs = F.zip_with(F.slice("h", 1, size), F.slice("h", 1 + k, size), lambda a, b: F.xxhash64(a, b))
        src = src.withColumn("h", F.when(F.col("h").isNotNull(), pairs))
    worded = F.transform(F.filter("l", lambda x: x["t"] != ""), lambda x: x["line"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    src = src.select(
        "row",
        "n_words",
        "clean",
        zero(chars(F.col("t"))).alias("word_chars"),
        zero(chars(F.col("clean"))).alias("clean_chars"),
        zero(_count(F.col("t"), SYMBOLS)).alias("n_symbols"),
        zero(F.when(F.col("t").isNotNull(), F.size(worded) - F.size(F.array_distinct(worded)))).alias("n_dup_lines"),
        zero(
            F.when(F.size("h") > F.size(F.array_distinct("h")), _repeat_words(F.col("n_words"), F.col("h")))
        ).alias("n_repeat_words"),
        zero(F.when(F.col("t").isNotNull(), F.size(F.filter("l", lambda x: x["why"].isNotNull())))).alias("n_bad_lines"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("clean_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    return src.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "clean",
        "n_bad_lines",
        lost.alias("lost"),
        (~failed & (lost <= max_lost)).alias("kept"),
    )
