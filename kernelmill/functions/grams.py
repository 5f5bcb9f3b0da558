"""Strings to letter codes and n-grams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import at_most

#: Larger alphabets, and dictionaries of more grams, are refused.
MOST_LETTERS, MOST_GRAMS = 1000, 4_000_000


def letters_of(alphabet: DataFrame) -> list[str]:
    """The letters in order of letter_idx; an alphabet is a few dozen rows."""
    rows = at_most(alphabet.select("letter_idx", "letter"), MOST_LETTERS, "letters")
    letters = [r["letter"] for r in sorted(rows, key=lambda r: r["letter_idx"])]
    if not letters or any(len(x) != 1 for x in letters) or len(set(letters)) < len(letters):
        raise ValueError("an alphabet needs different single letters")
    return letters


def _code_map(letters: list[str]) -> Column:
    return F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, i)])


def chars(seq: Column | str) -> Column:
    """The letters of a string; none for an empty one."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def encode(strings: DataFrame, alphabet: DataFrame, on_invalid: str = "error") -> DataFrame:
    """Adds codes, the letter_idx of each letter. Unknown letters: an error at run time, or the row is dropped."""
    if on_invalid not in ("error", "drop"):
        raise ValueError("on_invalid is error or drop")
    letters = letters_of(alphabet)
    table = _code_map(letters)
    if on_invalid == "drop":
        return split_valid(strings, alphabet)[0].withColumn("codes", F.transform(chars("seq"), lambda c: table[c]))
    code = lambda c: F.coalesce(table[c], F.raise_error(F.concat(F.lit("letter outside the alphabet: "), c)).cast("int"))
    return strings.withColumn("codes", F.transform(chars("seq"), code))


def decode(coded: DataFrame, alphabet: DataFrame) -> DataFrame:
    """Adds seq, the string of codes."""
    letters = F.array(*[F.lit(c) for c in letters_of(alphabet)])
    return coded.withColumn("seq", F.array_join(F.transform("codes", lambda i: F.get(letters, i)), ""))


def seq_length(strings: DataFrame) -> DataFrame:
    """Adds len, the number of letters."""
    return strings.withColumn("len", F.length("seq"))


def length_range(strings: DataFrame) -> DataFrame:
    """One row: the least and greatest number of letters."""
    return strings.agg(F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"))


def split_valid(strings: DataFrame, alphabet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows all of whose letters are in the alphabet, the others). Null strings are invalid."""
    ok = F.coalesce(F.forall(chars("seq"), lambda c: c.isin(letters_of(alphabet))), F.lit(False))
    return strings.where(ok), strings.where(~ok)


def gram_dictionary(alphabet: DataFrame, n: int) -> DataFrame:
    """(gram, gram_idx) of all strings of n letters; gram_idx is the number they write in base |A|."""
    size = alphabet.count()
    if n < 1 or size**n > MOST_GRAMS:
        raise ValueError(f"n must be at least 1 and give at most {MOST_GRAMS} grams")
    one = alphabet.select("letter", F.col("letter_idx").cast("long").alias("i"))
    grams = one.select(F.col("letter").alias("gram"), F.col("i").alias("gram_idx"))
    for _ in range(n - 1):
        grams = grams.crossJoin(one).select(F.concat("gram", "letter").alias("gram"), (F.col("gram_idx") * size + F.col("i")).alias("gram_idx"))
    return grams


def places(n: int) -> Column:
    """Array of (n, pos, gram) of the grams of n letters of seq."""
    size = F.length("seq")
    at = F.sequence(F.lit(1), size - (n - 1))
    found = F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), (i - 1).alias("pos"), F.substring("seq", i, F.lit(n)).alias("gram")))
    return F.when(size >= n, found).otherwise(F.array().cast("array<struct<n:int,pos:int,gram:string>>"))


def gram_features(strings: DataFrame, min_n: int, max_n: int, positional: bool = True) -> DataFrame:
    """(id, n, pos, gram, value) for every gram of min_n to max_n letters; without positions, values are counts.

    One generating pass over the strings; only the count form shuffles, on (id, n, gram) after partial sums.
    """
    if not 1 <= min_n <= max_n:
        raise ValueError("1 <= min_n <= max_n is needed")
    grams = F.flatten(F.array(*[places(n) for n in range(min_n, max_n + 1)]))
    rows = strings.select("id", F.explode(grams).alias("g")).select("id", "g.n", "g.pos", "g.gram")
    if positional:
        return rows.withColumn("value", F.lit(1.0))
    return rows.groupBy("id", "n", "gram").agg(F.count("*").cast("double").alias("value"))


def gram_counts(strings: DataFrame, n: int) -> DataFrame:
    """(id, gram, value): how often each string holds each gram of n letters."""
    return gram_features(strings, n, n, positional=False).drop("n")


def positional_grams(strings: DataFrame, n: int) -> DataFrame:
    """(id, pos, gram, value 1) for each place of each string."""
    return gram_features(strings, n, n).drop("n")


def normalize_features(features: DataFrame, self_k: DataFrame) -> DataFrame:
    """Values divided by the square root of the string's kernel with itself; self_k: (id, k)."""
    return features.join(self_k, "id").withColumn("value", F.col("value") / F.sqrt("k")).drop("k")


def gram_column_index(features: DataFrame, alphabet: DataFrame, n: int) -> DataFrame:
    """Adds col_idx = pos * |A|^n + gram_idx, arithmetic on the letters' codes without a join."""
    letters = letters_of(alphabet)
    table, size = _code_map(letters), len(letters)
    index = F.aggregate(chars("gram"), F.lit(0).cast("long"), lambda a, c: a * size + table[c])
    return features.withColumn("col_idx", F.col("pos").cast("long") * size**n + index)
