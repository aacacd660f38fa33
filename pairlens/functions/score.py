"""Exact match, token F1 and buckets."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank, split_words


def common_tokens(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: (acc + F.least(count(p, t), count(g, t))).cast("int"))


def exact_match(p: Column, golds: Column) -> Column:
    """p: tokens of the prediction, golds: an array of token arrays. 1 if any gold has the same tokens (both may be empty)."""
    return F.coalesce(F.exists(golds, lambda g: g == p), F.lit(False)).cast("int")


def f1(p: Column, g: Column) -> Column:
    c = common_tokens(p, g)
    return F.when(c > 0, 2.0 * c / (F.size(p) + F.size(g))).otherwise(F.lit(0.0))


def four_digits(x: Column) -> Column:
    """x to the nearest ten-thousandth, of two as near to the even one, reckoned in doubles as SQL's round_even does. bround()
    goes by the shortest decimal form: 1892 / 3200 is a little above the tie of 0.59125, but would be rounded down."""
    return F.rint(x * 10000.0) / 10000.0


def token_f1(p: Column, golds: Column) -> Column:
    return four_digits(F.coalesce(F.array_max(F.transform(golds, lambda g: f1(p, g))), F.lit(0.0)))


def token_f1_exploded(rows: DataFrame, key: str, p: str, g: str) -> DataFrame:
    """key, f1 for one gold each: for texts so long that the array form's product of lengths costs too much."""
    return bag_f1(rows, key, {"f1": (p, g)})


def common_sorted(p: Column, g: Column) -> Column:
    """common_tokens() by one sort of both sides' words, for arrays that have many in common. No word is null."""
    state = "struct<t:string,free:int,n:int>"
    tagged = lambda a, side: F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))

    def step(acc: Column, x: Column) -> Column:
        # of a word p's come first; each of g's takes one of them
        free = F.when(acc["t"] == x["t"], acc["free"]).otherwise(0)
        taken = F.when((x["side"] == 1) & (free > 0), 1).otherwise(0)
        return F.struct(x["t"].alias("t"), F.when(x["side"] == 0, free + 1).otherwise(free - taken).alias("free"), (acc["n"] + taken).alias("n")).cast(state)

    start = F.struct(F.lit(None).alias("t"), F.lit(0).alias("free"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(F.sort_array(F.concat(tagged(p, 0), tagged(g, 1))), start, step, lambda acc: acc["n"])


#: Words in common, of what is left of a pair, that are looked up one by one.
MANY = 64


def bag_f1(rows: DataFrame, key: str, pairs: dict[str, tuple[str, str]], keep: tuple[Column, ...] = ()) -> DataFrame:
    """key (one row each), what is to be kept and, by name, the token F1 of each pair of columns (prediction, gold), whose words
    aren't null. No text moves, and each is read once: a word that stands at the same place on both sides counts there. What is
    left is short where one side is an edited copy of the other, or has few words in common; such words are looked up one by
    one. Of pairs that have more than MANY, the words left are sorted, so that time grows little faster than the texts."""
    sides, one = sorted({c for pair in pairs.values() for c in pair}), range(len(pairs))
    none = F.array().cast("array<string>")
    held = rows.select(key, *keep, *(F.coalesce(F.col(c), none).alias(f"_s{k}") for k, c in enumerate(sides)))
    kept, ps, gs = held.columns[1 : 1 + len(keep)], *([f"_s{sides.index(pair[k])}" for pair in pairs.values()] for k in (0, 1))
    # columns that more than one later column reads, so that none is computed again for every word
    apart = lambda p, g: F.filter(F.zip_with(p, g, lambda a, b: F.when(~a.eqNullSafe(b), F.struct(a.alias("p"), b.alias("g")))), lambda x: x.isNotNull())
    held = held.withColumns({f"_a{k}": F.when(F.col(ps[k]) != F.col(gs[k]), apart(ps[k], gs[k])) for k in one})
    left = lambda k, side: F.coalesce(F.filter(F.transform(f"_a{k}", lambda x: x[side]), lambda t: t.isNotNull()), none)
    held = held.select(key, *kept, *(F.size(c[k]).alias(f"_n{side}{k}") for k in one for side, c in (("p", ps), ("g", gs))), *(left(k, side).alias(f"_{side}{k}") for k in one for side in "pg"))
    held = held.withColumns({f"_b{k}": F.array_intersect(f"_p{k}", f"_g{k}") for k in one})
    count = lambda c, t: F.size(F.filter(c, lambda x: x == t))
    few = lambda k: F.aggregate(f"_b{k}", F.lit(0), lambda n, t: n + F.least(count(f"_p{k}", t), count(f"_g{k}", t)))
    same = {k: F.col(f"_np{k}") - F.size(f"_p{k}") + F.when(F.size(f"_b{k}") > MANY, common_sorted(F.col(f"_p{k}"), F.col(f"_g{k}"))).otherwise(few(k)) for k in one}
    held = held.select(key, *kept, *(same[k].alias(f"_same{k}") for k in one), *((F.col(f"_np{k}") + F.col(f"_ng{k}")).alias(f"_size{k}") for k in one))
    f1 = [F.when(F.col(f"_same{k}") > 0, 2.0 * F.col(f"_same{k}") / F.col(f"_size{k}")).otherwise(F.lit(0.0)) for k in one]
    return held.select(key, *kept, *(four_digits(f1[k]).alias(name) for k, name in enumerate(pairs)))


def f1_level(value: Column) -> Column:
    return F.when(value >= 0.8, "high").when(value >= 0.2, "mid").otherwise("low")


def answer_length_bucket(answers: Column) -> Column:
    """By the shortest answer that isn't blank; none: short."""
    n = F.array_min(F.transform(F.filter(answers, lambda a: ~blank(a)), lambda a: F.size(split_words(a))))
    return F.when(n.isNull() | (n <= 1), "short").when(n <= 5, "medium").when(n <= 15, "long").otherwise("very_long")


def corrupted_answers(answers: Column) -> Column:
    bad = lambda a: blank(a) | F.rlike(a, F.lit("<[^>]+>")) | F.rlike(a, F.lit("(?i)parsoid"))
    return F.coalesce(F.size(answers), F.lit(0)).__le__(0) | F.coalesce(F.exists(answers, bad), F.lit(False))


def _picked(rows: DataFrame, key: list[str], order: str, by) -> DataFrame:
    """One row of each key, chosen before the shuffle in each task already. Of strings in the key the digest is grouped by."""
    kinds = dict(rows.dtypes)
    digest = [F.md5(F.col(k)) if kinds[k] == "string" else F.col(k) for k in key]
    out = rows.groupBy(*(d.alias(f"_k{i}") for i, d in enumerate(digest))).agg(by(F.struct(*rows.columns), F.struct(order)).alias("_row"))
    return out.select("_row.*")


def last_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return _picked(rows, key, order, F.max_by)


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return _picked(rows, key, order, F.min_by)
