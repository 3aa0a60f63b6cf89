"""Longest common subsequences and the ratios built on them, as Column expressions without Python workers.

The places of each character of one string are bits of words of 62 (so that a sum of two stays a long); the other string is
folded over them, one addition, subtraction and bit operation a character and word.  Texts of any length are words one behind
the other, with a carry from each to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 62
FULL = (1 << WORD) - 1


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: inside of a lambda an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def characters(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1))))


def _places(chars: Column) -> Column:
    """struct(n, keys, words): the distinct characters, and for each its places as words."""

    def words(k: Column) -> Column:
        def of(b: Column) -> Column:
            bits = F.transform(F.slice(chars, (b * WORD + 1).cast("int"), F.lit(WORD)), lambda c, i: F.when(c == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
            return F.aggregate(bits, F.lit(0).cast("bigint"), lambda x, y: x + y)

        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(chars), F.lit(1)) - 1) / WORD).cast("int")), of)

    return bound(F.array_distinct(chars), lambda keys: F.struct(F.size(chars).alias("n"), keys.alias("keys"), F.transform(keys, words).alias("words")))


def _start(p: Column) -> Column:
    """No place is matched yet: a word of ones for each word."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(p["n"], F.lit(1)) - 1) / WORD).cast("int")), lambda _: F.lit(FULL))


def _merge(free: Column, hit: Column) -> Column:
    return (free + hit).bitwiseOR(free - hit)


def _step(free: Column, words: Column) -> Column:
    """Free places after one more character, whose places are `words`."""
    one = bound(F.get(free, F.lit(0)), lambda f: F.array(_merge(f, f.bitwiseAND(F.get(words, F.lit(0)))).bitwiseAND(F.lit(FULL))))

    def word(acc: Column, b: Column) -> Column:
        f = F.get(free, b)
        hit = f.bitwiseAND(F.get(words, b))
        total = f + hit + acc["carry"]
        return F.struct(F.shiftright(total, WORD).alias("carry"), F.array_append(acc["out"], total.bitwiseOR(f - hit).bitwiseAND(F.lit(FULL))).alias("out"))

    none = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
    return F.when(F.size(free) == 1, one).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(free) - 1), none, word)["out"])


def _read(p: Column, free: Column, ch: Column) -> Column:
    return bound(F.array_position(p["keys"], ch).cast("int"), lambda at: F.when(at == 0, free).otherwise(_step(free, F.get(p["words"], at - 1))))


def _matched(free: Column) -> Column:
    """Matched places: the zeros of the words, as bits beyond the string stay ones."""
    return F.aggregate(free, F.lit(0), lambda n, w: n + WORD - F.bit_count(w))


def _common(p: Column, chars: Column) -> Column:
    return _matched(F.aggregate(chars, _start(p), lambda free, ch: _read(p, free, ch)))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, which are not null."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    both = bound(characters(shorter), lambda s: bound(_places(s), lambda p: _common(p, characters(longer))))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).when(a == b, F.length(a)).otherwise(both)


def ratio(a: Column, b: Column) -> Column:
    """200 * common / (sum of lengths); 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common_length(a, b) / total)


def _score(matched: Column, n: Column, width: Column) -> Column:
    return 200.0 * matched / (n + width)


def _clipped(s: Column, t: Column) -> Column:
    """Best ratio of s with a prefix of t that is shorter than s: one fold gives them all."""

    def of(p: Column) -> Column:
        def read(acc: Column, ch: Column) -> Column:
            return bound(_read(p, acc["free"], ch), lambda free: F.struct(free.alias("free"), (acc["i"] + 1).alias("i"), F.greatest(acc["top"], _score(_matched(free), p["n"], acc["i"] + 1)).alias("top")))

        return F.aggregate(F.slice(t, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.struct(_start(p).alias("free"), F.lit(0).alias("i"), F.lit(0.0).alias("top")), read)["top"]

    return bound(_places(s), of)


def _windows(s: Column, t: Column) -> Column:
    """Best ratio of the characters s with windows of t that are as long as s.

    A window is not read once the best is 100, nor if the characters that s has at all give no better than the best.
    """

    def of(p: Column) -> Column:
        def better(best: Column, i: Column) -> Column:
            def read(w: Column) -> Column:
                most = F.size(F.filter(w, lambda c: F.array_contains(p["keys"], c)))
                return F.when(_score(most, p["n"], p["n"]) <= best, best).otherwise(F.greatest(best, _score(_common(p, w), p["n"], p["n"])))

            return F.when(best >= 100.0, best).otherwise(bound(F.slice(t, i + 1, p["n"]), read))

        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(t) - F.size(s), F.lit(0))), F.lit(0.0), better)

    return bound(_places(s), of)


def partial_ratio(a: Column, b: Column) -> Column:
    """the best ratio of the shorter string with a window of the longer one, windows clipped at its ends included; equal lengths are tried both ways."""
    n, m = F.length(a), F.length(b)
    # Which one is shorter is settled on the strings: expressions that differ by swapped variables only count as the same one to the optimizer.
    short, long = F.when(n <= m, a).otherwise(b), F.when(n <= m, b).otherwise(a)

    def of(x: Column, y: Column) -> Column:
        # Those clipped at the start are prefixes, those at the end prefixes of the reverse; of equal lengths, either is the window.
        pair = lambda s, t: F.struct(s.alias("s"), t.alias("t"))
        ways = F.array(pair(x, y), pair(F.reverse(x), F.reverse(y)), pair(y, x), pair(F.reverse(y), F.reverse(x)))
        some = F.slice(ways, F.lit(1), F.when(F.size(x) == F.size(y), 4).otherwise(2))
        whole = lambda best: F.when(best >= 100.0, best).otherwise(F.greatest(best, F.array_max(F.transform(some, lambda w: _clipped(w["s"], w["t"])))))
        return bound(_windows(x, y), whole)

    best = bound(characters(short), lambda x: bound(characters(long), lambda y: of(x, y)))
    # A contained string is a window of its own.
    found = F.when(F.contains(long, short), F.lit(100.0)).otherwise(best)
    return F.when((n == 0) | (m == 0), F.when(n == m, 100.0).otherwise(0.0)).otherwise(found)


def _words(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


def counted(s: Column) -> Column:
    """The distinct characters of a string, each with its number."""
    return bound(characters(s), lambda chars: F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), F.size(F.filter(chars, lambda x: x == c)).alias("n"))))


def shared_characters(of: Column, s: Column) -> Column:
    """How many characters the counted string and s have in common, in any order: no common subsequence is longer."""
    return F.aggregate(of, F.lit(0), lambda n, x: n + F.least(x["n"], F.length(s) - F.length(F.replace(s, x["c"], F.lit("")))))


def most_ratio(of: Column, a: Column, b: Column) -> Column:
    """No less than ratio(a, b); of: the counted characters of a."""
    return F.when(F.length(a) + F.length(b) == 0, 100.0).otherwise(200.0 * shared_characters(of, b) / (F.length(a) + F.length(b)))


def most_partial_ratio(of: Column, a: Column, b: Column, shared: Column | None = None) -> Column:
    """No less than partial_ratio(a, b): a window of w characters has no more than w of the shared ones, and best as many.  shared: their number, if known."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 100.0).otherwise(bound(F.least(n, shared_characters(of, b) if shared is None else shared), lambda m: 200.0 * m / (n + m)))


def most_token_set_ratio(of: Column, a: Column, b: Column, shared: Column | None = None) -> Column:
    """No less than token_set_ratio(a, b): the rests share what the strings do beyond the words of both.  shared: the number of shared characters, if known."""
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    solid = (shared_characters(of, b) if shared is None else shared) - F.least(blanks(a), blanks(b))
    return _token_set(a, b, lambda p: F.greatest(F.lit(0), F.least(F.length(p["a"]), F.length(p["b"]), solid - F.length(F.replace(p["both"], F.lit(" "), F.lit(""))) + F.least(blanks(p["a"]), blanks(p["b"])))))


def token_set_ratio(a: Column, b: Column) -> Column:
    """ratio of the sets of words; 100 if one holds the other.

    What both have stands in front on either side, so it is common as it is, and only the rests are compared.
    """
    return _token_set(a, b, lambda p: common_length(p["a"], p["b"]))


def _token_set(a: Column, b: Column, rest: Callable[[Column], Column]) -> Column:

    def of(x: Column, y: Column) -> Column:
        parts = F.struct(*[F.array_join(F.array_sort(w), " ").alias(k) for k, w in (("both", F.array_intersect(x, y)), ("a", F.array_except(x, y)), ("b", F.array_except(y, x)))])

        def score(p: Column) -> Column:
            gap = F.when(p["both"] == "", 0).otherwise(1)  # the blank between
            shared = F.length(p["both"])
            left, right = shared + gap + F.length(p["a"]), shared + gap + F.length(p["b"])
            rests = 200.0 * (shared + gap + rest(p)) / (left + right)
            bases = [200.0 * shared / (shared + side) for side in (left, right)]
            return F.when((p["both"] != "") & ((p["a"] == "") | (p["b"] == "")), F.lit(100.0)).when(p["both"] == "", rests).otherwise(F.greatest(rests, *bases))

        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(bound(parts, score))

    return bound(_words(a), lambda x: bound(_words(b), lambda y: of(x, y)))
