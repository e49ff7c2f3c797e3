"""Names: normaliser chains, similarities and colours, as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def java_replacement(text: str) -> str:
    """A sed replacement (``\\1``, ``&``) in Java's notation."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            out.append(f"${text[i]}" if text[i].isdigit() else re.sub(r"([\\$])", r"\\\1", text[i]))
        elif c == "&":
            out.append("$0")
        else:
            out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


def normalise(name: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """All rules in order, each everywhere and regardless of case, then lower case."""
    for pattern, replacement in rules:
        name = F.regexp_replace(name, F.lit(f"(?i){pattern}"), F.lit(java_replacement(replacement)))
    return F.lower(name)


def normalise_names(rows: DataFrame, column: str, rules: Sequence[tuple[str, str]], out: str) -> DataFrame:
    """The chain runs once for each distinct name, then joins back."""
    names = rows.select(column).distinct().withColumn(out, normalise(F.col(column), rules))
    return rows.join(names, column, "left")


_BREAK = r"[ \-,;()/.]"


def _within(short: Column, long: Column) -> Column:
    """``short`` begins or ends ``long`` at a word's border."""
    n, m = F.length(short), F.length(long)
    starts = F.startswith(long, short) & F.substring(long, n + 1, F.lit(1)).rlike(_BREAK)
    ends = F.endswith(long, short) & F.substring(long, m - n, F.lit(1)).rlike(_BREAK)
    return (n > 0) & (m > n) & (starts | ends)


def line_similar(a: Column, b: Column) -> Column:
    """Equal, or one begins or ends the other at a word's border."""
    return (a == b) | _within(a, b) | _within(b, a)


def station_similar(a: Column, b: Column) -> Column:
    """As :func:`line_similar`, or an edit distance below a twentieth of the longer name."""
    longest = F.greatest(F.length(a), F.length(b))
    return line_similar(a, b) | ((longest > 0) & (F.levenshtein(a, b) / longest < 0.05))


def any_similar(names: Column, others: Column) -> Column:
    """Some name of one array of names is similar to some of the other."""
    return F.exists(names, lambda a: F.exists(others, lambda b: station_similar(a, b)))


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_of(tokens(a), tokens(b))


def jaccard_of(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens, cut beforehand where a name meets many others."""
    both = F.array_size(F.array_intersect(a, b))
    union = F.array_size(a) + F.array_size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def jaccard_same(a: Column, b: Column) -> Column:
    return jaccard(a, b) > 0.45


def jaccard_near(a: Column, b: Column, metres: Column) -> Column:
    """Mean of the names' and the places' similarity above a half; without a place, the names' alone."""
    return tokens_near(tokens(a), tokens(b), metres)


def tokens_near(a: Column, b: Column, metres: Column) -> Column:
    """As :func:`jaccard_near`, of arrays of distinct tokens."""
    like = jaccard_of(a, b)
    return F.when(metres.isNull(), like > 0.45).otherwise((F.exp(F.lit(-0.0081546727) * metres) + like) / 2 > 0.5)


def edit_same(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(True)).otherwise(1 - F.levenshtein(a, b) / longest > 0.85)


def prefix_distance(a: Column, b: Column) -> Column:
    """Least number of edits from a to a prefix of b."""
    return F.array_min(F.transform(F.sequence(F.lit(0), F.length(b)), lambda n: F.levenshtein(a, F.substring(b, F.lit(1), n))))


def prefix_same(a: Column | str, b: Column | str) -> Column:
    """1 - the smaller prefix edit distance, relative to the name that is matched whole, above 0.875."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    one = lambda x, y: prefix_distance(x, y) / F.greatest(F.length(x), F.lit(1))
    return 1 - F.least(one(a, b), one(b, a)) > 0.875


def word_runs(name: Column) -> Column:
    """All runs of words of a name that follow one another, each once."""
    words = F.regexp_extract_all(name, F.lit(r"(?U)(\w+)"))
    n = F.size(words)
    ends = lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), ends)))
    return F.when(n > 0, runs).when(n == 0, F.array().cast("array<string>"))


def best_subsequence(a: Column, b: Column) -> Column:
    """Best edit similarity of a run of words of one name with the other name; 0 without words."""
    like = lambda run, y: 1 - F.levenshtein(run, y) / F.greatest(F.length(run), F.length(y), F.lit(1))
    best = lambda x, y: F.array_max(F.transform(word_runs(x), lambda run: like(run, y)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.greatest(best(a, b), best(b, a)), F.lit(0.0)))


def subsequence_same(a: Column | str, b: Column | str) -> Column:
    """Best similarity of a run of words above 0.85."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return best_subsequence(a, b) > 0.85


#: The sixteen colour names of HTML 4 (fixed values).
COLOR_NAMES = {
    "black": 0x000000, "silver": 0xC0C0C0, "gray": 0x808080, "white": 0xFFFFFF, "maroon": 0x800000, "red": 0xFF0000,
    "purple": 0x800080, "fuchsia": 0xFF00FF, "green": 0x008000, "lime": 0x00FF00, "olive": 0x808000, "yellow": 0xFFFF00,
    "navy": 0x000080, "blue": 0x0000FF, "teal": 0x008080, "aqua": 0x00FFFF,
}


def parse_color(text: Column) -> Column:
    """#rrggbb, #rgb (with or without #) or a name, as an integer; null for anything else."""
    t = F.lower(F.trim(text))
    digits = F.regexp_extract(t, "^#?([0-9a-f]{6})$", 1)
    short = F.regexp_extract(t, "^#?([0-9a-f]{3})$", 1)
    names = F.create_map(*[F.lit(x) for pair in COLOR_NAMES.items() for x in pair])
    doubled = F.regexp_replace(short, "(.)", "$1$1")
    return F.coalesce(
        F.try_element_at(names, t),
        F.when(digits != "", F.conv(digits, 16, 10).cast("int")),
        F.when(short != "", F.conv(doubled, 16, 10).cast("int")),
    )


def text_color(color: Column) -> Column:
    """White on dark colours, black on light ones, by the root mean square of the channels."""
    parts = [F.shiftright(color, s).bitwiseAND(255).cast("double") for s in (16, 8, 0)]
    return F.when(F.sqrt(sum(p * p for p in parts) / 3) < 140, F.lit(0xFFFFFF)).otherwise(F.lit(0))
