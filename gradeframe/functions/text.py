"""Text and label expressions, all native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: White space of any script, and the separators 0x1C to 0x1F that count as such.
SPACE = r"[\s\x1C-\x1F]"
#: Words of ASCII letters and digits with one space between: most labels.
PLAIN = r"^[A-Za-z0-9]+( [A-Za-z0-9]+)*$"
ASCII = r"^[\x00-\x7F]*$"


#: Cherokee's small letters and the capitals that they fold to.
CHEROKEE = tuple("".join(map(chr, [*letters, *more])) for letters, more in ((range(0xAB70, 0xABC0), range(0x13F8, 0x13FE)), (range(0x13A0, 0x13F0), range(0x13F0, 0x13F6))))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, rf"^(?U){SPACE}+|(?U){SPACE}+$", "")


def casefold(c: Column) -> Column:
    """Full case folding: what has one capital form becomes the small form of that (ligatures and sharp s more letters).

    The dotless i stands aside, as its capital is that of the dotted one. Cherokee
    letters fold to capitals, and the final sigma to the other one.
    """
    capital = F.upper(F.translate(F.lower(c), "\u0131", "\ufdd0"))  # the translations keep the optimiser from merging the conversions
    folded = F.translate(F.lower(F.translate(capital, "\ufdd0", "\u0131")), "\u03c2" + CHEROKEE[0], "\u03c3" + CHEROKEE[1])
    return F.when(c.rlike(ASCII), F.lower(c)).otherwise(folded)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+", " "))


def normalize_text(c: Column) -> Column:
    """Labels compared by letters and digits: squeezed, folded, without other characters at the ends."""
    return F.when(c.rlike(PLAIN), F.lower(c)).otherwise(F.regexp_replace(casefold(squeeze(c)), EDGES, ""))


def text_correct(gold: Column, pred: Column) -> Column:
    return normalize_text(gold) == normalize_text(pred)


def answer_text(c: Column) -> Column:
    """Answers compared with their punctuation: squeezed and folded."""
    return casefold(squeeze(c))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


#: Letters whose places are bits of one number, so that two such numbers add up without overflow.
BITS = 62


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings.

    The rows of the usual table differ from cell to cell by 0 or 1: a row is kept as
    bits, BITS of a's letters to a number, and each letter of b makes the next row by an
    addition with carry. Where each letter of a stands is looked up in a map.
    """
    ours, zero = characters(a), F.lit(0).cast("long")
    words = F.sequence(F.lit(0), F.floor(F.greatest(F.size(ours) - 1, F.lit(0)) / BITS).cast("int"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def bits(holds: Callable[[Column], Column]) -> Column:
        """For each word the bits of the letters for which something holds."""
        letters = lambda w: F.slice(ours, w * BITS + 1, F.lit(BITS))
        return F.transform(words, lambda w: F.aggregate(F.transform(letters(w), lambda x, i: F.when(holds(x), bit(i)).otherwise(zero)), zero, lambda m, x: m.bitwiseOR(x)))

    places = F.map_from_entries(F.transform(F.array_distinct(ours), lambda ch: F.struct(ch, bits(lambda x: x == ch))))
    full = bits(lambda x: x.isNotNull())

    def next_row(row: Column, ch: Column) -> Column:
        here = F.try_element_at(places, ch)

        def word(state: Column, w: Column) -> Column:
            old = F.get(row, w)
            hit = old.bitwiseAND(F.get(here, w))
            total = old + hit + state["carry"]
            new = total.bitwiseOR(old - hit).bitwiseAND(F.get(full, w))
            return F.struct(F.array_append(state["done"], new).alias("done"), F.shiftright(total, BITS).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("done"), zero.alias("carry"))
        return F.when(here.isNull(), row).otherwise(F.aggregate(words, start, word)["done"])

    left = F.aggregate(characters(b), full, next_row)
    return F.size(ours) - F.aggregate(left, F.lit(0), lambda n, x: n + F.bit_count(x))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (lengths), 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(2.0 * common_subsequence(a, b), total))


def name_similarity(gold: Column, pred: Column) -> Column:
    """Indel ratio of normalised names; two blank names say nothing and score 0."""
    a, b = normalize_text(gold), normalize_text(pred)
    return F.when((a == "") & (b == ""), F.lit(0.0)).otherwise(indel_ratio(a, b))


def anls(prediction: Column, answers: Column, threshold: float = 0.5) -> Column:
    """Best 1 - edit distance / longer length over the answers; below the threshold 0."""
    p = answer_text(prediction)

    def similarity(answer: Column) -> Column:
        a = answer_text(answer)
        longest = F.greatest(F.length(a), F.length(p))
        return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.try_divide(F.levenshtein(a, p).cast("double"), longest))

    best = F.coalesce(F.array_max(F.transform(answers, similarity)), F.lit(0.0))
    return F.when(best < threshold, F.lit(0.0)).otherwise(best)


def exact_match(prediction: Column, answers: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(answers, answer_text), answer_text(prediction)), F.lit(False))


def html_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def failure_class(message: Column, kind: Column) -> Column:
    """'OOM' for messages of exhausted memory, else 'FAILED: kind'."""
    return F.when(F.lower(message).rlike("out of memory|outofmemory"), F.lit("OOM")).otherwise(F.concat(F.lit("FAILED: "), kind))


def error_text(kind: Column, message: Column, most: int = 200) -> Column:
    return F.concat(kind, F.lit(": "), F.substring(message, 1, most))


def locale_pick(json: Column, key: str, default: Column) -> Column:
    """The entry under `key` of a JSON object; a JSON that is no object is itself the value; else the default."""
    bare = strip(json)
    return F.coalesce(F.when(bare.startswith("{"), F.get_json_object(bare, f"$.{key}")).otherwise(json), default)
