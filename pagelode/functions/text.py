"""Text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index term pattern, the characters Python's str.split() splits on,
# and the byte length of a body in a response.
TERM_PATTERN = "[a-z0-9]+"
NON_TERM_PATTERN = "[^a-z0-9]+"
WHITESPACE_PATTERN = r"[\p{IsWhite_Space}\x1c-\x1f]+"
BODY_BYTES = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    A plain Column used inside a lambda may be inlined by the optimizer and then
    runs once per array element; bound as a lambda variable it cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lower(text: Column) -> Column:
    # The JVM lowers U+0130 to "i" plus a combining dot, which would split the word.
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def normalize(text: Column) -> Column:
    """Lower case, with each run of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(_lower(text), NON_TERM_PATTERN, " "))


def tokens(text: Column) -> Column:
    """Index terms in text order, repeats kept; an empty array if there are none."""
    return F.regexp_extract_all(_lower(text), F.lit(TERM_PATTERN), F.lit(0))


def indexed_text(title: Column, body: Column) -> Column:
    """The one text field that is indexed and reranked."""
    return F.concat(_or_empty(title), F.lit(" "), _or_empty(body))


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased words split at Unicode whitespace, punctuation and accents kept."""
    return F.filter(F.split(F.lower(text), WHITESPACE_PATTERN), lambda word: word != "")


def truncate_utf8(text: Column, size: int = BODY_BYTES) -> Column:
    """The longest prefix of at most `size` bytes that ends at a character boundary."""
    raw = text.cast("binary")

    def cut(n: int) -> Column:
        return F.substring(raw, 1, n).cast("string")

    whole_characters = [F.try_validate_utf8(cut(max(size - back, 0))) for back in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(
        F.coalesce(*whole_characters, F.make_valid_utf8(cut(size)))
    )


def value_counts(
    words: Column,
    value: str = "term",
    count: str = "tf",
    more: dict[str, Callable[[Column], Column]] | None = None,
) -> Column:
    """Distinct words with their counts, as array<struct<value, count>> sorted by word, and `more`
    fields that follow from the count.

    Works inside the row (sort, then measure runs), so counting the terms of a
    document needs no shuffle and no hash table over (document, term) pairs.
    """

    def entry(word: Column, number: Column) -> Column:
        others = [made(number).alias(name) for name, made in (more or {}).items()]
        return F.struct(word.alias(value), number.alias(count), *others)

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda word, i: F.when((i == 0) | (word != F.get(ordered, i - 1)), i),
            ),
            lambda start: start.isNotNull(),
        )
        return let(
            starts,
            lambda first: F.transform(
                first,
                lambda start, i: entry(
                    F.get(ordered, start),
                    (F.coalesce(F.get(first, i + 1), F.size(ordered)) - start).cast("bigint"),
                ),
            ),
        )

    return let(F.sort_array(words), runs)


def vector_norm(counts: Column) -> Column:
    """Length of a count vector (array of structs with `count`); 1.0 if it is empty."""
    squares = F.aggregate(
        counts,
        F.lit(0.0),
        lambda total, entry: total + (entry["count"] * entry["count"]).cast("double"),
    )
    return F.when(F.size(counts) == 0, F.lit(1.0)).otherwise(F.sqrt(squares))


def bow_vector(text: Column) -> Column:
    """Unit-length bag of words, as array<struct<token, weight>> sorted by token."""
    return let(
        value_counts(whitespace_tokens(text), "token", "count"),
        lambda counts: let(
            vector_norm(counts),
            lambda norm: F.transform(
                counts,
                lambda entry: F.struct(
                    entry["token"].alias("token"),
                    (entry["count"].cast("double") / norm).alias("weight"),
                ),
            ),
        ),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two texts as bags of words; 0 without a common word."""
    return let(
        bow_vector(left),
        lambda a: let(
            F.map_from_entries(bow_vector(right)),
            lambda weights: F.aggregate(
                a,
                F.lit(0.0),
                lambda total, entry: total
                + entry["weight"]
                * F.coalesce(F.element_at(weights, entry["token"]), F.lit(0.0)),
            ),
        ),
    )


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
