"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers.

Everything here is Column expressions, joins and aggregates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions.text import let
from pagelode.llm.common import UPPER, stored

#: Words of code and addresses that texts need not have; each is some identifiers of the samples.
COMMON = (
    "http https www com org net html index example mail user name password passwd secret token key "
    "config default value data file path home page archive documents images static public private "
    "version release build source main test admin login session email localhost server client"
).split()
#: Characters of a token, in the order in which the models number them from 1.
ALPHABET = UPPER.lower() + UPPER + "0123456789+/_.=-"
TOKEN_CHAR = "[A-Za-z0-9+/_.=-]"
#: The patterns by kind, with the group that must be long enough and its length.
KINDS = {
    "assign": (
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What a cheaper pattern finds at all; texts without it skip the exact one.
HINTS = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
LEARNED = "markov"
#: Fewer characters than that are no secret; the README has what shorter ones cost.
TOKEN_LENGTH = 10
#: Code points of the alphabet lie in a range of so many, from this one.
FIRST, CODES = 43, 80
#: Characters that part a run into pieces.
MARKS = "/_.=-"
#: The share of held-out identifiers that may score the threshold, and the least threshold.
FALSE_SHARE, LEAST_THRESHOLD = 1e-4, 12
#: Scores above are counted together when the threshold is looked for.
MOST_SCORE = 200
#: What is left out of the identifiers: matches of the fixed patterns that are long enough.
FIXED_VALUES = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}"
    r"|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"
)
#: Words are joined with others of a part. There is a part for so many words, and a word is dealt
#: to a part more for each so many places of it.
PART_WORDS, PART_PLACES = 4096, 4096
#: Words of the same count, up to this one, are joined among themselves if a part has so many.
SAME_COUNT, SAME_WORDS = 16, 64
#: A sample stands for at most one in so many of all places, so that numbers and COMMON vary.
LEAST_SAMPLES = 20_000
#: Every fourth document of the samples is held out.
HOLDS = 4
#: Columns of the words that a word is joined with.
NEXT = ("next_1", "next_2", "next_3")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
BLOCK = 64


def running_sums(numbers: Column) -> Column:
    """Inclusive prefix sums of an array, by way of sums of blocks so that long arrays stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def places(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        )

    def sums(own: Column) -> Column:
        blocks = F.transform(
            places(F.ceil(F.size(own) / BLOCK).cast("int")),
            lambda b: total(F.slice(own, b * BLOCK + 1, F.lit(BLOCK))),
        )
        before = let(
            blocks, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b)))
        )
        return let(
            before,
            lambda t: F.transform(
                own,
                lambda _, i: F.get(t, F.floor(i / BLOCK).cast("int"))
                + total(F.slice(own, i - i % BLOCK + 1, i % BLOCK + 1)),
            ),
        )

    return let(numbers, sums)


def match_spans(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters or more.

    The pattern also splits the text; the lengths of the pieces and matches add up to starts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
    pieces = F.transform(F.split(text, pattern, -1), F.length)

    def spans(sizes: Column, gaps: Column, lengths: Column) -> Column:
        steps = F.transform(
            sizes, lambda _, i: F.get(gaps, i) + F.when(i > 0, F.get(sizes, i - 1)).otherwise(0)
        )
        return let(
            running_sums(steps),
            lambda starts: F.filter(
                F.transform(
                    sizes,
                    lambda size, i: F.struct(
                        F.get(starts, i).alias("start"),
                        F.lit(rank).alias("rank"),
                        (F.get(starts, i) + size).alias("end"),
                        F.when(F.get(lengths, i) >= least, F.lit(kind)).alias("kind"),
                    ),
                ),
                lambda span: span["kind"].isNotNull(),
            ),
        )

    return let(
        F.transform(found, F.length),
        lambda sizes: let(
            pieces,
            lambda gaps: let(F.transform(values, F.length), lambda n: spans(sizes, gaps, n)),
        ),
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind as listed; text must not be null."""
    none = F.array().cast(SPAN)
    parts = [
        F.when(text.rlike(HINTS[kind]), match_spans(text, *rule, kind, rank)).otherwise(none)
        for rank, (kind, rule) in enumerate(KINDS.items())
    ]
    return F.array_sort(F.concat(*parts))


@dataclass
class MarkovModel:
    """Log-likelihood ratios of character pairs, random strings over identifiers, row by row.

    Pairs with one of MARKS count 0, as both kinds of string are joined by them.
    """

    ratios: list[float]
    threshold: float = 12.0

    def table(self) -> Column:
        """The ratios by code point of both characters, from FIRST on."""
        width = len(ALPHABET)
        by_code = [0.0] * CODES**2
        for i, a in enumerate(ALPHABET):
            for j, b in enumerate(ALPHABET):
                by_code[(ord(a) - FIRST) * CODES + ord(b) - FIRST] = self.ratios[i * width + j]
        text = ",".join(f"{ratio:.5f}" if ratio else "0" for ratio in by_code)
        return F.split(F.lit(text), ",").cast("array<double>")

    def piece_score(self, piece: Column, table: Column, most: bool = False) -> Column:
        """The sum of the ratios of neighbouring characters; with `most` of the positive ones."""
        codes = F.transform(F.split(piece, ""), lambda c: F.ascii(c) - FIRST)

        def total(own: Column) -> Column:
            def add(done: Column, i: Column) -> Column:
                ratio = F.get(table, F.get(own, i - 1) * CODES + F.get(own, i))
                return done + (F.greatest(ratio, F.lit(0.0)) if most else ratio)

            return F.aggregate(F.sequence(F.lit(1), F.size(own) - 1), F.lit(0.0), add)

        return F.when(F.length(piece) < 2, F.lit(0.0)).otherwise(let(codes, total))

    def can_pass(self, token: Column, table: Column) -> Column:
        """Whether any stretch could reach the threshold: its positive ratios do, added up."""
        return self.piece_score(token, table, most=True) >= self.threshold

    def stretches(self, token: Column, table: Column) -> Column:
        """Arrays (start, end) of the stretches of a token that score the threshold or more.

        One rule for all tokens: MARKS part the token into pieces, and a stretch is some pieces
        in a row. The sum of piece scores runs on while it is positive and within the threshold
        of its maximum, and starts anew behind that. So words before a secret, or between two, do
        not hide it. The stretch up to the maximum counts if that reaches the threshold
        and the stretch has TOKEN_LENGTH characters.
        """
        none = F.array().cast("array<struct<start:int,end:int>>")
        state = {name: F.lit(0) for name in ("at", "start", "end")}
        state |= {"sum": F.lit(0.0), "best": F.lit(0.0), "found": none}

        def packed(values: dict[str, Column]) -> Column:
            return F.struct(*(value.alias(name) for name, value in values.items()))

        def flushed(s: Column) -> Column:
            passes = (s["best"] >= self.threshold) & (s["end"] - s["start"] >= TOKEN_LENGTH)
            own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
            return F.when(passes, F.concat(s["found"], F.array(own))).otherwise(s["found"])

        def step(s: Column, piece: Column) -> Column:
            stop, new = s["at"] + F.length(piece), s["sum"] <= 0
            before = F.when(new, 0.0).otherwise(s["best"])

            def grown(sum_: Column) -> Column:
                return packed({
                    "at": stop + 1,
                    "start": F.when(new, s["at"]).otherwise(s["start"]),
                    "end": F.when(sum_ > before, stop).when(new, s["at"]).otherwise(s["end"]),
                    "sum": sum_,
                    "best": F.greatest(before, sum_),
                    "found": s["found"],
                })

            def closed(g: Column) -> Column:
                over = (g["sum"] <= 0) | (g["sum"] <= g["best"] - self.threshold)
                done = {name: g[name] for name in state}
                done |= {"sum": F.lit(0.0), "best": F.lit(0.0), "found": flushed(g)}
                return F.when(over, packed(done)).otherwise(g)

            sum_ = F.when(new, 0.0).otherwise(s["sum"]) + self.piece_score(piece, table)
            return let(let(sum_, grown), closed)

        return F.aggregate(F.split(token, f"[{MARKS}]", -1), packed(state), step, flushed)

    def peak(self, token: Column, table: Column) -> Column:
        """The highest sum of piece scores of pieces in a row; 0 if none is positive."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(s: Column, piece: Column) -> Column:
            sum_ = F.greatest(s["sum"], F.lit(0.0)) + self.piece_score(piece, table)
            return let(
                sum_, lambda x: F.struct(x.alias("sum"), F.greatest(s["best"], x).alias("best"))
            )

        return F.aggregate(F.split(token, f"[{MARKS}]", -1), start, step, lambda s: s["best"])


def train(samples: DataFrame, false_share: float = FALSE_SHARE) -> MarkovModel:
    """Both models and their threshold from `samples (token, random, held)`.

    Pairs of characters are counted over the samples that are not held out, smoothed by one; a
    sample counts `n` times, if there is such a column. Nulls and characters outside the alphabet are skipped. The threshold is the least whole
    number, LEAST_THRESHOLD or more, that at most `false_share` of the held-out identifiers of
    TOKEN_LENGTH characters or more reach. Only ALPHABET ** 2 counts and MOST_SCORE more
    come to the driver. Without samples all ratios are 0.
    """
    width = len(ALPHABET)
    samples = samples.where("token is not null and random is not null")
    # Looking for a character outside takes ten times as long as seeing that all are inside.
    clean = F.when(F.col("token").rlike(rf"^{TOKEN_CHAR}*+\z"), F.col("token")).otherwise(
        F.regexp_replace("token", f"[^{TOKEN_CHAR[1:]}", "")
    )
    pairs = (
        samples.where("not coalesce(held, false)")
        .select("random", F.explode(F.array(clean)).alias("clean"), _places(samples).alias("n"))
        .where("length(clean) > 1")
        .select("random", "clean", "n", F.explode(F.expr("sequence(1, length(clean) - 1)")).alias("at"))
        .groupBy("random", F.substring("clean", F.col("at"), F.lit(2)).alias("pair"))
        .agg(F.sum("n"))
    )
    number = {c: i for i, c in enumerate(ALPHABET)}
    letters = [i for c, i in number.items() if c not in MARKS]
    counts = {kind: [[0.0] * width for _ in range(width)] for kind in (False, True)}
    for table in counts.values():
        for a in letters:
            for b in letters:
                table[a][b] = 1.0
    for random, (a, b), count in pairs.collect():
        if a not in MARKS and b not in MARKS:
            counts[random][number[a]][number[b]] += count
    ratios = [0.0] * width**2
    for a in letters:
        for b in letters:
            share = {kind: table[a][b] / sum(table[a]) for kind, table in counts.items()}
            ratios[a * width + b] = round(math.log(share[True] / share[False]), 5)
    model = MarkovModel(ratios)
    if any(ratios):
        model.threshold = _threshold(samples.where("held and not random"), model, false_share)
    return model


def _threshold(identifiers: DataFrame, model: MarkovModel, false_share: float) -> float:
    peak = let(model.table(), lambda table: model.peak(F.col("token"), table))
    score = F.least(F.lit(MOST_SCORE), F.floor(peak)).cast("int")
    long = identifiers.where(F.length("token") >= TOKEN_LENGTH)
    long = long.select(score.alias("score"), _places(long).alias("n"))
    counts = dict(long.groupBy("score").agg(F.sum("n")).collect())
    least, above = MOST_SCORE + 1, 0
    while least > LEAST_THRESHOLD:
        above += counts.get(least - 1, 0)
        if above > false_share * sum(counts.values()):
            break
        least -= 1
    return float(least)


def measured(samples: DataFrame, model: MarkovModel) -> DataFrame:
    """How many held-out samples there are, and how many have a learned span, by kind and length.

    Rows `(random, length, n, found)`, the length in steps of four characters. Found random
    strings over all of them are the recall, found ones that are random the precision.
    """
    held = samples.where("held and token is not null").where(F.length("token") >= TOKEN_LENGTH)
    has = F.size(learned_spans(F.col("token"), model)) > 0
    return held.groupBy("random", (F.floor(F.length("token") / 4) * 4).alias("length")).agg(
        F.sum(_places(held)).alias("n"), F.sum(F.when(has, _places(held)).otherwise(0)).alias("found")
    )


def labelled_samples(
    docs: DataFrame, text: Column, key: Column, words: int | None = None
) -> DataFrame:
    """Samples `(token, random, held, n)` from all documents; a sample stands for `n` equal places.

    All words of the whole texts count, in held-out documents and in others, and COMMON is
    added. Identifiers are made of each place of each word, in all of these forms: alone, numbered,
    in camel case and capitals, joined with others as in names, paths, hosts and dates, and numbers
    of one to sixteen digits. Places with the same words to be joined share their numbers, see
    `_joined_places`; so what is shuffled and scored grows with the words that there are. With
    `words`, only about so many places of a document count. Random strings are digests of the
    texts: base 64, hexadecimal of either case, capitals with digits, and letters with digits, each
    whole and from 10 characters. Values that the fixed patterns find are left out of the
    identifiers. Every HOLDS-th document is held out.
    """
    held = F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(HOLDS)) == 0
    chosen = docs.select(F.coalesce(text, F.lit("")).alias("text"), key.alias("key"))
    chosen = chosen.select("text", held.alias("held"))
    own = F.regexp_extract_all(
        F.regexp_replace("text", FIXED_VALUES, " "), F.lit("[A-Za-z]{2,}"), 0
    )
    if words is not None:
        own = let(own, lambda all_: F.filter(all_, lambda w, i: _drawn(w, i) * F.size(all_) < words))
    counted = chosen.select("held", F.explode(own).alias("word")).groupBy("held", "word").count()
    places = _joined_places(stored(counted, "words"))
    draw = F.pmod(F.xxhash64("word", "part", "at", "share", "held"), F.lit(1 << 30))
    places = stored(places.withColumn("draw", draw), "places")
    first, second, third, fourth = (F.lower(name) for name in ("word", *NEXT))
    common = F.array(*(F.lit(word) for word in COMMON))
    digits = F.lpad(F.pmod(F.xxhash64("draw", "at"), F.lit(10**16)).cast("string"), 16, "7")
    number = F.substring(digits, F.lit(1), F.lit(1) + (F.col("draw") % 16).cast("int"))
    day = [F.substring(digits, F.lit(at), F.lit(size)) for at, size in ((1, 4), (5, 2), (7, 2))]
    forms = [
        F.col("word"),
        F.concat_ws("_", first, second, third),
        F.concat_ws("-", first, second, third, fourth),
        F.concat(first, F.col("draw") % 100, F.lit("."), second, F.lit(".example")),
        F.concat(F.lit("//"), F.concat_ws("/", first, second, *day, third), F.lit(".html")),
        F.concat(first, F.initcap(second), F.initcap(third)),
        F.concat(F.upper(first), F.lit("_"), F.upper(second)),
        F.concat(first, F.lit("="), number),
        number,
        F.concat_ws("-", *day),
    ]
    usual = F.get(common, (F.col("draw") % len(COMMON)).cast("int"))
    forms += [usual, F.concat_ws("/", usual, first), F.concat_ws("_", second, F.upper(usual))]
    numbers = F.array(*(F.lit(i) for i in range(len(forms))))
    token = F.coalesce(*(F.when(F.col("form") == i, form) for i, form in enumerate(forms)))
    # A token comes from a generator, so that filters on it don't make it again.
    plain = places.select("*", F.explode(numbers).alias("form")).select(
        F.explode(F.array(token)).alias("token"), F.lit(False).alias("random"), "held", "n"
    )
    whole = chosen.where(F.col("text").rlike("[A-Za-z]{2}")).select(
        F.sha2("text", 256).alias("whole"), "held"
    )
    digest = [F.sha2(F.concat(F.lit(f"{i}:"), F.col("whole")), 256) for i in range(6)]
    coded = [F.base64(F.unhex(digest[i])) for i in range(4)]
    strings = [
        F.rtrim(coded[0], F.lit("=")),
        coded[1],
        F.translate(coded[2], "+/=", ""),
        F.upper(F.translate(coded[3], "+/=", "")),
        digest[4],
        F.upper(digest[5]),
    ]
    least = F.lit(TOKEN_LENGTH)
    shorter = [F.substring(s, F.lit(1), least + F.crc32(s) % 24) for s in strings]
    random = whole.select(
        F.explode(F.array(*strings, *shorter)).alias("token"),
        F.lit(True).alias("random"),
        "held",
        F.lit(1).cast("long").alias("n"),
    )
    return plain.unionByName(random)


def _joined_places(counted: DataFrame) -> DataFrame:
    """Every place of the words counted in `(held, word, count)`, with those of three more places.

    Rows `(held, part, at, share, word, *NEXT, n)` stand for `n` places with the same four words. The places
    of a part lie on circles by a hash of their word, and are joined with those a quarter of the
    circle further, two quarters and three. So each place is once the first, the second, the third
    and the fourth, and the `n` of a word add up to its count. Frequent words meet many others; rare
    ones of the same count have a circle if they are many, where the places of a word meet those of
    one other, so rows are few more than words and four times as many at most.
    """
    words, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    parts, most = F.lit(words // PART_WORDS + 1), total // LEAST_SAMPLES + 1
    counted = counted.withColumnRenamed("count", "n")
    dealt = _shared_out(counted, F.least(parts, F.ceil(F.col("n") / PART_PLACES)))
    part = F.pmod(F.xxhash64("word") % parts + F.col("share"), parts)
    dealt = dealt.select("held", "word", part.alias("part"), "n").repartition("held", "part")
    alike = F.count(F.lit(1)).over(Window.partitionBy("held", "part", "n"))
    own = (F.col("n") <= SAME_COUNT) & (alike >= SAME_WORDS)
    dealt = dealt.withColumn("circle", F.when(own, F.col("n")).otherwise(0))
    circle = Window.partitionBy("held", "part", "circle")
    so_far = circle.orderBy(F.xxhash64("word"), "word").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select(
        "*",
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("start"),
        F.sum("n").over(circle).alias("total"),
        F.greatest("circle", F.lit(1)).alias("unit"),
    )
    quarter = F.expr("unit * greatest(total div (4 * unit), 1)")
    names = ("word", *NEXT)
    begins = []
    for i in range(len(names)):
        begin = F.pmod(F.col("start") - i * quarter, F.col("total"))
        begins.append(F.struct(F.lit(i).alias("role"), begin.alias("at")))
        over = begin + F.col("n") > F.col("total")  # it goes on at the begin of the circle
        none = F.lit(None).cast("bigint")
        begins.append(F.struct(F.lit(i).alias("role"), F.when(over, F.lit(0)).otherwise(none).alias("at")))
    begun = dealt.select("held", "part", "circle", "total", "word", F.inline(F.array(*begins)))
    begun = begun.where("at is not null").groupBy("held", "part", "circle", "at").agg(
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("role") == i, F.col("word"))).alias(name) for i, name in enumerate(names)),
    )
    along = circle.orderBy("at")
    until = F.coalesce(F.lead("at").over(along), F.col("total"))
    here = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = begun.select(
        "held",
        "part",
        "at",
        *(F.last(name, ignorenulls=True).over(here).alias(name) for name in names),
        (until - F.col("at")).alias("n"),
    )
    return _shared_out(places, F.ceil(F.col("n") / most))


def _shared_out(rows: DataFrame, shares: Column) -> DataFrame:
    """Each row as so many, numbered by a `share` from 0, which share its `n` out."""
    rows = rows.withColumn("shares", shares)
    rows = rows.select("*", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    own = F.expr("n * (share + 1) div shares - n * share div shares")
    return rows.withColumn("n", own).drop("shares")


def _drawn(word: Column, place: Column) -> Column:
    """A number in 0 to 1 by a hash of a word and its place."""
    return F.pmod(F.xxhash64(word, place), F.lit(1 << 30)) / (1 << 30)


def _places(samples: DataFrame) -> Column:
    """How many places a sample stands for: its column `n`, or one."""
    return F.col("n") if "n" in samples.columns else F.lit(1).cast("long")


def learned_spans(text: Column, model: MarkovModel) -> Column:
    """Spans of the runs of token characters, or stretches of them, that the random model
    explains better, by the model's threshold. Runs that no stretch can pass in are skipped
    by a plain sum, before anything is located."""
    token = f"(?<!{TOKEN_CHAR}){TOKEN_CHAR}{{{TOKEN_LENGTH},}}+"
    rank = len(KINDS)
    none = F.array().cast(SPAN)

    def located(run: Column, table: Column) -> Column:
        own = F.substring(text, run["start"] + 1, run["end"] - run["start"])
        spans = F.transform(
            model.stretches(own, table),
            lambda s: F.struct(
                (run["start"] + s["start"]).alias("start"),
                F.lit(rank).alias("rank"),
                (run["start"] + s["end"]).alias("end"),
                F.lit(LEARNED).alias("kind"),
            ),
        )
        return F.when(model.can_pass(own, table), spans).otherwise(none)

    def found(table: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(token), 0)
        hot = F.exists(runs, lambda run: model.can_pass(run, table))
        spans = match_spans(text, token, 0, 0, LEARNED, rank)
        located_ = F.flatten(F.transform(spans, lambda run: located(run, table)))
        return F.when(hot, located_).otherwise(none)

    return let(model.table(), found)


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that all positions stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        at = F.greatest(done["at"], s["end"])
        parts = F.array(
            F.substring(text, done["at"] + 1, F.greatest(F.lit(0), s["start"] - done["at"])),
            F.repeat(F.lit(" "), at - F.greatest(done["at"], s["start"])),
        )
        return F.struct(at.alias("at"), F.concat(done["parts"], parts).alias("parts"))

    cut = F.aggregate(
        spans,
        start,
        step,
        lambda done: F.concat(
            F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def secret_spans(text: Column, model: MarkovModel) -> Column:
    """All spans of a text by start, then kind: those of the patterns, and those of the model
    in what the patterns leave over. A null text has none; positions count code points."""
    own = F.coalesce(text, F.lit(""))

    def joined(base: Column) -> Column:
        more = let(blanked(own, base), lambda rest: learned_spans(rest, model))
        return F.array_sort(F.concat(base, more))

    return let(base_spans(own), joined)


def with_secrets(docs: DataFrame, text: Column, model: MarkovModel, name: str = "secrets") -> DataFrame:
    """`docs` with an array column of spans `(start, rank, end, kind)`.

    Each row is scanned by itself: nothing is shuffled, repeated rows get equal spans, empty
    and null texts none, and an empty table stays empty. A column called as `name` is replaced.
    """
    return docs.withColumn(name, secret_spans(text, model))


def written(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != LEARNED)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(
        spans,
        start,
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= done["at"],
                F.concat(
                    done["parts"],
                    F.array(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mark)),
                ),
            )
            .otherwise(done["parts"])
            .alias("parts"),
        ),
        lambda done: F.concat(
            F.array_join(done["parts"], ""),
            F.substring(text, done["at"] + 1, F.length(text)),
        ),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)
