"""Similarity self-join of names, without comparing all pairs.

Two names at ratio ``2M/(la+lb) >= c`` share ``M`` characters in order, so both turn
into the same text by leaving out ``la-M`` and ``lb-M`` characters. Where that is at
most two characters, all such shortened texts are listed and names meet on equal
ones: linear in the number of names, however alike they are.

Where it is more, padded q-grams are used. A removed character destroys at most
``q`` of the padded q-grams of the first name and an added one at most ``q-1``,
hence the pair shares all but ``q(la-M) + (q-1)(lb-M)`` of them. By the prefix-filter
argument (Chaudhuri et al. 2006, Bayardo et al. 2007) it is then enough to index,
per name, that many plus one of its q-grams *in any global order*, and we order by
rarity: the grams that a third of all names contain come last and are hardly ever
indexed. Both filters are lossless; nothing is capped.

The search for the closest few goes down in steps of the ratio: a name that has its
few at 0.97 cannot get others at 0.85, so it is not looked up again. Crowded
neighbourhoods are served by the strict steps, where names meet on shortened texts.
A gram that stays popular is salted by its measured frequency.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwise.functions.similarity import nearest_of, pair_ratio
from wardwise.sources.tables import settle, spread

PAD_LEFT, PAD_RIGHT = "\u0002", "\u0003"
SALT_ROWS = 4096
LEFT_OUT = 2  # characters, at most, for names that meet on shortened texts
FIRST_STEP, STEP = 0.97, 0.06
EPS = 1e-9


def _matched(la: Column, lb: Column, cutoff: float) -> Column:
    """Fewest matched characters that still reach the cutoff."""
    return F.ceil((la + lb) * (cutoff / 2.0) - EPS)


def _prefix(la: Column, lb: Column, cutoff: float, q: int) -> Column:
    """Grams of a name of length ``la`` to index against length ``lb``."""
    m = _matched(la, lb, cutoff)
    return ((la - m) * q + (lb - m) * (q - 1) + 1).cast("int")


def name_tokens(names: DataFrame, q: int) -> DataFrame:
    """``(name, len, token)``: padded q-grams, numbered when they repeat."""
    padded = F.concat(F.lit(PAD_LEFT * (q - 1)), F.col("name"), F.lit(PAD_RIGHT * (q - 1)))
    grams = F.transform(
        F.sequence(F.lit(1), F.col("len") + (q - 1)),
        lambda i: F.substring(F.col("_p"), i, F.lit(q)),
    )
    numbered = F.transform(
        F.col("_g"),
        lambda g, i: F.concat(
            g, F.size(F.filter(F.slice(F.col("_g"), F.lit(1), i), lambda x: x == g)).cast("string")
        ),
    )
    return (
        names.select("name", F.length("name").alias("len"))
        .where(F.col("len") > 0)
        .withColumn("_p", padded)
        .withColumn("_g", grams)
        .select("name", "len", F.explode(numbered).alias("token"))
    )


def token_frequency(tokens: DataFrame) -> DataFrame:
    """``(token, df)``, settled: a popular gram can then be split."""
    return settle(tokens.groupBy("token").agg(F.count("*").alias("df")))


def ranked_tokens(names: DataFrame, q: int = 3, frequency: DataFrame | None = None) -> DataFrame:
    """``(name, len, tokens)`` with the q-grams of each name, rarest first (in ``names``, or as given)."""
    tokens = name_tokens(names, q)
    return (
        tokens.join(token_frequency(tokens) if frequency is None else frequency, "token")
        .groupBy("name", "len")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    )


def prefix_index(ranked: DataFrame, cutoff: float, q: int) -> DataFrame:
    """``(name, len, prefix, rank, token, salts)``: what to look names up by.

    The widest prefix over all admissible partner lengths is linear in the
    partner length, so it is reached at the shortest or at the longest partner.
    """
    shortest = q * (2.0 - 2.0 * cutoff) / (2.0 - cutoff)
    slack = max(shortest, (q - 1) * (2.0 / cutoff - 2.0))
    longest = (F.floor(F.col("len") * slack + EPS) + 1).cast("int")
    prefix = F.slice("tokens", F.lit(1), F.least(F.size("tokens"), longest))
    return (
        ranked.withColumn("_t", prefix)
        .select("name", "len", F.col("_t.token").alias("prefix"), F.posexplode("_t").alias("_at", "_e"))
        .select(
            "name",
            "len",
            "prefix",
            (F.col("_at") + 1).alias("rank"),
            F.col("_e.token").alias("token"),
            F.ceil(F.col("_e.df") / SALT_ROWS).cast("int").alias("salts"),
        )
    )


def _left_out(cutoff: float) -> Column:
    """Characters a name may leave out, against its shortest admissible partner."""
    return F.col("len") - F.ceil(F.col("len") * (cutoff / (2.0 - cutoff)) - EPS)


def _numbers_left_out(lengths: Sequence[int], cutoffs: Sequence[float]) -> dict[int, set[int]]:
    """By how many characters names of one of these lengths leave out to meet names of the others."""
    out: dict[int, set[int]] = {}
    for c in cutoffs:
        met = [n for n in lengths if 0 < n <= longest_shortened(c)]
        for la in met:
            for lb in met:
                m = math.ceil((la + lb) * (c / 2.0) - EPS)
                if m <= min(la, lb):
                    out.setdefault(la - m, set()).add(la)
    return out


def shortened(names: DataFrame, *cutoffs: float, lengths: Sequence[int] | None = None) -> DataFrame:
    """``(name, len, text)``: names without up to ``LEFT_OUT`` characters, as far as any of the cutoffs
    at which names of their length meet on shortened texts allows.

    With ``lengths``, all that names have, only those texts at which two of them can meet.
    """
    one = F.transform(
        F.sequence(F.lit(1), F.col("len")),
        lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, F.col("len"))),
    )
    two = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("len") - 1),
        lambda i: F.transform(
            F.sequence(i + 1, F.col("len")),
            lambda j: F.concat(
                F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, j - i - 1),
                F.substring(F.col("name"), j + 1, F.col("len")),
            ),
        ),
    ))
    most = F.greatest(F.lit(-1), *[F.when(F.col("len") <= longest_shortened(c), _left_out(c)).otherwise(-1) for c in cutoffs])
    none = F.array().cast("array<string>")
    asked = [most >= left_out for left_out in (0, 1, 2)]
    if lengths is not None:
        of = _numbers_left_out(lengths, cutoffs)
        asked = [a & F.col("len").isin(sorted(of.get(left_out, ()))) for left_out, a in enumerate(asked)]
    texts = F.concat(
        F.when(asked[0], F.array("name")).otherwise(none), F.when(asked[1], one).otherwise(none),
        F.when(asked[2] & (F.col("len") >= 2), two).otherwise(none),
    )
    return names.select("name", "len", F.explode(F.array_distinct(texts)).alias("text"))


def longest_shortened(cutoff: float) -> int:
    """Names up to this length leave out ``LEFT_OUT`` characters at most."""
    length = 1
    while length - math.ceil(length * cutoff / (2.0 - cutoff) - EPS) <= LEFT_OUT:
        length += 1
        if length > 1000:  # cutoffs next to one
            break
    return length - 1


def shortened_pairs(wanted: DataFrame, texts: DataFrame, cutoff: float) -> DataFrame:
    """Directed pairs that share as many characters in order as the cutoff asks for, once for every text they share.

    ``texts`` are the shortened texts of all names, of which those the cutoff allows count.
    """
    allowed = texts.where(
        (F.col("len") <= longest_shortened(cutoff)) & (F.col("len") - F.length("text") <= _left_out(cutoff))
    )
    left = allowed.join(wanted.select("name"), "name", "left_semi").select(
        F.col("name").alias("a"), F.col("len").alias("la"), "text"
    )
    right = allowed.select(F.col("name").alias("b"), F.col("len").alias("lb"), F.col("text").alias("text_b"))
    meet = (
        (F.col("text") == F.col("text_b")) & (F.col("a") != F.col("b"))
        & (F.length("text") == _matched(F.col("la"), F.col("lb"), cutoff))
    )
    return spread(left, "text").join(right, meet).select(
        F.col("a").alias("name"), F.col("b").alias("candidate")
    )


def candidate_pairs(wanted: DataFrame, ranked: DataFrame, cutoff: float, q: int = 3) -> DataFrame:
    """Directed pairs ``(name, candidate)`` that may reach the cutoff; each once.

    A pair is kept only at the first gram that both prefixes share, so no
    shuffle is spent on removing duplicates.
    """
    left = prefix_index(wanted, cutoff, q).select(
        F.col("name").alias("a"), F.col("len").alias("la"), F.col("prefix").alias("pa"),
        F.col("rank").alias("ra"), "token",
        F.pmod(F.xxhash64("name"), F.col("salts")).cast("int").alias("salt"),
    )
    right = prefix_index(ranked, cutoff, q).select(
        F.col("name").alias("b"), F.col("len").alias("lb"), F.col("prefix").alias("pb"),
        F.col("rank").alias("rb"), F.col("token").alias("token_b"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_b"),
    )
    la, lb = F.col("la"), F.col("lb")
    first_shared = F.element_at(
        F.array_intersect(
            F.slice("pa", F.lit(1), _prefix(la, lb, cutoff, q)),
            F.slice("pb", F.lit(1), _prefix(lb, la, cutoff, q)),
        ),
        1,
    )
    meet = (
        (F.col("token") == F.col("token_b"))
        & (F.col("salt") == F.col("salt_b"))
        & (F.col("a") != F.col("b"))
        & (F.least(la, lb) >= _matched(la, lb, cutoff))
        & (F.col("ra") <= _prefix(la, lb, cutoff, q))
        & (F.col("rb") <= _prefix(lb, la, cutoff, q))
        & (first_shared == F.col("token"))
    )
    return spread(left, "token", "salt").join(right, meet).select(
        F.col("a").alias("name"), F.col("b").alias("candidate")
    )


def similar_pairs(
    wanted: DataFrame, ranked: DataFrame, cutoff: float, q: int = 3, texts: DataFrame | None = None
) -> DataFrame:
    """``(name, candidate, ratio)`` at the cutoff or better, for the wanted names.

    Both sides come from ``ranked_tokens``; ``texts`` are the ranked names' shortened
    texts, if they are listed already. The ratio depends on the order of its
    arguments: the candidate comes first.
    """
    texts = shortened(ranked, cutoff) if texts is None else texts
    short = F.col("len") <= longest_shortened(cutoff)
    pairs = shortened_pairs(wanted.where(short), texts, cutoff).distinct().unionAll(_long_pairs(wanted, ranked, cutoff, q))
    return _rated(pairs, cutoff)


def _long_pairs(wanted: DataFrame, ranked: DataFrame, cutoff: float, q: int) -> DataFrame:
    """Pairs with a name too long for shortened texts; each once."""
    short = F.col("len") <= longest_shortened(cutoff)
    return candidate_pairs(wanted.where(~short), ranked, cutoff, q).unionAll(
        candidate_pairs(wanted.where(short), ranked.where(~short), cutoff, q)
    )


def _nearest(pairs: DataFrame, cutoff: float, n: int) -> DataFrame:
    """``(name, candidate, ratio, rank)``: the ``n`` best of each name, rating no pair that cannot be one of them.

    Two names can match the shorter's characters, and not all of them if equally long.
    """
    la, lb = F.length("name"), F.length("candidate")
    bound = 2.0 * F.when(la == lb, la - 1).otherwise(F.least(la, lb)) / (la + lb)
    ordered = spread(pairs.withColumn("bound", bound), "name").sortWithinPartitions("name", F.desc("bound"), F.desc("candidate"))
    return ordered.mapInArrow(nearest_of(cutoff, n), "name string, candidate string, ratio double, rank int")


def _best(pairs: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(
        Window.partitionBy("name").orderBy(F.desc("ratio"), F.desc("candidate"))
    )
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def closest_matches(names: DataFrame, n: int = 5, cutoff: float = 0.85) -> DataFrame:
    """The ``n`` closest names of every name; a name counts as its own first match.

    ``(name, candidate, ratio, rank)`` for distinct ``names(name)``. Equal ratios
    rank the larger text first. The name itself is not returned.
    """
    others = n - 1
    steps = [round(FIRST_STEP - i * STEP, 9) for i in range(int((FIRST_STEP - cutoff) / STEP + 1)) if FIRST_STEP - i * STEP > cutoff + EPS]
    steps.append(cutoff)
    plain = settle(names.select("name", F.length("name").alias("len")).where(F.col("len") > 0).distinct())
    all_ = plain.agg(F.count("*").alias("n"), F.max("len").alias("longest")).first()
    short = max(map(longest_shortened, steps))
    lengths = [r.len for r in plain.where(F.col("len") <= short).select("len").distinct().collect()]  # of at most about 1000
    texts = settle(shortened(plain, *steps, lengths=lengths))
    wanted, left, found, ranked = plain, all_.n, [], None
    for step in steps:
        limit = longest_shortened(step)
        pairs = shortened_pairs(wanted.where(F.col("len") <= limit), texts, step)
        if (all_.longest or 0) > limit:  # only then are grams needed
            ranked = settle(ranked_tokens(plain.select("name"), 3)) if ranked is None else ranked
            pairs = pairs.unionAll(_long_pairs(ranked.join(wanted.select("name"), "name", "left_semi"), ranked, step, 3))
        best = _nearest(pairs, step, others)
        if step == cutoff:
            found.append(best)
            break
        best = settle(best)
        served = settle(best.where(F.col("rank") == others).select("name"))
        found.append(best.join(served, "name", "left_semi"))
        done = served.count()
        if done == left:
            break
        if done:
            wanted, left = settle(wanted.join(served, "name", "left_anti")), left - done
    return reduce(DataFrame.unionByName, found)


# --- approximate -----------------------------------------------------------------


def min_hashes(names: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(name, bands)``: per band one hash of ``rows`` minima over the name's padded bigrams."""
    grams = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_p") - 1), lambda i: F.substring(F.col("_p"), i, F.lit(2))
    ))

    def minimum(seed: Column) -> Column:  # order of the grams under the seed; equal minima are equal grams but for collisions
        return F.array_min(F.transform("_g", lambda g: F.xxhash64(g, seed)))

    band = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(b, *[minimum(b * rows + r) for r in range(rows)]),
    )
    padded = F.concat(F.lit(PAD_LEFT), F.col("name"), F.lit(PAD_RIGHT))
    return (
        names.select("name").where(F.length("name") > 0)
        .withColumn("_p", padded).withColumn("_g", grams).select("name", band.alias("bands"))
    )


def banded_pairs(hashed: DataFrame) -> DataFrame:
    """Directed pairs of names that agree in a band; each once, at the first such band.

    A band value that many names have is salted by its measured frequency.
    """
    listed = hashed.select("name", "bands", F.posexplode("bands").alias("band", "value"))
    frequency = listed.groupBy("band", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    listed = listed.join(frequency, ["band", "value"]).withColumn("salts", F.ceil(F.col("_n") / SALT_ROWS).cast("int"))
    left = listed.select(
        F.col("name").alias("a"), F.col("bands").alias("ba"), "band", "value",
        F.pmod(F.xxhash64("name"), F.col("salts")).cast("int").alias("salt"),
    )
    right = listed.select(
        F.col("name").alias("b"), F.col("bands").alias("bb"), "band", "value",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    first = F.array_position(F.zip_with("ba", "bb", lambda x, y: x == y), True) - 1
    return (
        spread(left, "band", "value", "salt").join(right, ["band", "value", "salt"])
        .where((F.col("a") != F.col("b")) & (first == F.col("band")))
        .select(F.col("a").alias("name"), F.col("b").alias("candidate"))
    )


def roughly_closest(
    names: DataFrame, n: int = 5, cutoff: float = 0.85, bands: int = 24, rows: int = 2
) -> DataFrame:
    """``closest_matches`` for names that agree in a MinHash band; the ratios themselves are exact.

    A pair whose padded bigrams have Jaccard similarity ``j`` is looked at with
    probability ``1 - (1 - j ** rows) ** bands``: by default 0.999 at 0.5, 0.985 at
    0.4. One edit in ten characters leaves 0.6 and more, three in twenty about 0.55.
    No steps, no q-gram frequencies: one pass over the names and one join, quick where
    few names are alike. Names that are nearly all alike, such as numbered ones, share
    bands by thousands and all their pairs are rated: there the exact search, which
    meets on shortened texts and stops early, is the quicker one.
    """
    hashed = settle(min_hashes(names.distinct(), bands, rows))
    return _best(_rated(banded_pairs(hashed), cutoff), n - 1)


# --- names against a vocabulary ------------------------------------------------


def counted_pairs(wanted: DataFrame, words: DataFrame, cutoff: float) -> DataFrame:
    """Pairs ``(name, candidate)`` that share enough characters, in any order, for the cutoff; each once.

    Both sides are ranked by single characters, numbered when they repeat, under one
    order. Texts that share ``m`` characters share one of each side's rarest
    ``length - m + 1``, at which they meet (popular ones salted), and are then counted.
    """
    m = _matched(F.col("la"), F.col("lb"), cutoff)
    left = prefix_index(wanted, cutoff, 1).join(wanted.select("name", F.col("tokens.token").alias("ta")), "name").select(
        F.col("name").alias("a"), F.col("len").alias("la"), F.col("rank").alias("ra"), "ta", "token",
        F.pmod(F.xxhash64("name"), F.col("salts")).cast("int").alias("salt"),
    )
    right = prefix_index(words, cutoff, 1).join(words.select("name", F.col("tokens.token").alias("tb")), "name").select(
        F.col("name").alias("b"), F.col("len").alias("lb"), F.col("rank").alias("rb"), "tb", F.col("token").alias("token_b"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_b"),
    )
    shared = F.array_intersect("ta", "tb")  # in the order of both, so its first is where they meet first
    meet = (
        (F.col("token") == F.col("token_b")) & (F.col("salt") == F.col("salt_b"))
        & (F.least("la", "lb") >= m) & (F.col("ra") <= F.col("la") - m + 1) & (F.col("rb") <= F.col("lb") - m + 1)
        & (F.element_at(shared, 1) == F.col("token")) & (F.size(shared) >= m)
    )
    return spread(left, "token", "salt").join(right, meet).select(F.col("a").alias("name"), F.col("b").alias("candidate"))


def closest_in(names: DataFrame, words: DataFrame, cutoff: float, steps: Sequence[float] = (0.85, 0.6)) -> DataFrame:
    """``(name, candidate, ratio)``: the closest word of a vocabulary, for names that have one at the cutoff.

    Both are distinct ``(name)``, neither need be small. A name with a word at a
    strict step has its closest among those, so only the others go on to the next,
    where more words share enough characters. Of equal ratios the larger text counts.
    """
    frequency = token_frequency(name_tokens(names, 1).unionAll(name_tokens(words, 1)))
    wanted, ranked = settle(ranked_tokens(names, 1, frequency)), settle(ranked_tokens(words, 1, frequency))
    found = []
    for step in [s for s in steps if s > cutoff + EPS]:
        best = settle(_best(_rated(counted_pairs(wanted, ranked, step), step), 1))
        found.append(best)
        wanted = settle(wanted.join(best, "name", "left_anti"))
        if wanted.isEmpty():
            break
    else:
        found.append(_best(_rated(counted_pairs(wanted, ranked, cutoff), cutoff), 1))
    return reduce(DataFrame.unionByName, found).drop("rank")


def _rated(pairs: DataFrame, cutoff: float) -> DataFrame:
    ratio = pair_ratio(cutoff)
    return spread(pairs, "name").withColumn("ratio", ratio("candidate", "name")).where(F.col("ratio") >= cutoff)
