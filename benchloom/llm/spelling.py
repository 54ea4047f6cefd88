"""Spelling variants: words one edit apart, found by pivotal bigrams.

The bigrams of all words are ordered by how rare they are.  A word's prefix are its three rarest
bigrams (with all places of the third); its pivots are two bigrams of the prefix that share no
letter, chosen by dynamic programming for the least total frequency.

One edit cannot touch both pivots of a word.  So of two words one edit apart, the one whose
prefix ends earlier in the order has a pivot that the other holds too, and holds in its prefix.
The edit is before or after that pivot, which limits its position: counted from the end or from
the start it is the same, and all letters on that side of it are equal.  Pivots are therefore
joined with prefixes on the text from the pivot to that end, and on the lengths an edit can give.
Candidates are verified by their edit distance inside the join, so only near pairs leave it.

The order uses counts of :data:`GRAM_BUCKETS` hash buckets of bigrams, which is what tasks are
sent; any order serves, as long as all words use the same.

Defined results: words that are null or shorter than four code points take no part (two bigrams
without a common letter need four); rows that repeat a word are added up; an empty table gives
an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread, store

GRAM_BUCKETS = 1 << 16
PREFIX = 3          # bigrams that one edit can touch, and one more
PIVOTS = 2          # one more than there are edits


def bucket(gram: str) -> int:
    return binascii.crc32(gram.encode()) % GRAM_BUCKETS


def pivots(places: list[int], cost: list[int]) -> list[int]:
    """Of ``places`` (rising), the :data:`PIVOTS` without a common letter that cost least.

    ``best[k]`` holds the cheapest choice of k places among those passed that are at least a
    bigram's length behind the current one; ties keep the earlier places.
    """
    ready: list[tuple] = []       # (place, choices by count after this place)
    for place, price in zip(places, cost):
        behind = next((c for p, c in reversed(ready) if p <= place - 2), {0: (0, ())})
        before = ready[-1][1] if ready else {0: (0, ())}
        now = dict(before)
        for k, (total, chosen) in behind.items():
            if k < PIVOTS:
                tried = (total + price, (*chosen, place))
                if k + 1 not in now or tried[0] < now[k + 1][0]:
                    now[k + 1] = tried
        ready.append((place, now))
    return list(ready[-1][1][PIVOTS][1])


def _marked(counts: dict[int, int]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prefixes, chosen, masks = [], [], []
            for word in part.column("word").to_pylist():
                grams = [word[i:i + 2] for i in range(len(word) - 1)]
                order = [(counts[bucket(g)], g) for g in grams]
                last = sorted(order)[PREFIX - 1]
                places = [i for i, o in enumerate(order) if o <= last]
                prefixes.append(places)
                chosen.append(pivots(places, [order[i][0] for i in places]))
                mask = 0
                for letter in word:
                    mask |= 1 << ord(letter) % 63
                masks.append(mask)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(prefixes, pa.list_(pa.int32())),
                 pa.array(chosen, pa.list_(pa.int32())), pa.array(masks, pa.int64())],
                ["word", "n", "prefix", "pivots", "mask"])

    return run


def mark_words(words: DataFrame) -> DataFrame:
    """``word, n`` with the places of ``prefix`` and ``pivots`` and a ``mask`` of its letters."""
    gram = F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2))))
    place = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(GRAM_BUCKETS))
    counted = (words.select(gram.alias("gram")).groupBy(place.cast("int").alias("bucket"))
               .agg(F.count("*").alias("n")))
    counts = {r.bucket: r.n for r in counted.collect()}  # GRAM_BUCKETS rows at most
    return words.mapInArrow(
        _marked(counts),
        "word string, n bigint, prefix array<int>, pivots array<int>, mask bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, once each: ``a, n_a, b, n_b`` with a < b."""
    marked = store(mark_words(words), "marked-words")

    def keyed(places: str, lengths) -> DataFrame:
        at = marked.select("word", "n", "mask", F.explode(places).alias("place"))
        sides = F.array(
            F.struct(F.lit(0).alias("side"), F.expr("substr(word, 1, place + 2)").alias("part")),
            F.struct(F.lit(1).alias("side"), F.expr("substr(word, place + 1)").alias("part")))
        at = at.select("word", "n", "mask", F.inline(sides))
        at = at.withColumn("length", F.explode(lengths(F.length("word"))))
        return at.select(F.xxhash64("side", "part", "length").alias("key"), "word", "n", "mask")

    left = keyed("pivots", lambda n: F.array(n - 1, n, n + 1)).alias("l")
    right = keyed("prefix", lambda n: F.array(n)).alias("r")
    near = ((F.col("l.key") == F.col("r.key")) & (F.col("l.word") != F.col("r.word"))
            & (F.bit_count(F.col("l.mask").bitwiseXOR(F.col("r.mask"))) <= 2)
            & (F.levenshtein("l.word", "r.word", 1) == 1))
    first = F.col("l.word") < F.col("r.word")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    pairs = left.hint("merge").join(right, near).select(
        pick("l.word", "r.word").alias("a"), pick("l.n", "r.n").alias("n_a"),
        pick("r.word", "l.word").alias("b"), pick("r.n", "l.n").alias("n_b"))
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form, by doubling the steps taken.

    A form is more frequent than its word by a factor, so chains are short and end.
    """
    links = store(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        far = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = links.join(far, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = store(jumped, "roots")
        discard(links)
        links = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return links


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``(word, n)``.

    ``n_near`` counts the words one edit away.  ``form`` is the most frequent of them (ties: the
    smallest) if it is at least ``ratio`` times as frequent as the word, else null; ``root`` is
    the end of the chain of forms, the word itself if it has none.
    """
    words = store(words.where(F.length("word") >= 4).groupBy("word").agg(F.sum("n").alias("n")), "words")
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    near = near_pairs(words).select(F.inline(both)).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("n")).alias("back"), "near")).alias("top"))
    forms = spread(words).join(near, "word", "left")
    is_form = -F.col("top.back") >= F.lit(ratio) * F.col("n")
    forms = store(forms.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("top.near")).alias("form"),
        F.when(is_form, -F.col("top.back")).alias("form_n")), "forms")
    found = forms.join(_roots(forms), "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n",
                        F.coalesce("root", "word").alias("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 7,
                least: int = 2, slip: int = 31) -> DataFrame:
    """``word, n`` of all runs of Latin letters in whole texts, A-Z lower-cased.

    With h the crc32 of ``id:run``, a run whose h is divisible by ``slip`` loses its code point
    number h mod length: planted slips.  Words of at least ``shortest`` code points that occur
    ``least`` times are returned.  A null id counts as an empty text before the colon.
    """
    runs = docs.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-zÀ-ÿ]{%d,})" % shortest))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr(F.col("run"), F.lit(1), at), F.substr(F.col("run"), at + 2))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= shortest)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))
