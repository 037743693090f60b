"""Texts that contain terms, as an equi-join on each term's rarest gram.

A term stands in a text only where all its grams (stretches of q characters) do.
Those grams of the texts that terms have are counted; each term is keyed by the
one of its grams that the fewest texts have.  Texts give their grams, those that
are keys meet their terms, and what meets is verified on the whole term.  A term
costs as much as its rarest gram is frequent, not a look at each text, and a
glossary may grow without a nested loop over it.

Places of grams are found with numpy over Arrow batches, which takes a fiftieth of
the time of a row for each gram; a glossary of over MOST_BROADCAST terms meets the
texts by rows and a shuffle instead.  Grams and what they meet go with a hash of their text, never with the text: a long
text has as many grams as characters, and copies of it for each of them fill the
memory of a task.  The texts come back by that hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of a gram; a shorter term is one gram of its own length.
GRAM = 4
#: Grams that begin in one piece of a term, as finding a place takes time in proportion to the characters before it.
PIECE = 64
#: Characters of a text, and bytes of texts, that are looked through at once.
STRETCH, BLOCK = 4096, 1 << 20
#: Keyed terms up to this number (some 100 bytes each) are sent to all tasks, so that grams aren't moved; more meet by a shuffle.
MOST_BROADCAST = 200_000
#: Odd numbers by which the bytes of a gram are multiplied; sums hash it.
FACTORS = np.random.default_rng(1).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Leading bits of hashes that are looked up in a table first.
LEADING = 20


def with_grams(rows: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """rows with _gram and _at (from 1) of all stretches of the text, in lower case, of these numbers of characters."""
    overlap = f"(?s)(?=(.{{1,{PIECE + max(sizes) - 1}}})).{{1,{PIECE}}}"
    pieces = rows.select("*", F.posexplode(F.regexp_extract_all(T.lower(text), F.lit(overlap), F.lit(1))).alias("_piece", "_held"))
    size = F.explode(F.array(*map(F.lit, sizes))).alias("_size") if len(sizes) > 1 else F.lit(sizes[0]).alias("_size")
    sized = pieces.select("*", size).where(F.length("_held") >= F.col("_size"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("_held") - F.col("_size") + 1))).alias("_i"))
    gram = F.substring("_held", F.col("_i"), F.col("_size"))
    return placed.select(*rows.columns, gram.alias("_gram"), (F.col("_piece") * PIECE + F.col("_i")).alias("_at"))


def _hash(text: str) -> Column:
    return F.xxhash64(T.lower(text)).alias("_text")


def stretches(texts: DataFrame, text: str, size: int = GRAM) -> DataFrame:
    """_text (a hash of the text in lower case) and _held, parts of the text that have all its grams."""
    cut = f"(?s)(?=(.{{1,{STRETCH + size - 1}}})).{{1,{STRETCH}}}"
    low = texts.select(T.lower(text).alias("_low")).where("_low <> ''")
    held = F.when(F.length("_low") <= STRETCH, F.array("_low")).otherwise(F.regexp_extract_all("_low", F.lit(cut), F.lit(1)))
    return low.select(F.xxhash64("_low").alias("_text"), F.explode(held).alias("_held"))


class Seeker:
    """Finds grams in Arrow batches of stretches."""

    def __init__(self, grams: list[str]):
        self.grams = grams
        sizes: dict[int, list[tuple[int, int]]] = {}
        for k, gram in enumerate(grams):
            letters = np.frombuffer(gram.encode(), np.uint8).astype(np.uint64)
            sizes.setdefault(len(letters), []).append((int((letters * FACTORS[: len(letters)]).sum(dtype=np.uint64)), k))
        self.known = {}
        for n, pairs in sizes.items():
            hashes, ranks = (np.array(x, t) for x, t in zip(zip(*sorted(pairs)), (np.uint64, np.int64)))
            leading = np.zeros(1 << LEADING, bool)
            leading[hashes >> np.uint64(64 - LEADING)] = True
            self.known[n] = hashes, ranks, leading

    def found(self, batch: pa.RecordBatch):
        """Rows of the batch and the numbers of grams that begin in them, block by block."""
        held = batch.column("_held").cast(pa.binary()).cast(pa.large_binary())
        if not len(held) or held.buffers()[2] is None:
            return
        ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        letters, first = np.frombuffer(held.buffers()[2], np.uint8), 0
        while first < len(held):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, side="right")) - 1)
            block, until = letters[ends[first] : ends[last]].astype(np.uint64), ends[first + 1 : last + 1] - ends[first]
            hashes = np.zeros(len(block), np.uint64)
            for n in range(1, min(max(self.known, default=0), len(block)) + 1):
                hashes = hashes[: len(block) - n + 1] + block[n - 1 :] * FACTORS[n - 1]
                if n in self.known:
                    known, ranks, leading = self.known[n]
                    at = np.flatnonzero(leading[hashes >> np.uint64(64 - LEADING)])
                    k = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                    row = np.searchsorted(until, at, side="right")
                    true = (known[k] == hashes[at]) & (at + n <= until[row])
                    yield first + row[true], ranks[k[true]]
            first = last

    def count(self, batches):
        total = np.zeros(len(self.grams), np.int64)
        for batch in batches:
            for _, k in self.found(batch):
                total += np.bincount(k, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([self.grams[k] for k in seen], pa.string()), pa.array(total[seen])], ["_gram", "_n"])

    def meet(self, batches):
        for batch in batches:
            texts = batch.column("_text").to_numpy(zero_copy_only=False)
            for row, k in self.found(batch):
                row, k = np.divmod(np.unique(row * len(self.grams) + k), len(self.grams))
                yield pa.RecordBatch.from_arrays([pa.array(texts[row]), pa.array([self.grams[x] for x in k], pa.string())], ["_text", "_gram"])


def _seek(grams: DataFrame) -> Seeker:
    return Seeker([r["_gram"] for r in grams.select("_gram").distinct().collect()])  # those of a broadcast


def grams_of_texts(texts: DataFrame, text: str, size: int = GRAM) -> DataFrame:
    """_text and _gram, a row for each stretch of `size` characters in a text; at its end also shorter ones."""
    held = stretches(texts, text, size)
    return held.select("_text", F.explode(F.array_distinct(F.regexp_extract_all("_held", F.lit(f"(?s)(?=(.{{1,{size}}}))."), F.lit(1)))).alias("_gram"))


def rarest_grams(texts: DataFrame, terms: DataFrame, text: str, term: str, size: int = GRAM, few: bool = True) -> DataFrame:
    """terms with _gram, the least frequent gram of the term in the texts (of equals the first in order).

    Terms shorter than `size` are their own gram.  Empty and null terms are left out.
    """
    names = terms.select(F.col(term).alias("_term")).where(F.length("_term") > 0).distinct()
    short = names.where(F.length("_term") < size).select("_term", T.lower("_term").alias("_gram"))
    spelled = with_grams(names.where(F.length("_term") >= size), "_term", [size]).drop("_at")
    if few:
        counted = stretches(texts, text, size).mapInArrow(_seek(spelled).count, "_gram string, _n long")
    else:
        counted = grams_of_texts(texts, text, size).join(spelled.select("_gram").distinct(), "_gram", "left_semi").select("_gram", F.lit(1).alias("_n"))
    # a gram that no text has is the best of keys
    frequent = spelled.join(counted.groupBy("_gram").agg(F.sum("_n").alias("_n")), "_gram", "left")
    best = frequent.groupBy("_term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_best"))
    return terms.join(short.unionByName(best.select("_term", "_best._gram")), F.col(term) == F.col("_term")).drop("_term")


def containing(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", size: int = GRAM, most: int = MOST_BROADCAST, among: DataFrame | None = None) -> DataFrame:
    """The rows of texts x terms whose text contains the term, both in lower case.

    Repeated rows of either side stay repeated.  Null texts and null or empty
    terms meet nothing.  Terms are counted: up to `most` are broadcast, more meet
    the texts' grams by a shuffle.  `among` may have all texts, and others, where
    they are cheaper to read.
    """
    among = texts if among is None else among
    few = terms.where(F.length(term) > 0).count() <= most
    near = F.broadcast if few else lambda rows: rows
    keyed = rarest_grams(among, terms, text, term, size, few).select(F.col(term).alias("_term"), "_gram").distinct()
    if few:
        # the keys are collected once, and serve as a table again
        keyed = terms.sparkSession.createDataFrame([tuple(r) for r in keyed.collect()], "_term string, _gram string")
        grams = stretches(among, text, size).mapInArrow(_seek(keyed).meet, "_text long, _gram string")
    else:
        # a shorter gram is the beginning of a longer one
        sized = F.array_distinct(F.array(*[F.substring("_gram", 1, n + 1) for n in range(size)]))
        grams = grams_of_texts(among, text, size).select("_text", F.explode(sized).alias("_gram"))
    met = grams.join(near(keyed), "_gram").select("_text", "_term").distinct()
    named = met.join(near(terms.withColumn("_name", T.lower(term))), F.col("_term") == F.col(term)).drop("_term")
    found = texts.withColumns({"_text": _hash(text), "_low": T.lower(text)}).join(named, "_text")
    return found.where(F.contains("_low", F.col("_name"))).drop("_text", "_low", "_name")
