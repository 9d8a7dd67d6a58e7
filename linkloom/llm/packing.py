"""Packing documents into sequences of fixed length: shortest pack first, over the histogram of lengths.

Every text becomes token ids and an end mark. Longer documents are cut at the sequence length. The
histogram of the pieces' lengths, which has no more rows than a sequence has tokens, is packed on the
driver: lengths come longest first, and each goes to the pack that is filled least, for whole counts
of equal packs at a time. The patterns are joined back to the pieces by their rank among the pieces of
their length. Ranks are counted in buckets of bounded size, so a length that a third of all rows share
is no single group.

* Null and empty texts hold the end mark alone. Repeated rows are documents of their own.
* Whole texts are read; very long ones give many pieces. An empty table gives an empty result.
* Ties among equal lengths go by the order in which the pieces were written. Other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import lean, sliced, stored, table

SEQUENCE = 4096
END = 2
#: Pieces of one bucket on average; bytes of words and ids that a task remembers, and what an entry takes besides.
BUCKET_ROWS = 20_000
REMEMBERED_BYTES = 128 << 20
ENTRY_BYTES = 200
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII punctuation but the apostrophe: after a letter or digit it always begins a word of the tokenizer's.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that are looked up in one text.
TOGETHER = 1024


class Encoder:
    """Token ids of texts as little-endian bytes.

    The tokenizer never joins across white space, nor letters with the punctuation after them, and it ignores
    case; so ids are kept by word, and new words are put together from a stem and the punctuation after it. Some
    letters end in a combining mark once they are normalised, and that is joined with punctuation; such words stay whole.
    Stems of letters alone are one word of the tokenizer's each, so many are looked up as one text, which is
    cut again behind the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.parted: dict[str, bool] = {}  # whether the tokenizer parts a letter from the punctuation after it
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _parts(self, letter: str) -> bool:
        found = self.parted.get(letter)
        if found is None:
            last = self.tokenizer.normalizer.normalize_str(letter)[-1:]
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(last + ".") if last else []
            found = self.parted[letter] = len(pieces) == 2 and pieces[1][0] == "."
        return found

    def _one_by_one(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = array("I", found.ids).tobytes()

    def _together(self, words: list[str]) -> None:
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(some) or ends[-1] != 4 * len(ids):
                self._one_by_one(some)
                continue
            whole, start = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                self.known[word] = whole[start:end]
                start = end

    def _learn(self, words: set[str]) -> None:
        known, made, small, letters, other = self.known, [], {}, set(), set()
        for word in words:
            stem = word.rstrip(PUNCTUATION)
            if not stem or "<|" in word or not stem[-1].isalnum() or not (stem[-1].isascii() or self._parts(stem[-1])):
                other.add(word)
                continue
            if len(stem) < len(word):
                made.append((word, stem, tail := word[len(stem) :]))
                if tail not in known:
                    if tail in self.older:
                        known[tail] = self.older[tail]
                    else:
                        other.add(tail)
            if stem not in known and stem in self.older:
                known[stem] = self.older[stem]
            if stem not in known:
                low = stem.lower() if stem.isascii() else stem
                if low != stem:
                    small[stem] = low
                if low not in known:
                    (letters if low.isalpha() else other).add(low)
        self._together(list(letters))
        self._one_by_one(list(other))
        for stem, low in small.items():
            known[stem] = known[low]
        for word, stem, tail in made:
            known[word] = known[stem] + known[tail]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text with the end mark; the texts' new words are looked up together."""
        end = array("I", [END]).tobytes()
        if 2 * self.held > REMEMBERED_BYTES:  # words that come again are taken over from the older half
            self.known, self.older, self.held = {}, self.known, 0
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            before, kept = len(self.known), new & self.older.keys()
            self.known.update((w, self.older[w]) for w in kept)
            self._learn(new - kept)
            self.held += ENTRY_BYTES * (len(self.known) - before) + sum(map(len, new))
        for parts in split:
            yield b"".join(map(self.known.__getitem__, parts)) + end


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each run of at most SEQUENCE ids of a document."""
    path = path or vocabulary()
    width = 4 * SEQUENCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)  # for one task: nothing is kept in the worker process
        for part in sliced(batches, "text", TEXT_BYTES):
            rows: list[list] = [[], [], [], [], []]
            texts = ["" if t is None else t for t in part.column("text").to_pylist()]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                for at in range(0, len(ids), width):
                    cut = ids[at : at + width]
                    for to, value in zip(rows, (doc_id, at // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(count, [(length, times), ...])``: so many packs, each with these lengths.

    All packs of a pattern are filled alike. A step either moves a whole pattern on or ends a length, so
    there are at most two patterns for each length.
    """
    open_packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # by the room that is left
    room = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while room and not open_packs.get(room):
                room -= 1
            if room < length:
                fit = size // length
                for times, count in ((fit, left // fit), (left % fit, 1)):
                    if times and count:
                        open_packs[size - times * length].append((count, [(length, times)]))
                        room = max(room, size - times * length)
                break
            count, content = open_packs[room].pop()
            moved = min(count, left)
            if moved < count:
                open_packs[room].append((count - moved, content))
            last = content[-1]
            grown = [*content[:-1], (length, last[1] + 1)] if last[0] == length else [*content, (length, 1)]
            open_packs[room - length].append((moved, grown))
            left -= moved
    return [pack for free in sorted(open_packs) for pack in open_packs[free]]


class Places:
    """Where the n-th piece of each length goes."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for count, content in patterns:
            offset = 0
            for length, times in content:
                rows.append((length, used[length], first, offset, count))
                used[length] += count * times
                offset += length * times
            first += count
        self.table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)

    @staticmethod
    def find(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        lengths, ranks, first, offsets, count = (np.ascontiguousarray(table[:, i]) for i in range(5))
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        low, high = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
        for value in np.unique(length):
            own = np.flatnonzero(length == value)
            a, b = low[own[0]], high[own[0]]
            row = a + np.searchsorted(ranks[a:b], rank[own], "right") - 1
            within = rank[own] - ranks[row]
            sequence[own] = first[row] + within % count[row]
            offset[own] = offsets[row] + within // count[row] * value
        return sequence, offset


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Add ``rank``: the place of a piece among those of its length, from 0, without a group of all of them."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("piece_id"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("piece_id")) - 1
    return spread.withColumn("within", within).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    rows = stored(pieces(docs, path).withColumn("piece_id", F.monotonically_increasing_id()), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # a row for each length at most
    places = spark.sparkContext.broadcast(Places(shortest_pack_first(histogram)).table)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = Places.find(places.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked(rows, sum(histogram.values())).select(*names, "rank").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def op6_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, packed."""
    return packed(table(spark, folder, "documents").select("doc_id", "text"))
