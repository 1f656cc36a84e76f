"""Documents as token pieces, packed into sequences of a fixed length by best-two-fit.

Only lengths matter for packing, and there are at most ``limit`` of them. So the plan is made on the
histogram of lengths, which has the same size for any corpus: a sequence is filled greedily with the
largest piece that fits; then its smallest piece gives way to two unpacked ones that fit the wider gap
more tightly. A filling is used as often as the counts allow before the next one is made. Pieces are then
numbered within their length, and the number says which sequence holds a piece and where.

Texts are encoded once, in tasks. Text without white space inside is encoded by the tokenizer; what it
gives for a chunk between ASCII white space doesn't depend on the rest of the text (tests compare), so a
worker remembers chunks, and the words of simple ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.naming import quoted
from tracequarry.session import staged

LIMIT = 4096
END = 1
#: Chunks, and words, that a worker remembers before it starts anew, and the longest chunk that it remembers, in bytes.
REMEMBERED, LONGEST = 900_000, 60
#: Chunks of these alone fall into the tokenizer's words as the second pattern says: letters of Latin-1, digits, marks.
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!#-&(-;=>?@\[-`{-~]+")
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!#-&(-/:;=>?@\[-`{-~]+")
DOCS_AT_ONCE = 128


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts as the bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each chunk. Simple ones are put together from the ids of their words."""
        simple, other = {}, []
        for c in chunks:
            text = c.decode()
            if SIMPLE.fullmatch(text):
                simple[c] = WORD.findall(text.lower())
            else:
                other.append(c)
        new = list(set(filterfalse(self.words.__contains__, chain.from_iterable(simple.values()))))
        if new:
            if len(self.words) + len(new) > REMEMBERED:
                self.words.clear()
                new = list(set(chain.from_iterable(simple.values())))
            self.words.update(zip(new, self.ids_of_words(new), strict=True))
        word = self.words.__getitem__
        out = {c: b"".join(map(word, parts)) for c, parts in simple.items()}
        out |= {c: i.tobytes() for c, i in zip(other, self.ids([c.decode() for c in other]), strict=True)}
        return out

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Words are encoded as one text and told apart by the tokens that end one."""
        (ids,) = self.ids([" ".join(words)])
        cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
        if len(cuts) != len(words) + 1:
            return [i.tobytes() for i in self.ids(words)]
        joined = ids.tobytes()
        return [joined[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        known = [list(map(self.chunks.get, chunks)) for chunks in split]
        new = {c for chunks, ids in zip(split, known, strict=True) for c, i in zip(chunks, ids, strict=True) if i is None}
        if new:
            learnt = self.learn(list(new))
            if len(self.chunks) + len(learnt) > REMEMBERED:
                self.chunks.clear()
            self.chunks.update((c, i) for c, i in learnt.items() if len(c) <= LONGEST)
            known = [[learnt[c] if i is None else i for c, i in zip(chunks, ids, strict=True)] for chunks, ids in zip(split, known, strict=True)]
        return [b"".join(ids) for ids in known]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, limit: int = LIMIT, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document's ids and the id that ends it, cut after each ``limit``.

    ``keep_ids`` adds the ids themselves. A null text is an empty one and gives the end alone. Repeated
    rows give their pieces each; a null key stays null. An empty table has no rows. Other columns don't
    take part.
    """
    where = path or tokenizer_path()
    kind = docs.select(quoted(key).alias("id")).schema["id"].dataType.simpleString()
    end, cut = np.array([END], dtype="<u4").tobytes(), 4 * limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where).encode
        for batch in batches:
            texts, keys = batch.column("text").cast(pa.binary()), batch.column("id")
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                owner, piece, length, crc, ids = [], [], [], [], []
                for i, made in enumerate(encode([t or b"" for t in texts[at : at + DOCS_AT_ONCE].to_pylist()]), at):
                    made += end
                    for n, start in enumerate(range(0, len(made), cut)):
                        part = made[start : start + cut]
                        owner.append(i)
                        piece.append(n)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                number = pa.array(piece, pa.int32())
                start = pa.array(np.array(piece, dtype=np.int64) * limit, pa.int64())
                columns = [keys.take(pa.array(owner, pa.int64())), number, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    made = docs.select(quoted(key).alias("id"), quoted(text).cast("string").alias("text")).mapInArrow(run, schema)
    return made.withColumnRenamed("id", key)


def best_two_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings as (how often, [(length, how many)]), lengths falling, that use up all counts.

    Bit l of ``there`` says that pieces of length l are left; bits of two such numbers, one of them
    mirrored and shifted, tell at once whether two lengths add up to a sum.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not (min(left) >= 1 and max(left) <= limit):
        raise ValueError("lengths must be from 1 to the limit")
    there = sum(1 << n for n in left)
    mirror = sum(1 << (limit - n) for n in left)
    out = []
    while left:
        used: dict[int, int] = {}
        free, gap = there, limit

        def spend(n: int, times: int) -> None:
            nonlocal free, gap
            used[n] = used.get(n, 0) + times
            gap -= n * times
            if used[n] == left[n]:
                free &= ~(1 << n)

        while gap and (n := (free & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            spend(n, min(gap // n, left[n] - used.get(n, 0)))
        smallest = min(used)
        if gap and (pair := tightest_pair(free, mirror, left, used, smallest, smallest + gap, limit)):
            used[smallest] -= 1
            gap += smallest
            if not used[smallest]:
                del used[smallest]
            for n in pair:
                spend(n, 1)
        times = min(left[n] // k for n, k in used.items())
        out.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                there &= ~(1 << n)
                mirror &= ~(1 << (limit - n))
    return out


def tightest_pair(free: int, mirror: int, left: dict[int, int], used: dict[int, int], above: int, most: int, limit: int) -> tuple[int, int] | None:
    """Two unpacked lengths of the largest sum that is over ``above`` and at most ``most``; the least uneven pair."""
    for total in range(most, above, -1):
        shift = limit - total
        both = free & (mirror >> shift if shift >= 0 else mirror << -shift)
        both &= (1 << (total // 2 + 1)) - 1
        while both:
            small = both.bit_length() - 1
            large = total - small
            if small and free >> large & 1 and (small != large or left[small] - used.get(small, 0) >= 2):
                return large, small
            both &= ~(1 << small)
    return None


class Places:
    """Where the n-th piece of a length goes: runs of equal fillings as sorted arrays."""

    SPAN = 1 << 44

    def __init__(self, fillings: list[tuple[int, list[tuple[int, int]]]]) -> None:
        rows, seen, sequence = [], {}, 0
        for times, lengths in fillings:
            offset = 0
            for n, k in lengths:
                first = seen.get(n, 0)
                rows.append((n * self.SPAN + first, k, sequence, offset))
                seen[n] = first + k * times
                offset += n * k
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.keys, self.each, self.first, self.offset = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], [])))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * self.SPAN + rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        inside = key - self.keys[at]
        return self.first[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def numbered(pieces: DataFrame, order: list[str], total: int) -> DataFrame:
    """Adds ``rank``: the place from 0 among the pieces of one length, counted in hashed parts of a length.

    A length that many pieces have spans as many parts as it needs: about 65,536 pieces lie in each.
    """
    parts = max(32, -(-total // 65_536))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order))
    ranked = dealt.withColumn("inside", inside).join(offsets, ["length", "part"])
    return ranked.withColumn("rank", (F.col("ahead") + F.col("inside") - 1).cast("long")).drop("part", "inside", "ahead")


def pack(pieces: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Pieces with sequence_id and offset: sequences hold at most ``limit`` tokens, without gaps from 0.

    Takes what ``token_pieces`` gives. Equal pieces are interchangeable, so ties don't matter; repeated
    rows are packed each. No pieces give no rows. The driver holds one count a length and the plan.
    """
    spark = pieces.sparkSession
    table = staged(pieces.withColumnRenamed(key, "id"), "pack-pieces")
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # limit rows at most
    places = spark.sparkContext.broadcast(Places(best_two_fit(counts, limit)))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def found(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = numbered(table, ["id", "piece", "ids_crc32"], sum(counts.values()))
    named = ranked.withColumn("found", found("length", "rank"))
    return named.select(F.col("id").alias(key), *(c for c in table.columns if c != "id"), "found.sequence_id", "found.offset")
