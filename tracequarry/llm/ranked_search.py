"""Ranked lexical search over sharded postings, in whole numbers.

A pass over the texts keeps, for each document, its number of terms and the counts of those that some
item asks for. Documents are dealt evenly to shards of bounded size. A shard's row holds its documents in
the order of their ids and, for each term, a posting list sorted by document: gaps and counts as numbers
of one to five bytes. Document frequencies are added up over the shards.

A shard answers an item document at a time: a heap of one cursor a term, keyed by the next document,
yields the least documents; all cursors that stand in a window of documents are moved through it and add
to the scores of the window, which then offers its best to a heap of k results, keyed by score, then by
document. Windows stand in for single documents only so that numpy can do the additions. The shards'
results meet in one ranking per item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.naming import quoted
from tracequarry.session import staged

DOCS_A_SHARD = 16_384
WINDOW = 4_096
#: Bytes of items' texts that are searched for in one pass: they are gathered and sent to the tasks.
ITEMS_AT_ONCE = 32 << 20
#: Every byte that isn't part of a term becomes a space, capital A to Z the small letter.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, only A to Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each number): seven bits a byte, low ones first; the top bit says that more follow."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    begins = ends - size
    for i in range(int(size.max(initial=0))):
        has = size > i
        more = (size > i + 1)[has]
        out[begins[has] + i] = (values[has] >> (7 * i) & 127) | (more * 128)
    return out, ends


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that ``packed_numbers`` wrote."""
    last = data < 128
    ends = np.flatnonzero(last)
    begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    out = np.zeros(len(ends), dtype=np.int64)
    size = ends - begins + 1
    for i in range(int(size.max(initial=0))):
        has = size > i
        out[has] |= (data[begins[has] + i].astype(np.int64) & 127) << (7 * i)
    return out


def counted(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, lot, n, asked, held): terms of each document that has any, and the counts of the vocabulary's in it.

    ``lot`` numbers a task's rows, so that shards are even whatever the ids are.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.select(quoted(key).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = known.value.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            keep, lots, sizes, asked, held = [], [], [], [], []
            texts = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                words = terms(texts[i].as_py() or b"")
                if words:
                    found = sorted(Counter(filter(None, map(get, words))).items())
                    keep.append(i)
                    lots.append(row)
                    sizes.append(len(words))
                    asked.append([t for t, _ in found])
                    held.append([n for _, n in found])
                    row += 1
            columns = [batch.column("id").take(pa.array(keep, pa.int64())), pa.array(lots, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(x, pa.list_(pa.int32())) for x in (asked, held)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lot", "n", "asked", "held"])

    rows = docs.select(quoted(key).alias("id"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lot bigint, n bigint, asked array<int>, held array<int>")


def index(rows: DataFrame, shards: int) -> DataFrame:
    """One row a shard: ids and n of its documents in order of id, null ids last; terms, dfs, ends and postings.

    ``ends`` are the byte ends of the terms' posting lists. A list holds the gap to the document before and
    the count less one, document by document.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("lot", "ascending")], null_placement="at_end")).combine_chunks()
        asked = table.column("asked").combine_chunks()
        doc = pc.list_parent_indices(asked).to_numpy(zero_copy_only=False).astype(np.int64)
        term = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        held = table.column("held").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((doc, term))
        doc, term, held = doc[order], term[order], held[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
        gap = np.diff(doc, prepend=-1)
        gap[first] = doc[first] + 1
        data, ends = packed_numbers(np.column_stack([gap - 1, held - 1]).ravel())
        last = np.r_[first[1:], len(term)] if len(first) else first
        row = {
            "shard": [table.column("shard")[0].as_py()],
            "ids": [table.column("id").to_pylist()],
            "n": [table.column("n").to_pylist()],
            "terms": [term[first].tolist()],
            "dfs": [(last - first).tolist()],
            "ends": [ends[2 * last - 1].tolist() if len(first) else []],
            "postings": [data.tobytes()],
        }
        kinds = {"shard": pa.int32(), "ids": pa.list_(table.schema.field("id").type), "n": pa.list_(pa.int64()), "terms": pa.list_(pa.int32())}
        kinds |= {"dfs": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "postings": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in row.items()})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("lot"), F.lit(shards)).cast("int"))
    schema = f"shard int, ids array<{kind}>, n array<bigint>, terms array<int>, dfs array<bigint>, ends array<bigint>, postings binary"
    return dealt.groupBy("shard").applyInArrow(build, schema)


class Cursor:
    """A term's posting list in one shard: documents in order, and what each adds to a score."""

    __slots__ = ("adds", "at", "docs")

    def __init__(self, docs: np.ndarray, adds: np.ndarray) -> None:
        self.docs, self.adds, self.at = docs, adds, 0


def best_documents(cursors: list[Cursor], k: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(score, document) of the k best, best first; equal scores by document. Scores are over 0."""
    merge = [(int(c.docs[0]), i) for i, c in enumerate(cursors) if len(c.docs)]
    heapq.heapify(merge)
    results: list[tuple[int, int]] = []  # (score, -document): the worst on top
    while merge:
        low = merge[0][0]
        scores = np.zeros(window, dtype=np.int64)
        while merge and merge[0][0] < low + window:
            c = cursors[merge[0][1]]
            stop = c.at + int(np.searchsorted(c.docs[c.at :], low + window))
            scores[c.docs[c.at : stop] - low] += c.adds[c.at : stop]
            c.at = stop
            if stop < len(c.docs):
                heapq.heapreplace(merge, (int(c.docs[stop]), merge[0][1]))
            else:
                heapq.heappop(merge)
        # later documents lose ties, so only higher scores than the worst kept can enter
        found = np.flatnonzero(scores > (results[0][0] if len(results) == k else 0))
        if len(found) > k:
            found = found[np.lexsort((found, -scores[found]))[:k]]
        for d in found.tolist():
            entry = (int(scores[d]), -(low + d))
            if len(results) < k:
                heapq.heappush(results, entry)
            elif entry > results[0]:
                heapq.heapreplace(results, entry)
    return [(s, -d) for s, d in sorted(results, reverse=True)]


def searched(shards: DataFrame, items: list[dict[int, int]], weight: dict[int, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): the k best documents of each shard for each item."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    asked = shards.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = asked.value
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r] for c in batch.schema.names}
                ids = cell["ids"].values
                n = cell["n"].values.to_numpy(zero_copy_only=False)
                m = 100 - 75 + 75 * n * n_docs // n_terms
                data, begin, lists = np.frombuffer(cell["postings"].as_py(), dtype=np.uint8), 0, {}
                for term, end in zip(cell["terms"].as_py(), cell["ends"].as_py(), strict=True):
                    pairs = unpacked_numbers(data[begin:end])
                    docs, tf = np.cumsum(pairs[::2] + 1) - 1, pairs[1::2] + 1
                    lists[term] = docs, weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
                    begin = end
                number, document, score = [], [], []
                for i, item in enumerate(items):
                    cursors = [Cursor(lists[t][0], lists[t][1] * times) for t, times in item.items() if t in lists]
                    for s, d in best_documents(cursors, k):
                        number.append(i)
                        document.append(d)
                        score.append(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int32()), ids.take(pa.array(document, pa.int64())), pa.array(score, pa.int64())], ["item", "id", "score"]
                )

    return shards.mapInArrow(run, f"item int, id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_key, rank, key, score): the k documents of the highest score for each item.

    Null texts have no terms: such documents don't count and such items have no rows, nor have items
    none of whose terms occur. Equal scores go by ascending key, null keys last. Rows of documents with one
    key count each as a document; equal items (key and text) count once. Without documents or items there
    are no rows. Other columns don't take part, whatever their names.

    Items are taken in blocks of about ``ITEMS_AT_ONCE`` bytes of text; each block is a pass over all
    documents and gathers its items' terms, nothing of the documents.
    """
    spark = docs.sparkSession
    wanted = items.select(quoted(item_key).alias("id"), quoted(item_text).cast("string").alias("text")).where("text is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-size // ITEMS_AT_ONCE))
    item_kind = wanted.schema["id"].dataType
    kind = docs.select(quoted(key).alias("id")).schema["id"].dataType
    out = spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, id {kind.simpleString()}, score bigint")
    for b in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        vocabulary: dict[bytes, int] = {}
        asked = [{vocabulary.setdefault(t, len(vocabulary) + 1): c for t, c in Counter(terms(r.text.encode())).items()} for r in own]
        rows = staged(counted(docs, key, text, vocabulary), "search-counts")
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        if not own or not n_docs:
            continue
        shards = staged(index(rows, -(-n_docs // DOCS_A_SHARD)), "search-index")
        lists = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs"))
        # of the block's terms only
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in lists.collect()}
        found = searched(shards.repartition(max(1, -(-n_docs // DOCS_A_SHARD))), asked, weight, n_docs, n_terms, k)
        best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        ranked = found.withColumn("rank", best).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(own)], f"item int, item_id {item_kind.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"))
    return out.select(F.col("item_id").alias(item_key), "rank", F.col("id").alias(key), "score")
