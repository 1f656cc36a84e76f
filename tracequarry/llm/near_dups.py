"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word shingles form one class, which stands for all its copies. MinHash
bands propose pairs of classes; MinHash values are then compared step by step and a pair is
dropped as soon as the posterior probability that it reaches the threshold falls below the
tolerance. What is left is verified exactly on the shingles of the whole texts.

No pair rows are made for large buckets: their members are tied to the bucket's least member only
to bring them into one group. A group of n classes is cut into chunks of BLOCK, and pairs of chunks
are compared as arrays: first sketches alone, then, of the classes that a sketch leaves a partner in
that pair of chunks, whole texts. So a group sends n x n / BLOCK sketches, not n x n pairs; its texts
travel once for every chunk that holds a likely partner. That product is the price of exact counts
of links inside one group of different near copies; copies with the same shingles don't add to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.naming import quoted, unused
from tracequarry.operators.graph import components
from tracequarry.operators.membership import likely_members
from tracequarry.session import staged

WORDS = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 48, 8
SKETCH = 128
STEP = 16
TOLERANCE = 1e-5
SMALL = 16
BLOCK = 384
CHUNK = 1 << 16
#: Shingles that are compared with one text at a time, so that a block of long texts needs little memory.
PART = 1 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """[powers of the base, powers of its inverse], grown on demand."""
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    table = _powers()
    if len(table[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            table[i] = np.cumprod(row, dtype=np.uint64)
    return table[0][:n], table[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are runs of letters, digits and underscores, lower-cased. A text of fewer words than a
    shingle has one shingle, all its words; one without words has none.
    """
    words = WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    found = []
    for at in range(0, len(words) - size + 1, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        data = " ".join(part).encode()
        plain = len(data) == sum(map(len, part)) + len(part) - 1
        lengths = np.fromiter((len(w) if plain else len(w.encode()) for w in part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        power, inverse = powers(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
        starts = ends - lengths
        first, last = starts[: len(part) - size + 1], ends[size - 1 :]
        found.append(mixed((prefix[last] - prefix[first]) * inverse[first]))
    return np.unique(np.concatenate(found) if len(found) > 1 else found[0])


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = BANDS * ROWS
    a = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None], rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def signature(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(hash of each band, one byte of each of the first MinHash values)."""
    a, b, mix = _functions()
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        part = a * x[at : at + 1024]
        part += b
        np.minimum(least, part.min(axis=1), out=least)
    bands = (least.reshape(BANDS, ROWS).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64)
    bands = mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(BASE))
    return bands.view(np.int64), ((least[:SKETCH] * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """Matches needed after each step of comparisons for the posterior to stay over the tolerance.

    With a uniform prior the similarity after m matches in n is Beta(m+1, n-m+1), and it reaches t
    with the probability that Binomial(n+1, t) is at most m. One byte also matches by chance.
    """
    t = threshold + (1 - threshold) / 256
    need = []
    for n in range(STEP, SKETCH + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        need.append(m)
    return tuple(need)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two sketch arrays survive the incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for k, need in enumerate(least_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= need]
        if not len(alive):
            break
    return alive


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, k1, k2, n, bands, sketch) per row; k1, k2 name the set of shingles."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, bands, sketches = [], [], [], []
                for text in part.column(2):
                    found = shingles(text.as_py())
                    keys.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))
                    sizes.append(len(found))
                    band, sketch = signature(found) if len(found) else (np.zeros(0, np.int64), b"")
                    bands.append(band)
                    sketches.append(sketch)
                k = np.array(keys).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(b) for b in bands])].astype(np.int32), np.concatenate([np.zeros(0, np.int64), *bands]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.binary())],
                    names=["doc", "version", "k1", "k2", "n", "bands", "sketch"],
                )

    rows = docs.select(quoted(id_col).alias("doc"), F.xxhash64(quoted(text_col)).alias("version"), quoted(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc {id_type}, version long, k1 long, k2 long, n int, bands array<long>, sketch binary")


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes that may be alike, or share a large bucket and are compared in its group.

    A bucket of at most SMALL classes yields its pairs, which the sketches prune; a larger one ties
    its members to its least member, unpruned.
    """
    banded = classes.select("k1", F.explode("bands").alias("bucket"))
    shared = staged(
        banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("k1").alias("least")).where(F.col("size") > 1),
        "near-shared",
    )
    met = staged(likely_members(banded, "bucket", shared, shared.count()).join(shared, "bucket"), "near-buckets")
    ties = met.where((F.col("size") > SMALL) & (F.col("k1") != F.col("least"))).select(F.col("least").alias("a"), F.col("k1").alias("b")).distinct()
    held = met.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_set("k1")).alias("held"))  # at most SMALL each
    pairs = (
        held.select("held", F.posexplode("held").alias("i", "a"))
        .select("a", F.explode(F.slice("held", F.col("i") + 2, F.lit(SMALL))).alias("b"))
        .distinct()
    )
    sketches = classes.select("k1", "sketch")
    both = pairs.join(sketches.select(F.col("k1").alias("a"), F.col("sketch").alias("left")), "a").join(
        sketches.select(F.col("k1").alias("b"), F.col("sketch").alias("right")), "b"
    )

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3)]
            kept = pa.array(survivors(*rows, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return ties.unionByName(both.select("a", "b", "left", "right").mapInArrow(prune, "a long, b long"))


def sketch_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The classes of one block that have a partner there as far as sketches tell."""
    first, second = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values(["chunk", "k1", "k2"], ignore_index=True)
    n, border = len(pdf), int((pdf["chunk"] == first).sum())
    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(n, SKETCH)
    size = pdf["n"].to_numpy()
    near = np.zeros(n, bool)
    for i in range(n if first == second else border):
        js = np.arange(i + 1 if first == second else border, n)
        js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i])]
        js = js[survivors(np.broadcast_to(sketch[i], (len(js), SKETCH)), sketch[js], threshold)]
        near[i] |= bool(len(js))
        near[js] = True
    return pdf.loc[near, ["comp", "chunks", "i", "j", "chunk", "k1", "k2", "n_docs", "sketch"]]


def parts_of(js: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """``js`` in parts of about PART shingles, at least one each."""
    return np.split(js, np.flatnonzero(np.diff(np.cumsum(lengths[js]) // PART)) + 1)


def shared_with(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted values ``mine`` each of the others, none of them empty, holds."""
    flat = np.concatenate(others)
    at = np.searchsorted(mine, flat)
    hit = mine[np.minimum(at, len(mine) - 1)] == flat
    sizes = np.array([len(x) for x in others])
    return np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)


def compare_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Exact links in one block: pairs inside a chunk, or across two chunks.

    Returns per class the class it hangs on in this block and the documents it links to here.
    """
    first, second = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values(["chunk", "k1", "k2"], ignore_index=True)
    n = len(pdf)
    sets = [shingles(t) for t in pdf.pop("text")]
    lengths = np.array([len(s) for s in sets])
    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(n, SKETCH)
    weight = pdf["n_docs"].to_numpy(np.int64)
    border = int((pdf["chunk"] == first).sum())
    links, root = np.zeros(n, np.int64), list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n if first == second else border):
        js = np.arange(i + 1 if first == second else border, n)
        js = js[np.minimum(lengths[js], lengths[i]) >= threshold * np.maximum(lengths[js], lengths[i])]
        if not len(js):
            continue
        js = js[survivors(np.broadcast_to(sketch[i], (len(js), SKETCH)), sketch[js], threshold)]
        if not len(js):
            continue
        common = np.concatenate([shared_with(sets[i], [sets[j] for j in part]) for part in parts_of(js, lengths)])
        js = js[common >= threshold * (lengths[i] + lengths[js] - common) - 1e-9]
        links[i] += weight[js].sum()
        links[js] += weight[i]
        for j in js:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    tops = [find(i) for i in range(n)]
    out = pdf[["comp", "k1", "k2"]].copy()
    out["r1"], out["r2"] = pdf["k1"].to_numpy()[tops], pdf["k2"].to_numpy()[tops]
    out["links"] = links
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: id, version, class_id, n_links, keep.

    class_id is the least id among all texts that links connect; n_links counts the other rows
    whose shingles have a Jaccard similarity of ``threshold`` or more; keep marks the rows of the
    one text (least id, then version) that stands for the class. Version is the hash of the text,
    which tells apart texts under one id. Copies and repeated rows are linked to each other. Texts
    without words, null ones included, are alone in their class. Null ids are least. Texts of any
    length are read whole; an empty table has no rows; other columns don't take part. Bands miss a
    pair at the threshold with a probability of 2e-4, and far less above it.
    """
    rows = staged(signed(docs, id_col, text_col), "near-signed")
    classes = staged(
        rows.where(F.col("n") > 0)
        .groupBy("k1", "k2")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.min(F.struct("doc", "version")).alias("first"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "near-classes",
    )
    grouped = components(candidate_edges(classes, threshold))
    members = staged(
        classes.join(grouped.select(F.col("node").alias("k1"), F.col("root").alias("comp")), "k1").select(
            "comp", "k1", "k2", "n", "n_docs", "sketch", "first.doc", "first.version"
        ),
        "near-members",
    )
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("k1", "k2"), F.col("chunks")).cast("int")
    placed = (
        members.join(sizes, "comp")
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
    )
    fields = ["comp", "chunks", "i", "j", "chunk", "k1", "k2", "n_docs", "sketch"]
    sketched = (  # a group of one chunk sends each text once anyway
        placed.where(F.col("chunks") > 1)
        .select(*fields, "n")
        .groupBy("comp", "i", "j")
        .applyInPandas(
            lambda pdf: sketch_block(pdf, threshold),
            "comp long, chunks int, i int, j int, chunk int, k1 long, k2 long, n_docs long, sketch binary",
        )
    )
    likely = placed.where(F.col("chunks") == 1).select(*fields).unionByName(sketched)
    version = F.xxhash64(quoted(text_col))
    texts = docs.select(quoted(id_col).alias("__doc"), version.alias("__version"), quoted(text_col).alias("text"), F.xxhash64(quoted(id_col), version).alias("__key"))
    wanted = members.select("doc", "version", "k1", "k2", F.xxhash64("doc", "version").alias("__key"))
    texts = likely_members(texts, "__key", wanted, members.count()).drop("__key")
    fetched = (
        texts.join(wanted, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__version") == F.col("version")))
        .select("k1", "k2", "text")
        .dropDuplicates(["k1", "k2"])
    )
    blocks = likely.join(fetched, ["k1", "k2"])
    verified = staged(
        blocks.groupBy("comp", "i", "j").applyInPandas(
            lambda pdf: compare_block(pdf, threshold), "comp long, k1 long, k2 long, r1 long, r2 long, links long"
        ),
        "near-verified",
    )
    node, hung = F.struct("k1", "k2"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2"))
    # a group in one block is settled there; the hangings of several blocks are joined up
    parts = verified.join(sizes, "comp")
    several = components(parts.where(F.col("chunks") > 1).select(node.alias("a"), hung.alias("b")))
    whole = (
        parts.groupBy("k1", "k2")
        .agg(F.sum("links").alias("links"), F.max("chunks").alias("chunks"), F.min(hung).alias("hung"))
        .join(several.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "root"), ["k1", "k2"], "left")
        .select("k1", "k2", "links", F.when(F.col("chunks") == 1, F.col("hung")).otherwise(F.coalesce("root", node)).alias("root"))
    )
    named = classes.join(whole, ["k1", "k2"], "left").select(
        "k1", "k2", "n_docs", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", node).alias("root")
    )
    heads = named.groupBy("root").agg(F.min("first").alias("head"), F.sum("n_docs").alias("members")).where(F.col("members") > 1)
    facts = named.join(heads, "root").select("k1", "k2", "n_docs", "links", "head")
    alone = F.col("head").isNull() | (F.col("n") == 0)
    return rows.select("doc", "version", "k1", "k2", "n").join(facts, ["k1", "k2"], "left").select(
        F.col("doc").alias(id_col),
        "version",
        F.when(alone, F.col("doc")).otherwise(F.col("head.doc")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_docs") - 1 + F.col("links")).cast("long").alias("n_links"),
        (alone | (F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("version") == F.col("head.version")))).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class, each once; all columns stay as they are.

    Of rows with one id and text one stays, whatever their other columns. Nulls, texts without words
    and empty tables as in ``near_duplicates``.
    """
    doc, version = unused(docs, "doc", "version")
    kept = near_duplicates(docs, id_col, text_col, threshold=threshold).where("keep")
    kept = kept.select(quoted(id_col).alias(doc), F.col("version").alias(version)).distinct()
    same = quoted(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(quoted(text_col)).eqNullSafe(F.col(version)))
    once = docs.join(kept, same, "left_semi").withColumn(version, F.xxhash64(quoted(text_col)))
    return once.dropDuplicates([id_col, version]).drop(version)
