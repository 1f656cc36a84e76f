import random

import corpus_pipeline
from tests.llm.tables import documents, prose
from tracequarry.llm import near_dups, source_mix, toxicity

LINE = "A licence line that very many of the documents carry along"


def write_tables(spark, folder):
    rng = random.Random(3)
    bench = [(i, prose(40, 500 + i)) for i in range(3)]
    rows, labels, kinds = [], [], {}
    for i in range(160):
        text = prose(60, i)
        kind = i % 8
        if kind == 1:
            text += " vilewordish " + prose(5, i)
        elif kind == 2:
            text = text + "\n" + LINE
        elif kind == 3:
            text = prose(80, 7) + f" tail{i}"
        elif kind == 4 and i < 20:
            text += " " + bench[i % 3][1]
        kinds[i] = kind
        rows.append((i, text, f"s{rng.randrange(3)}"))
        labels.append((i, 1, int(kind == 1)))
    rows += [(500, None, None), (501, "", "s1")]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, kinds


def test_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    rows, kinds = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{folder}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i, k in kinds.items() if k == 1}
    assert set(seen["toxicity"]) == {i for i, _, _ in rows} - toxic
    with_line = [i for i, t in seen["line_dedup"].items() if LINE in (t or "")]
    assert with_line == [max(i for i, k in kinds.items() if k == 2)] and set(seen["line_dedup"]) == set(seen["toxicity"])
    copies = {i for i, k in kinds.items() if k == 3}
    assert set(seen["line_dedup"]) - set(seen["near_dups"]) == copies - {min(copies)}
    leaks = {i for i, k in kinds.items() if k == 4 and i < 20}
    assert set(seen["near_dups"]) - set(seen["decontam"]) == leaks
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in mixed} == set(seen["decontam"])
    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in mixed}


def test_stages_use_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dups", "decontam", "source_mix"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert near_dups.THRESHOLD == 0.8 and source_mix.MAX_PATTERNS and toxicity.MAX_PER_CLASS


def edge_tables(spark, folder, rows, labels=(), bench=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic string, n_lines int, `a.b` int"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2) for i, t, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_empty_tables_pass_through(spark, tmp_path):
    docs = edge_tables(spark, str(tmp_path), [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_rows_of_every_stage(spark, tmp_path):
    folder, item = str(tmp_path), prose(30, 900)
    long = " ".join(prose(5000, i) for i in range(8))
    rows = [(1, None, None), (2, "", "s"), (2, "", "s"), (3, long, "s"), (4, "... !", "s"), (None, prose(40, 1), "t"), (5, prose(40, 2), "t"), (5, prose(40, 2), "t")]
    rows += [(6, prose(40, 3), None), (7, prose(40, 3), None), (8, prose(20, 4) + " " + item, "s"), (9, LINE + "\n" + prose(40, 5), "s"), (10, LINE + "\n" + prose(40, 6), "s"), (11, LINE + "\n" + prose(40, 7), "s")]
    docs = edge_tables(spark, folder, rows, bench=[(1, item), (2, None), (3, "")])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    plain = sorted(((i, t) for i, t, _ in rows), key=str)
    assert kept["toxicity"] == plain
    assert kept["line_dedup"] == sorted(((i, (t or "").replace(LINE + "\n", "") if i != 11 else t) for i, t in plain), key=str)
    assert kept["near_dups"] == sorted((x for x in set(plain) if x[0] != 7), key=str)
    assert kept["decontam"] == [x for x in plain if x[0] != 8]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert mixed.count() == len(rows)
    sizes = {(r["doc_id"], r["size"]) for r in mixed.collect()}
    assert (1, 0) in sizes and (4, 2) in sizes and (None, 40) in sizes


def test_the_stages_by_brute_force(spark, tmp_path):
    """All five stages over the rows of one table, against the operators' rules one by one."""
    folder = str(tmp_path)
    rows, kinds = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = corpus_pipeline.queries.toxicity_chain(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    flags = chain.score([t for _, t, _ in rows])[:, chain.names.index(chain.decide)] >= chain.threshold
    left = [(i, t or "", s) for (i, t, s), bad in zip(rows, flags, strict=True) if not bad]
    holders = [i for i, t, _ in left if LINE in t.split("\n")]
    left = [(i, "\n".join(x for x in t.split("\n") if x != LINE or i == max(holders)), s) for i, t, s in left]
    sets = [frozenset(near_dups.shingles(t).tolist()) for _, t, _ in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    left = [r for i, r in enumerate(left) if root[i] == i]
    bench = [r["text"].lower().split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def holds(text):
        words = text.lower().split()
        return any(words[p : p + len(b)] == b for b in bench for p in range(len(words)))

    left = [r for r in left if not holds(r[1])]
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(t.split()) for i, t, _ in left}
    assert all(0 <= taken <= 2 * n for n, taken in got.values())
