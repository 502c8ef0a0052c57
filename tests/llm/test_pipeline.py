"""The pipeline's stages chained by hand over the smallest tables, and the cases each stage must survive."""

from pyspark.sql import Row

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    sizes = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "bpe":
            assert docs.columns == columns
        if name in ("quality", "line dedup", "n-gram Jaccard join"):
            assert docs.count() <= n
            n = docs.count()
        sizes.append(docs.count())
    got = P.run(spark, SF)
    assert got.count() == sizes[-1] > 0
    assert sorted(r["ids_sha256"] for r in got.collect()) == sorted(r["ids_sha256"] for r in docs.collect())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, score double, n_removed string, name string, row string, size long"


def odd(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, ties, and columns that clash with working names."""
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    rows = [(0, base), (0, base), (1, base), (2, None), (3, ""), (4, " \n\t"), (None, base), (None, None), (5, " ".join(f"v{i}" for i in range(30_000))), (6, base + " tail"), (7, "one two")]
    out = [(i, t, "en" if i else None, f"s{(i or 0) % 3}" if i != 4 else None, len(t) if t else None, "mine", 0.25, "r", "n", "w", 7) for i, t in rows]
    return spark.createDataFrame(out, ODD)


def keyed(rows):
    return sorted(map(str, rows))


def test_quality_stage(spark):
    """What the classifier scores at the cut or above stays, row by row; clashing columns keep their values."""
    from tidemark.llm import quality

    d = odd(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for docs in (d, spark.read.parquet(f"{SF}/documents.parquet")):
        model = quality.fit_quality(docs.select("doc_id", "text"), labels)
        want = [r for r in docs.collect() if not model.parts or model.score(quality._matrix([None if r["text"] is None else r["text"].encode()]))[0] >= quality.CUT]
        got = P.keep_quality(spark, docs, SF)
        assert got.columns == docs.columns and keyed(got.collect()) == keyed(want)


def test_line_stage(spark):
    from tidemark.llm import lines

    d = odd(spark)
    first, want = {}, []
    for r in sorted(d.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        for x in (r["text"] or "").split("\n"):
            if x.strip():
                first.setdefault(x, r["doc_id"])
    near = {b for b in first for a in first if a != b and min(len(a), len(b)) >= lines.SHORT and first[a] < first[b] and abs(len(a) - len(b)) <= 2 and lines.banded_distance(a, b, 2) <= 2}
    for r in d.collect():
        text = r["text"]
        if text is not None:
            kept = [x for x in text.split("\n") if not x.strip() or (first[x] == r["doc_id"] and x not in near)]
            if len(kept) < len(text.split("\n")):
                if not any(x.strip() for x in kept):
                    continue
                r = Row(**(r.asDict() | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))}))
        want.append(r)
    got = P.drop_lines(spark, d, SF)
    assert got.columns == d.columns and keyed(map(tuple, got.collect())) == keyed(map(tuple, want))


def test_copies_stage(spark):
    d = odd(spark)
    got = P.one_of_each(spark, d, SF)
    # Repeated rows of a kept document stay; rows without an id are compared with nothing.
    want = [r for r in d.collect() if r["doc_id"] not in (1, 6)]
    assert got.columns == d.columns and keyed(got.collect()) == keyed(want)


def test_mixing_stage(spark):
    d = odd(spark)
    got = P.mix(spark, d, SF)
    assert got.columns == d.columns and keyed(got.collect()) == keyed(P.mix(spark, d.repartition(5), SF).collect())
    originals = {(r["doc_id"], r["source"]): r for r in d.where("text IS NOT NULL").collect()}
    for r in got.collect():
        o = originals[r["doc_id"], r["source"]]
        assert r["text"].split() == o["text"].split()[: len(r["text"].split())] and tuple(r)[5:] == tuple(o)[5:]


def test_bpe_stage(spark):
    import hashlib

    from tokenizers import Tokenizer

    from tidemark.llm.queries import tokenizer_path

    lib = Tokenizer.from_file(tokenizer_path())
    got = P.encode(spark, odd(spark), SF).collect()
    want = []
    for r in odd(spark).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), ids))
    assert keyed((r["doc_id"], r["n_tokens"], r["ids_sha256"], list(r["ids"])) for r in got) == keyed(want)


def test_near_copies_of_five_word_shingles(spark):
    """A tail cut off (85% shared) and one changed word of 50: 0.8 or more by five words, below 0.9 by three."""
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(50)]
    texts = [a, a[:170], b, [*b[:25], "other", *b[26:]], a[:150]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.one_of_each(spark, docs.where("doc_id < 4"), SF).collect()) == [0, 2]
    assert sorted(r["doc_id"] for r in P.one_of_each(spark, docs.where("doc_id IN (0, 4)"), SF).collect()) == [0, 4]
