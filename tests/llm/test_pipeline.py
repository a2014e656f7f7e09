"""The pipeline's stages on the smallest tables: columns, what goes and what stays."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from marketlens.llm import decontaminate, pieces, pii, quality
from marketlens.llm.common import model_path, table, written


def first_of_each(texts):
    """All pairs of texts compared by their sets of five words."""
    cut = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, t in sorted(texts.items()) for w in [(t or "").encode().lower().split()]}
    root = {d: d for d in cut}
    for b in cut:
        for a in cut:
            if a < b and root[a] != root[b] and (cut[a] == cut[b] or 5 * len(cut[a] & cut[b]) >= 4 * len(cut[a] | cut[b])):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return set(root.values())


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = written(stage(spark, docs, sf))
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            scores = quality.scored(docs, quality.train(docs, table(spark, sf, "labels")))
            assert set(after) == {r.doc_id for r in scores.where(F.col("score") >= quality.THRESHOLD).collect()}
        if k == 1:
            assert set(after) == first_of_each({r.doc_id: r.text for r in docs.collect()})
        if k == 2:
            assert decontaminate.contamination(out, table(spark, sf, "benchmark")).where("n_hit > 0").count() == 0
        if k == 3:
            assert set(after) == before
            assert pii.find(out).where("size(base) > 0").count() == 0
            assert out.where("n_chars <> char_length(text)").count() == 0
        if k == 4:
            text = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.text == text[r.doc_id] and r.n_tokens == len(r.ids) for r in out.collect())
        docs = out


def test_stages_go_by_row(spark, tmp_path):
    """Rows without an id, and different texts under one id, stay or go each by its own text."""
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(None, words("a", 40)), (None, words("b", 40)), (1, words("c", 40)), (1, words("d", 40)), (2, words("c", 40)), (None, words("c", 40)), (None, words("a", 40))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    kept = pipeline.drop_near_duplicates(spark, df, "").collect()
    assert key(kept) == sorted([(None, words("a", 40)), (None, words("b", 40)), (1, words("c", 40)), (1, words("d", 40))], key=str)
    spark.createDataFrame([(1, words("b", 12)), (2, words("d", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()
    assert key(clean) == sorted([r for r in rows if r[1] not in (words("b", 40), words("d", 40))], key=str)


def test_stages_take_odd_tables(spark, sf):
    """Nulls, empty and long texts, repeated rows, columns whose names the stages use inside; then empty tables."""
    texts = [(None, None), (None, None), (1, None), (2, ""), (3, "  \n"), (4, "x"), (5, "word " * 3000 + "."), (6, "mail me@example.com now"), (6, "mail me@example.com now"), (7, "plain words of a text.\n" * 40)]
    rows = [(i, t, None, None, None, 1, 0.5, "k", None) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid long, score double, key string, spans string"
    own = spark.createDataFrame(rows, schema).repartition(3)
    for df in (own, own.limit(0)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = written(stage(spark, df, sf))
            assert out.columns == (pipeline.COLUMNS if k < 4 else ["doc_id", "n_tokens", "ids", "text"])
            n, kept = df.count(), out.count()
            assert kept == n if k in (2, 3, 4) else kept <= n
            if n and k == 1:  # one without words, "x", the long one, one mail, the plain one
                assert kept == 5
            if n and k == 3:
                assert {r.text for r in out.where("doc_id = 6").collect()} == {"mail <email> now"} and out.where("text IS NULL").count() == 3


def test_units_spread_over_more_tasks_than_texts(spark):
    """What a task of the lattice sorts and folds stays in memory, so tasks are several times the session's shuffle partitions, and none has many units more than its share."""
    model = pieces.Pieces.load(model_path("piece_bpe_32k.model"))
    found = spark.range(4000).select(F.concat(F.lit(" w"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("long"))
    own = pieces.lattice(found.repartition(pieces._tasks(found), "name"), model).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in own) == 4000
    assert max(r["count"] for r in own) < 4000 / int(spark.conf.get("spark.sql.shuffle.partitions")) / 2
