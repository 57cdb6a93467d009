"""The same documents, dealt in other ways, give the same scores; and figures never take a name that is there."""

from pyspark.sql import functions as F

from timberline.llm import line_dedup, quality, toxicity
from timberline.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def test_scores_do_not_hang_on_partitions(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    for made in (toxicity.classified, quality.classified):
        seen = []
        for parts in (3, 7):
            held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
            out = made(docs.repartition(parts, "n_chars"), labels, held_out).select("doc_id", "score").collect()
            seen.append({r.doc_id: r.score for r in out})
        assert len(seen[0]) == 1000
        assert max(abs(seen[0][d] - seen[1][d]) for d in seen[0]) < 1e-10


def test_figures_take_new_names(spark):
    df = spark.createDataFrame([(1, "w " * 60, 7, 8), (2, "w " * 60 + "\nnew", 9, 10)], "doc_id long, text string, __n_lines int, __n_removed_ int")
    got = line_dedup.deduplicated(df)
    assert got.columns == [*df.columns, "__n_lines_", "__n_removed"]
    assert sorted((r.doc_id, r["__n_lines"], r["__n_lines_"], r["__n_removed"], r["__n_removed_"]) for r in got.collect()) == [(1, 7, 1, 0, 8), (2, 9, 2, 1, 10)]
