"""Every query over tables of nulls, empty and long texts, ties and repeated rows, and over empty ones."""

import pytest

from factloom.llm import queries

LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def folders(spark, odd, none, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{base}/odd/documents.parquet")
    none.write.parquet(f"{base}/none/documents.parquet")
    for name, some in (("odd", True), ("none", False)):
        frame = lambda rows, schema: spark.createDataFrame(rows if some else [], schema)  # noqa: B023, E731
        frame([(4, 1, 0), (4, 1, 0), (6, 0, 1), (5, None, None), (None, 1, 1), (999, 1, 1)], LABELS).write.parquet(f"{base}/{name}/labels.parquet")
        frame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (None, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, [1.0, 0.1], None)], VECTORS).write.parquet(f"{base}/{name}/embeddings.parquet")
        frame([(1, None, None), (1, "http://a.com/en/1", "x"), (1, "http://a.com/en/1", "x"), (None, "no scheme", ""), (2, "", "")], PAGES).write.parquet(f"{base}/{name}/pages.parquet")
    return str(base)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_comes_out(spark, folders, odd, name):
    want = {"op4_embeddings": 6, "op10_url_filters": 5, "op12_hard_negatives": 0}.get(name, odd.count())
    got = queries.QUERIES[name](spark, f"{folders}/odd")
    if name in ("op3_packing", "op8_mixing"):
        assert got.count() >= want
    else:
        assert got.count() == want
    empty = queries.QUERIES[name](spark, f"{folders}/none")
    assert empty.count() == 0 and empty.columns == got.columns
