import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import CLASHING, ITEMS, TEXTS  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, repeats, long words and clashing columns."""
    rows = [(i, t, *(f"v{k}" if k % 2 else None for k in range(len(CLASHING)))) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """The odd documents, and other tables as odd."""
    base = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, None, None), (None, 1, 1), (10, 0, 0), (10, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    page = "<html>" + "é" * 60
    pages = [(5, "http://a/ b\r\n", page), (3, None, page), (9, "u", page), (9, "u", page), (3, "v", page), (1, "x", "small"), (2, "x", "small"), (4, "y", None), (6, "z", ""), (None, "n", page), (None, None, None), (7, "q", "k" * 99), (8, "q", "k" * 99)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    return str(base)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{base}/{name}.parquet")
    return str(base)
