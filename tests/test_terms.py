"""Term statistics against their SQL on odd texts."""

import pytest
from corpusloom.plans.registry import QUERIES, SQL
from oracle import connect, differences

ODD = ["İSTANBUL Zürich Kelvin wide open road", "ÉTÉ ẞaal Ångström İzmir road open", "a", "", None, "wide wide wide open"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    # each text in several documents, one document in two rows and one without an id
    rows = [(8 * k + j, t) for k, t in enumerate(ODD) for j in range(6)] + [(0, "open road again and wide"), (None, "wide open")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    frame.to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["mean_tfidf", "ngram_counts", "paired_cosines", "term_rates"])
def test_odd_texts(spark, odd, name):
    assert differences(QUERIES[name](spark, odd), connect(odd), SQL[name]) == []
