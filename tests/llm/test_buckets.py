"""The number of buckets follows the chunks and changes no result."""

import pytest

from voxhull.llm import chunks, near_copies, phrases, suffixes


def rows(df):
    return sorted(tuple(map(repr, r)) for r in df.collect())


@pytest.mark.parametrize("operator", [phrases.remove_repeats, suffixes.remove_recurring, near_copies.one_of_each])
def test_results_are_alike_whatever_the_buckets(spark, data, operator, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(6, "doc_id")
    want = rows(operator(docs))
    seen = []

    def counted(table):
        seen.append(chunks.n_buckets(table))
        return seen[-1]

    monkeypatch.setattr(chunks, "A_BUCKET", 0.05)
    for module in (phrases, suffixes, near_copies):
        monkeypatch.setattr(module, "n_buckets", counted)
    assert rows(operator(docs)) == want
    assert seen and min(seen) >= 100 > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
