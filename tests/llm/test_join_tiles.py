"""The join's tiles: passages that many documents share, large groups of copies and sizes at the limit, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import ngram_join


def _brute(rows):
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} for i, w in ((i, t.split()) for i, t in rows)}
    least = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


def _template(rng, key, shared, own, common):
    """`shared` words of a common passage, then `own` words that no other document has."""
    return " ".join([*common[:shared], *(f"w{key}x{j}y{rng.integers(1 << 30)}" for j in range(own))])


@pytest.mark.parametrize("small_blocks", [False, True])
def test_shared_passages_and_sizes_at_the_limit(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("BLOCK", 3), ("PARTNERS", 2), ("HOT_CLASS", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(5)
    common = [f"c{j}" for j in range(400)]
    rows = []
    for shared in (40, 80, 81, 88, 89, 90, 100, 120):
        for own in (0, 1, 4, 10, 11, 12, 16, 20, 30):
            for _ in range(3):
                rows.append((len(rows) * 7 % 1009, _template(rng, len(rows), shared, own, common)))
    rows += [(2000 + k, " ".join(common[k:k + 90])) for k in range(0, 24, 2)]          # a chain of sliding windows
    rows += [(3000 + k, " ".join(common[:100])) for k in range(9)]                     # a group of copies
    found = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == _brute(rows) and len(found) == len(rows)


def test_a_passage_below_the_limit_brings_nothing_together(spark, monkeypatch):
    """300 documents share 84 to 88 % of their shingles: they link with none, and hardly any row is compared with another."""
    met = []
    compare = ngram_join._meetings
    monkeypatch.setattr(ngram_join, "_meetings", lambda rows, signed: met.append(rows.count()) or compare(rows, signed))
    rng = np.random.default_rng(6)
    common = [f"c{j}" for j in range(400)]
    rows = [(k, _template(rng, k, 200 + int(rng.integers(0, 8)), 34, common)) for k in range(300)]
    found = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert all(r.component_id == r.doc_id for r in found) and len(found) == 300
    assert sum(met) <= 300


def test_largest_partner(spark):
    rows = spark.range(1, 400).select(F.col("id").alias("n")).withColumn("place", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 5).cast("int"))))
    for n, place, most in rows.select("n", "place", ngram_join.largest_partner(F.col("n"), F.col("place"))).collect():
        assert most == max(m for m in range(2 * n + 2) if 4 * (n + m) <= 9 * (n - place))
