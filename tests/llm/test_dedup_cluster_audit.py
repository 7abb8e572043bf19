"""Brute-force versions of exact dedup, centroid clustering and the filter audit on small tables with planted cases."""

import hashlib
import math
import re
import tempfile
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from ledgermill.llm import exact_dedup, filter_audit, heap_clusters

LONG = " ".join(f"w{i}" for i in range(40_000))
TEXTS = [(9, "a  b\tc"), (3, "a b c"), (3, "a b c"), (4, " a b c"), (5, "a b c"), (6, None), (1, ""), (None, "a b\nc"), (None, "only"), (None, "only"),
         (7, LONG), (2, LONG.replace(" ", "\n\n")), (8, LONG + "x"), (10, LONG[:-1] + "z"), (11, "ß" * 70_000), (12, "ß" * 70_000), (13, "b a c"), (2**60 + 1, "big"),
         (2**60, "big")]


def brute_groups(rows):
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for text in {t for _, t in plain}:
        ids = [i for i, t in plain if t == text]
        least = min((i for i in ids if i is not None), default=None)
        kept = ids.index(least)
        out += [(i, least, len(ids), n == kept, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("primes, chunk, huge", [(exact_dedup.PRIMES, exact_dedup.CHUNK, exact_dedup.HUGE), (exact_dedup.PRIMES, 1000, 50_000),
                                                 ((3, 2), 7, 10**9), ((3, 2), 4096, 20)])
def test_dedup_equals_brute_force(spark, primes, chunk, huge):
    """Tiny primes make different texts of equal length collide; a small bound makes texts huge."""
    rows = TEXTS + [(100 + i, w) for i, w in enumerate(["abc", "acb", "bca", "abd", "abc", "xyz", "acb"] * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.groups(table, primes=primes, chunk=chunk, huge=huge).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == brute_groups(rows)


def test_fingerprints_compose(spark):
    data = np.frombuffer(np.random.default_rng(1).bytes(200_001), np.uint8)
    whole = exact_dedup.text_hash(data)
    value = [0, 0]
    for byte in data.tolist():
        value = [(v * b + byte) % p for v, b, p in zip(value, exact_dedup.BASES, exact_dedup.PRIMES)]
    assert whole == tuple(value)
    for cut in (0, 1, 65_536, 100_000, 200_001):
        left, right = exact_dedup.text_hash(data[:cut]), exact_dedup.text_hash(data[cut:])
        assert exact_dedup.compose(left, right, len(data) - cut) == whole
    pieces, at = [], 0
    for no, size in enumerate((70_000, 1, 130_000)):
        h = exact_dedup.text_hash(data[at:at + size])
        at += size
        pieces += [(1, len(data), no, len(data) - at, *h)] * (2 if no == 1 else 1)      # one piece comes twice
    table = spark.createDataFrame([*pieces, (1, len(data), 3, 0, *exact_dedup.text_hash(data[at:]))],
                                  "doc_id long, n_bytes long, no long, after long, f1 long, f2 long")
    row = exact_dedup.composed(table, ["doc_id"]).first()
    assert (row.f1, row.f2) == whole


def test_unique_keeps_all_columns(spark):
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, "a  b", 2, "y"), (3, None, 3, None), (None, "n", 4, "z"), (3, "other", 5, "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, tag int, sha string")
    found = exact_dedup.unique(table)
    assert found.columns == table.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted({r for r in rows if r[0] != 2}, key=str)
    assert exact_dedup.groups(table.limit(0)).count() == 0 and exact_dedup.unique(table.limit(0)).count() == 0


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64
            and all(c is not None and math.isfinite(c) and abs(c) < 2 ** 17 for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    points = [x for _, x in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, p)), c) for c, p in enumerate(points)) for _, x in kept]
    for _ in range(rounds):
        at = assign()
        for c in range(len(points)):
            own = [x for (_, x), (_, cluster) in zip(kept, at) if cluster == c]
            if own:
                points[c] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = Counter()
    for d, c in at:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, at))


def vectors(n, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + 0.4 * random.normal(size=64)).tolist()) for i in range(n)]
    rows += [(3, rows[4][1]), (3, rows[4][1]), (None, rows[5][1]), (n, None), (n + 1, [1.0] * 63), (n + 2, [math.nan] + [0.0] * 63),
             (n + 3, [None] + [0.0] * 63), (n + 4, [math.inf] + [0.0] * 63), (n + 5, [1e200] * 64), (n + 6, [0.0] * 64), (n + 7, []), (n + 8, [100_000.0] * 64)]
    return rows


@pytest.mark.parametrize("rows", [vectors(400, 5), [(i, [float(i)] * 64) for i in range(3)], [(1, None)]])
def test_clusters_equal_brute_force(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = heap_clusters.cluster(table).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == brute_clusters(rows)


def test_heaps_spare_scans_and_stay_exact(spark):
    """Over many rounds only a part of the vectors is scanned again, and the state equals a full scan at any time."""
    random = np.random.default_rng(7)
    x = (1024 * (np.repeat(random.normal(size=(6, 64)), 300, axis=0) + 0.7 * random.normal(size=(1800, 64)))).astype(np.int32)
    points, drift, state, scans = x[:8].astype(np.int64), np.zeros(8), None, []
    for _ in range(15):
        state, _, scanned = heap_clusters.revise(x, state, points, drift)
        scans.append(scanned)
        best, _ = heap_clusters.scan(x, np.arange(len(x)), points)
        assert (best == state.own).all() and sum(map(len, state.heaps)) == len(x)
        means = np.array([x[best == c].astype(np.int64).sum(axis=0) // max((best == c).sum(), 1) if (best == c).any() else points[c] for c in range(8)])
        moves = np.sqrt(((means - points) ** 2).sum(axis=1))
        drift = drift + moves + np.array([max(np.delete(moves, c)) for c in range(8)])
        points = means
    assert scans[0] == len(x) and min(scans[1:]) < len(x) / 2


def brute_audit(docs, labels):
    texts = [(i, t or "", p or "") for i, t, p in docs]
    masks = []
    for i, t, p in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        later = i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search("[#$%&*|]", t)), later]
        good = any(j == i and q == 1 for j, q, _ in labels if j is not None)
        toxic = any(j == i and x == 1 for j, _, x in labels if j is not None)
        masks.append((p, dict(zip("ABCDE", fails)), good, toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in masks}:
            left = [m for m in masks if m[0] == part]
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                own = [m for m in masks if m[0] == part]
                out[part, order, step] = (len(left), len(gone), sum(m[1][f] for m in own) - len(gone),
                                          sum(m[1][f] and sum(m[1].values()) == 1 for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


VARIED = [" ".join(f"w{i}" for i in range(150)), "short one", "Same " * 120, " ".join(f"w{i} AB" for i in range(60)), "cost $5", "", LONG]
LABELS = [(3, 1, 0), (3, 0, 0), (8, 0, 1), (11, 1, 1), (None, 1, 1), (40, None, None), (7, 1, None)]


def audit_docs():
    docs = [(100 - i, VARIED[i % len(VARIED)], ["en", "de", None, ""][i % 4]) for i in range(95)]      # larger ids come first
    return docs + [(None, VARIED[0], "en"), (None, VARIED[1], "xx"), (6, VARIED[5], "de"), (6, VARIED[5], "fr"), (6, VARIED[5], "de"), (50, None, None)]


def rows_of(found):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


def test_audit_equals_brute_force_over_micro_batches(spark):
    docs, folder = audit_docs(), tempfile.mkdtemp(prefix="audit-")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, mask int, key string"
    for start in range(0, len(docs), 20):           # one file after another, ids falling: earlier masks are taken back
        spark.createDataFrame([(*d, 1, "k") for d in docs[start:start + 20]], schema).coalesce(1).write.mode("append").parquet(f"{folder}/docs")
    found = filter_audit.audit(spark, f"{folder}/docs", labels, batches=6, folder=f"{folder}/work")
    expected = brute_audit(docs, LABELS)
    assert rows_of(found) == expected and found.count() == len(expected)
    assert spark.read.parquet(f"{folder}/work/counters").where("n < 0").count() > 0      # there were retractions
    # the audit goes on where it stopped: only the new file is read, and a smaller id revises the earlier ones
    more = [(1, VARIED[0], "en"), (2, VARIED[4], "it")]
    spark.createDataFrame([(*d, 1, "k") for d in more], schema).coalesce(1).write.mode("append").parquet(f"{folder}/docs")
    again = filter_audit.audit(spark, f"{folder}/docs", labels, batches=6, folder=f"{folder}/work")
    assert rows_of(again) == brute_audit(docs + more, LABELS)


def test_audit_of_an_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="audit-")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{folder}/docs")
    assert filter_audit.audit(spark, f"{folder}/docs", spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
