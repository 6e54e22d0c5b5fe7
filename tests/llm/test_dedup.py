"""Substring dedup, the Jaccard join and embedding near-dedup against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from lectern.llm.common import Scratch
from lectern.llm.embedding_dedup import VectorSpec, near_duplicates
from lectern.llm.jaccard_join import JoinSpec, _sketch, _sketch_room, keep_one, prefix_length, similar_components
from lectern.llm.substring_dedup import RepeatSpec, equal_classes, find_repeats, remove_repeats


def grouped(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def near_copies(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([4, 6, 30, 120]))] for _ in range(12)]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, (" " if i % 3 else "\n").join(text) if i % 5 else " ".join(text).upper()))
    return out


@pytest.mark.parametrize("spec", [JoinSpec(), JoinSpec(frequent_from=2, cost_unit=2, block=4, bitmap_bits=64, chunk_bytes=900), JoinSpec(frequent_from=2, small=2, block=3, bucket_rows=10, rounds=1, pairs_per_text=2)])
def test_jaccard_components(make, spec):
    rows = [*near_copies(), (100, None), (101, ""), (102, "one two"), (103, "ONE\ttwo"), (104, "one"), (0, near_copies()[0][1]), (105, " \n ")]

    def shingles(t):
        w = tuple((t or "").lower().split())
        return {w[j : j + 5] for j in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = grouped(sets, links)
    got = similar_components(make(rows), spec).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), expected[i]) for i, s in sets.items()}
    kept = keep_one(make(rows), spec)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == make(rows).columns


def test_jaccard_empty_and_null_ids(make):
    assert similar_components(make([])).count() == 0
    got = similar_components(make([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 2, None), (4, 2, 4), (None, 0, None)}
    assert keep_one(make([(None, "a"), (1, "b")])).count() == 2


def test_jaccard_moves_texts_of_pairs_only(make, monkeypatch):
    """Long texts that share a line, and so a list, but are no possible pairs stay where they are read."""
    save, moved = Scratch.save, []

    def counted(self, df, name):
        out = save(self, df, name)
        if "text" in out.columns:
            moved.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    rng = random.Random(5)
    texts = [" ".join(["a line that all texts share", *(f"{rng.getrandbits(400):0100x}" for _ in range(200))]) for _ in range(50)]
    rows = [*enumerate(texts), (500, texts[7] + " and more")]
    got = {r.doc_id: r.component_id for r in similar_components(make(rows)).collect()}
    assert got == {i: 7 if i == 500 else i for i, _ in rows}
    assert moved and max(moved) == 2


@pytest.mark.parametrize("bits", [1, 8])
def test_sketches_drop_no_similar_pair(bits):
    rng = np.random.default_rng(3)
    dropped = 0
    for n in (1, 5, 70, 3000, 20_000):
        for share in (0.5, 0.6, 0.75, 0.85, 0.86, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            same = x[: math.ceil(share * n)]
            y = np.unique(np.concatenate([same, rng.integers(0, 1 << 63, n - len(same) if n % 2 else 0, dtype=np.uint64)]))
            room = _sketch_room(_sketch(x, bits), _sketch(y, bits), len(x), len(y), 75)
            if 100 * len(same) >= 75 * (len(x) + len(y) - len(same)):
                assert room
            dropped += n == 20_000 and share <= 0.6 and not room
    assert bits == 1 or dropped == 2


def test_jaccard_of_long_texts_and_odd_columns(make):
    """Two texts of 120,000 words that differ in a few, beside rows with the same ids and a column with a dot in its name."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50_000, 120_000).astype(str)
    other = words.copy()
    other[rng.integers(0, len(words), 3_000)] = "edited"
    rows = [(5, " ".join(words)), (4, " ".join(other)), (3, " ".join(words[:60_000])), (9, "a few words stand here alone"), (9, "A few words stand here alone"), (9, "quite another text with this id")]
    docs = make(rows).selectExpr("*", "1 AS `a.b`")
    got = similar_components(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 4), (4, 4), (3, 3), (9, 9)} and len(got) == 6
    kept = keep_one(docs)
    # Both texts of document 9 that link with nothing else stay.
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 9, 9] and kept.columns == docs.columns


def test_prefix_length():
    assert prefix_length(100, 1, 75) == 26 and prefix_length(1, 1, 75) == 1 and prefix_length(4, 1, 75) == 2


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("spec", [RepeatSpec(length=30, gram=8), RepeatSpec(length=30, gram=8, max_segments=1, bucket_bytes=500, chunk_bytes=200), RepeatSpec(length=30, gram=8, max_segments=4, fine=(4, 2))])
def test_repeats(make, spec):
    rng = random.Random(3)
    part = lambda n, letters="abcdé ": "".join(rng.choice(letters) for _ in range(n))
    common = [part(80), part(45), part(31), part(29)]
    rows = [(i, part(rng.randrange(60)) + rng.choice(common) + part(rng.randrange(60)) + rng.choice(["", rng.choice(common)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "ab" * 60), (103, "x" * 29), (104, "x" * 30), (5, rows[5][1]), (105, part(4000, "xyz") * 2), (None, rows[6][1])]
    got = find_repeats(make(rows), spec).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(rows, spec.length)


def test_periodic_texts(make):
    """Series of like windows: a run of one letter, short and long periods, beside copies with other ends."""
    spec = RepeatSpec(length=30, gram=8)
    rng = random.Random(5)
    rows = [(1, "-" * 500), (2, "x" + "-" * 300 + "y"), (3, "ab" * 100 + "c"), (4, "".join(rng.choice("abcdef") for _ in range(41)) * 9), (5, "-" * 30), (6, "-" * 29), (7, "zab" + "ab" * 14), (8, "only " * 3)]
    got = find_repeats(make(rows), spec).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(rows, spec.length)
    long = find_repeats(make([(1, "-" * 5_000_000), (2, "=" * 199), (3, "q" * 200)])).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in long] == [(5_000_000, 5_000_000, 1), (199, 0, 0), (200, 0, 0)]


def test_crowded_passages(make):
    """One passage with a different beginning and end in each document, so that its outer anchors have very many segments."""
    spec = RepeatSpec(length=30, gram=8, max_segments=3, bucket_bytes=2_000)
    rng = random.Random(6)
    part = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    passage = part(70)
    rows = [(i, part(rng.randrange(40)) + passage + part(rng.randrange(40), "xy")) for i in range(120)] + [(500 + i, passage[20:20 + 31] + part(9)) for i in range(20)]
    got = find_repeats(make(rows), spec).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(rows, spec.length)


def test_repeats_removed(make):
    passage = "".join(chr(97 + (i * i) % 26) for i in range(250))
    rows = [(1, "start " + passage + " é end"), (2, passage), (3, "é" + passage), (4, None), (5, "short")]
    got = {r.doc_id: r.text for r in remove_repeats(make(rows)).collect()}
    assert got == {1: "start  é end", 3: "é", 4: None, 5: "short"}
    assert find_repeats(make([])).count() == 0 and remove_repeats(make([])).columns == make([]).columns


def test_equal_classes():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 100, 300).astype(np.uint8)
    data = np.concatenate([base, base[50:200], [255], base[100:250], [255]]).astype(np.uint8)
    for length in (3, 10, 40):
        found, seen, raw = equal_classes(data, length), {}, data.tobytes()
        for i in range(len(raw) - length):
            assert seen.setdefault(raw[i : i + length], found[i]) == found[i]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("spec", [VectorSpec(), VectorSpec(per_pivot=8, block=7)])
def test_vectors(spark, spec):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.25 * rng.normal(size=8)], int(i % 2)) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] + [1.0] * 7, 1), (203, [None] + [1.0] * 7, 1), (204, [float("inf")] * 8, 0), (205, rows[0][1], None), (206, rows[0][1], 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (3, rows[3][1], 1)]
    good = [(k, i, np.asarray(v, float), g) for k, (i, v, g) in enumerate(rows) if v is not None and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a, b in itertools.combinations(good, 2) if a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / (np.linalg.norm(a[2]) * np.linalg.norm(b[2])) >= 0.93]
    top = grouped([r[0] for r in rows], [(a[1], b[1]) for a, b in links])
    count = {k: 0 for k in range(len(rows))}
    for a, b in links:
        count[a[0]] += 1
        count[b[0]] += 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS copies").repartition(3)
    got = near_duplicates(df, spec).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, count[k], top[i], i == top[i]) for k, (i, _, _) in enumerate(rows))
    assert near_duplicates(df.limit(0), spec).count() == 0


def test_scaled_vectors(spark):
    """Scaled copies are classes of their own that point the same way, and so may be pivots."""
    base = np.random.default_rng(2).integers(-9, 10, (12, 64))
    rows = [(i, [float(x) for x in (i // 12 + 1) * base[i % 12]], 0) for i in range(180)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = near_duplicates(df, VectorSpec(per_pivot=4, block=50)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, 14, i % 12) for i in range(180)]


def test_double_vectors_and_text_labels(spark):
    """Cosines that only doubles tell apart from 0.93."""
    base = np.asarray([1.0, 0.0])
    rows = [(0, base.tolist(), "a")] + [(i, [0.93 + d, math.sqrt(1 - (0.93 + d) ** 2)], label) for i, (d, label) in enumerate([(1e-10, "a"), (-1e-10, "a"), (1e-10, "b")], 1)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 2, 0), (2, 1, 0), (3, 0, 3)]


def test_rows_of_one_vec_id_with_different_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (1, b, 1), (2, [1.0, 0.1, 0.0], 1), (3, [0.1, 1.0, 0.0], 1), (3, [0.1, 1.0, 0.0], 1), (4, [0.0, 0.0, 1.0], 1)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_noisy_copies_go_through_pivots(spark):
    from lectern.llm.embedding_dedup import cells_per_vector, with_noisy_copies

    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + r.normal(size=16) * 0.05).tolist(), 1) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    spec = VectorSpec(per_pivot=20, block=64)
    v = np.asarray([x[1] for x in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (unit @ unit.T >= spec.cosine).sum(axis=1) - 1
    got = {x.vec_id: x.n_links for x in near_duplicates(df, spec).collect()}
    assert [got[i] for i in range(600)] == links.tolist() and links.min() > 10
    cells = cells_per_vector(df, spec).first()
    assert cells.cells > 20 and cells.mean_cells < cells.cells / 4
    assert with_noisy_copies(df).count() == 3000 and cells_per_vector(df.limit(40), VectorSpec()).first().cells > 1


def test_scattered_vectors_meet_once_and_are_bounded(spark):
    """Vectors that point everywhere are in all cells, but only in those before their own; the bound leaves no pair out, whether it decides much or nothing."""
    from lectern.llm.embedding_dedup import cells_per_vector, linked_pairs

    r = np.random.default_rng(3)
    v = r.normal(size=(300, 32))
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>, label int")
    cells = cells_per_vector(df, VectorSpec(per_pivot=20)).first()
    assert cells.cells > 10 and cells.mean_cells < 0.6 * cells.cells + 1
    late = np.column_stack([np.zeros((300, 24)), r.normal(size=8) + 0.3 * r.normal(size=(300, 8))])
    for a, b in ((v, v + r.normal(size=v.shape) * r.uniform(0.2, 0.6, (300, 1))), (late, late[:200])):
        want = a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) >= 0.93
        got = sorted((int(x), int(y)) for i, j in linked_pairs(a, b, VectorSpec(bounded_rows=70, full_rows=9)) for x, y in zip(i, j, strict=True))
        assert got == [tuple(x) for x in np.argwhere(want).tolist()] and 0 < len(got) < want.size


def test_texts_of_one_doc_id_are_apart(spark, make):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(1, words("a")), (1, words("b")), (2, words("a") + " more"), (3, words("b") + " more"), (5, words("c")), (5, words("c") + " tail"), (5, words("d")), (7, words("d").upper()), (7, words("d"))]
    got = sorted((r.doc_id, r.component_id) for r in similar_components(make(rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 5), (5, 5), (5, 5), (7, 5), (7, 5)]
    kept = [sorted((r.doc_id, r.text) for r in keep_one(make(rows)).collect()) for _ in range(2)]
    assert kept[0] == kept[1] and len(kept[0]) == 4
    assert {(1, words("a")), (1, words("b")), (5, words("d"))} < set(kept[0])
    again = make([(4, words("x"))] * 3 + [(None, words("x"))])
    assert sorted(str(r.doc_id) for r in keep_one(again).collect()) == ["4", "None"]
