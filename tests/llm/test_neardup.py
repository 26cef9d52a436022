import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphgrid.llm import neardup
from tests.llm.conftest import words


def brute(rows):
    """Groups by comparing all pairs of signatures."""
    own = [(i, t) for i, t, _ in rows if i is not None and t is not None]
    sigs, there = neardup.signatures([t for _, t in own])
    ids = [i for i, _ in own]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if there[a] and there[b] and (sigs[a] != sigs[b]).sum() <= neardup.RADIUS:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    members = defaultdict(set)
    for i in ids:
        members[find(i)].add(i)
    return {i: g for g, m in members.items() if len(m) > 1 for i in m}


def brute_pairs(rows):
    """{(least doc_id, least doc_id): distance} of the classes within the radius, and the documents of each class."""
    own = [(i, t) for i, t, _ in rows if i is not None and t is not None]
    sigs, there = neardup.signatures([t for _, t in own])
    classes = defaultdict(list)
    for (i, _), s, ok in zip(own, sigs, there):
        if ok:
            classes[s.tobytes()].append(i)
    kinds = sorted(classes)
    x = np.array([np.frombuffer(k, np.uint16) for k in kinds]).reshape(-1, neardup.K)
    out = Counter()
    for a in range(len(kinds)):
        for b in range(a):
            d = int((x[a] != x[b]).sum())
            if d <= neardup.RADIUS:
                out[(*sorted((min(classes[kinds[a]]), min(classes[kinds[b]]))), d)] += 1
    return out, list(classes.values())


def found(docs, **options):
    return {r["doc_id"]: (r["group_id"], r["keep"]) for r in neardup.groups(docs, **options).collect()}


def mutated(seed=1, sizes=(1, 2, 3, 40)):
    rng, rows = random.Random(seed), []
    for _ in range(12):
        base = words(rng, rng.randrange(30, 400))
        for _ in range(rng.choice(sizes)):
            w = [rng.choice(words(rng, 1)) if rng.random() < 0.03 else x for x in base]
            rows.append((len(rows), " ".join(w), "a"))
    rows += [(1000 + i, " ".join(words(rng, 60)), "a") for i in range(60)]
    rows += [(2000 + i, rows[0][1].upper(), "a") for i in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [neardup.TILE, 7])
def test_every_pair_comes_out_once_with_its_distance(make_docs, tile):
    rows = mutated()
    want, classes = brute_pairs(rows)
    got = Counter(tuple(r) for r in neardup.pairs(make_docs(rows), tile=tile).collect())
    assert got == want and len(want) > 300
    links = Counter()
    for a, b, _ in want.elements():
        links[a] += 1
        links[b] += 1
    own = {i: (min(c), len(c), links[min(c)]) for c in classes for i in c if len(c) > 1 or links[min(c)]}
    rows_ = neardup.groups(make_docs(rows), tile=tile).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_rows"], r["n_links"]) for r in rows_} == own
    assert {r["doc_id"]: r["group_id"] for r in rows_} == brute(rows)


def test_pairs_with_one_key_among_strangers(make_docs):
    """A hot key whose members aren't near: no pair is lost and none is invented."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 16, (60, neardup.K)).astype(np.uint16)
    x[:, :5] = 7
    x[1] = x[0]
    x[1, 40:60] ^= 1
    starts = np.array([0])
    got = {(int(i), int(j)) for i, j, _ in (p for y in neardup.near_pairs(x, starts, np.zeros(60, int), neardup.RADIUS) for p in zip(*y))}
    assert got == {(0, 1)}


def test_drop_keeps_rows_without_a_signature(make_docs):
    """Null and blank texts stay under repeated and dropped ids; a visible text is never lost to a blank one."""
    rng = random.Random(7)
    a, b, c = (" ".join(words(rng, 50)) for _ in range(3))
    rows = [(1, a, "s"), (2, a, "s"), (2, None, "s"), (2, "  ", "s"), (5, b, "s"), (5, c, "s"), (5, " \n ", "s"), (5, None, "s"), (6, "\x1c\t", "s"), (None, a, "s"), (7, "\u3000", "s"), (8, "\x00", "s")]
    got = Counter((r["doc_id"], r["text"]) for r in neardup.drop_near(make_docs(rows)).collect())
    assert got == Counter([(1, a), (2, None), (2, "  "), (5, min(b, c)), (5, " \n "), (5, None), (6, "\x1c\t"), (None, a), (7, "\u3000"), (8, "\x00")])


def brute_drop(rows):
    group = brute(rows)
    stay, best = Counter(), {}
    _, there = neardup.signatures([t for _, t, _ in rows])
    for (i, t, _), seen in zip(rows, there):
        if i is None or t is None or not seen:
            stay[i, t] += 1
        elif group.get(i, i) == i:
            best[i] = min(best.get(i, t), t, key=lambda x: x.encode())
    return stay + Counter(best.items())


def test_drop_against_a_plain_run_on_repeated_blank_and_null_rows(make_docs):
    rng = random.Random(9)
    base = [" ".join(words(rng, 40)) for _ in range(12)]
    texts = [*base, *[t + " tail" for t in base], None, "", " ", "\t", "!!", "x"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), "s") for _ in range(220)]
    got = Counter((r["doc_id"], r["text"]) for r in neardup.drop_near(make_docs(rows)).collect())
    assert got == brute_drop(rows)


def test_groups_are_those_of_all_pairs(make_docs):
    rows = mutated()
    want = brute(rows)
    got = found(make_docs(rows))
    assert {i: g for i, (g, _) in got.items()} == want
    assert all(keep == (i == g) for i, (g, keep) in got.items())
    assert not any(1000 <= i < 2000 for i in got)


def test_case_and_punctuation_do_not_matter_and_short_copies_are_found(make_docs):
    got = found(make_docs([(1, "One two, three!", "a"), (2, "one TWO three", "a"), (3, "Ünder", "a"), (4, "ünder.", "a"), (5, "four", "a")]))
    assert {i: g for i, (g, _) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, neardup.RADIUS))
def test_every_pair_within_the_radius_shares_a_key(seed, apart):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 16, neardup.K).astype(np.uint16)
    b = a.copy()
    b[rng.choice(neardup.K, apart, replace=False)] ^= 1
    keys = neardup.masked_keys(np.stack([a, b]))
    assert (keys[0] == keys[1]).any()


def test_components_are_exact():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(0, 3, (40, 8)).astype(np.uint16)
        got = neardup.components(x, 3)
        near = (x[:, None] != x[None]).sum(2) <= 3
        reach = np.linalg.matrix_power(near.astype(float), 40) > 0
        want = np.array([np.flatnonzero(r)[0] for r in reach])
        assert (got == want).all()


def test_connected_on_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in neardup.connected(pairs).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_edges(edge, empty, edge_rows):
    want = brute(edge_rows)
    assert {i: g for i, (g, _) in found(edge).items()} == want
    assert want[2] == 1 and want[7] == 6 and 8 not in want
    kept = neardup.drop_near(edge)
    assert kept.columns == edge.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    gone = {2, 7}
    want_rows = [(i, t) for i, t, _ in edge_rows if i not in gone | {8, 10}] + [(8, edge_rows[9][1]), (10, min(edge_rows[12][1], edge_rows[13][1], key=lambda t: t.encode()))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(rows, key=key) == sorted(want_rows, key=key)
    assert found(empty) == {} and neardup.drop_near(empty).count() == 0
