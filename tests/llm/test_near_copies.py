"""Near copies in families of several generations: the exact way against brute force, and the recall of the default one."""

import random

import pytest

from hydroseries.llm import simhash


def families(seed):
    """A large family and smaller ones whose templates are like each other, but less than 0.8; copies of copies in each."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(2000)]

    def edit(text, k):
        text = list(text)
        for _ in range(k):
            text[rng.randrange(len(text))] = rng.choice(words)
        return text

    base, docs = rng.choices(words, k=200), []
    for family, size in ((0, 260), (1, 90), (2, 40), (3, 10)):
        made = [edit(base, 8 * family)]
        for _ in range(size):
            made.append(edit(rng.choice(made[: 1 + size // 10]), rng.choice([1, 2, 3, 5, 7])))
        docs += made
    rng.shuffle(docs)
    return [" ".join(d) for d in docs] + [" ".join(rng.choices(words, k=40)) for _ in range(30)]


def kept_by_brute_force(docs, similarity=0.8):
    sets = [frozenset(simhash.shingle_hashes(d, 5).tolist()) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= similarity * (len(a) + len(sets[j]) - shared) - 1e-9:
                links += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in range(len(docs))}, links


@pytest.fixture(scope="module")
def made():
    docs = families(4)
    return docs, *kept_by_brute_force(docs)


@pytest.mark.parametrize("nearest,passes", [(None, 1), (None, 3), (simhash.NEAREST, simhash.PASSES)])
def test_recall_on_families(spark, make, made, monkeypatch, nearest, passes):
    monkeypatch.setattr(simhash, "PASSES", passes)
    docs, want, links = made
    rows = make([(i, d, None, None) for i, d in enumerate(docs)])
    got = {r.doc_id for r in simhash.drop_near_copies(rows, nearest=nearest).select("doc_id").collect()}
    assert links > 1000 and 40 < len(want) < 300
    assert want <= got  # none is wrongly dropped
    assert len(got - want) <= (0.01 if nearest is None else 0.02) * (len(docs) - len(want))


def test_passes_share_out_the_tables():
    scheme = simhash.Sampled.at(0.8, 256, 5000)
    parts = scheme.passes(3)
    assert sorted(t for p in parts for t in p.chosen) == list(range(scheme.tables)) and len(scheme.passes(1000)) == scheme.tables
    import numpy as np

    lanes = np.random.default_rng(1).integers(1 << 62, size=(9, 4), dtype=np.uint64)
    assert np.array_equal(scheme.keys(lanes), np.concatenate([p.keys(lanes) for p in parts], 1))


def test_groups_of_fingerprints_against_brute_force(spark, make, made):
    """Banding and verification: a group never joins what links do not; links that are missed are few, and copies are together."""
    from hydroseries.llm import edit_embedding

    docs = made[0] + made[0][:20] + ["", ""]
    rows = edit_embedding.fingerprint(make([(i, d, None, None) for i, d in enumerate(docs)])).select("doc_id", "fingerprint")
    got = {r.doc_id: (r.fingerprint, r.near_group) for r in edit_embedding.near_groups(rows).collect()}
    assert len(got) == len(docs)
    prints = sorted({fp for fp, _ in got.values()})
    bits = [int(fp, 16) for fp in prints]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for i, a in enumerate(bits):
        for j in range(i):
            if (a ^ bits[j]).bit_count() <= 40:
                links.append((i, j))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {fp: prints[find(k)] for k, fp in enumerate(prints)}
    group = {}
    for fp, near in got.values():
        assert group.setdefault(fp, near) == near and near <= fp and want[near] == want[fp] and group.get(near, near) == near
    together = sum(group[prints[i]] == group[prints[j]] for i, j in links)
    assert len(links) > 300 and together >= 0.97 * len(links)
    assert len({near for near in group.values()}) <= 1.05 * len(set(want.values()))
    assert edit_embedding.near_groups(rows.limit(0)).count() == 0


def test_labels_take_further_links(spark):
    import random

    rng = random.Random(2)
    first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 15))
    frame = lambda pairs: spark.createDataFrame([(min(p), max(p)) for p in pairs if p[0] != p[1]], "a long, b long").distinct()
    told = {r.node: r.label for r in simhash.merged(simhash.components(frame(first)), frame(more)).collect()}
    assert told == {r.node: r.label for r in simhash.components(frame(first + more)).collect()}


def test_no_near_copy_is_missed(spark, make, monkeypatch):
    """Sets that have many likely but refused candidates: two candidates a table missed two links here. Small blocks, so that classes meet in several tasks."""
    monkeypatch.setattr(simhash, "BLOCK", 1 << 13)
    docs = families(6)
    want, _ = kept_by_brute_force(docs)
    kept = simhash.drop_near_copies(make([(i, d, None, None) for i, d in enumerate(docs)]))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want


def test_a_shard_gives_fewer_links_than_parts(spark):
    """A dense group, in which all fingerprints are near each other, gives a forest in each table, and nothing where it is one part already."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = np.repeat(rng.integers(1 << 62, size=(1, 4)), 300, 0)
    base[:, 0] ^= 1 << rng.integers(0, 60, 300)
    scheme = simhash.Sampled.at(0.8, 256, 300).growing(3)[0]
    for part, most in ((np.arange(300), 299), (np.arange(300) // 150, 1), (np.zeros(300, int), 0)):
        rows = spark.createDataFrame([(p, lanes) for p, lanes in zip(part.tolist(), base.tolist())], "part long, lanes array<long>")
        links = {(r.a, r.b) for r in simhash.part_links(rows, scheme).collect()}
        assert len(links) <= most * len(scheme.chosen)
        reached = {0}
        while more := {x for link in links if reached & set(link) for x in link} - reached:
            reached |= more
        assert reached == set(part.tolist())


def test_growing_tables():
    scheme = simhash.Sampled.at(0.8, 256, 5000)
    parts = scheme.growing(3)
    assert [t for p in parts for t in p.chosen] == list(range(scheme.tables)) and len(parts[0].chosen) < len(parts[1].chosen) < len(parts[2].chosen)
    assert [p.chosen for p in scheme.growing(1)] == [tuple(range(scheme.tables))]


def test_a_large_group_is_not_linked_in_every_band(spark, monkeypatch):
    """Near copies of one text meet in all bands: links are few a fingerprint, and all are in one group."""
    import random

    from hydroseries.llm import edit_embedding

    rng = random.Random(4)
    base = rng.getrandbits(256)
    prints = sorted({f"{base ^ sum(1 << b for b in rng.sample(range(256), 12)):064x}" for _ in range(600)})
    alone = [f"{rng.getrandbits(256):064x}" for _ in range(50)]
    rows = spark.createDataFrame([(i, fp) for i, fp in enumerate(prints + alone)], "doc_id long, fingerprint string")
    given, write = [], edit_embedding.write_shared

    def seen(df, name):
        out = write(df, name)
        given.extend([out.count()] if name == "near-pairs" else [])
        return out

    monkeypatch.setattr(edit_embedding, "write_shared", seen)
    got = {r.fingerprint: r.near_group for r in edit_embedding.near_groups(rows).collect()}
    assert got == {fp: prints[0] for fp in prints} | {fp: fp for fp in alone}
    assert sum(given) <= 4 * len(prints), given
