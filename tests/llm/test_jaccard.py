import random
import re

import numpy as np
import pytest
from tests.llm.helpers import EDGE_TEXTS, by_id, docs_table

from topicscope.llm import jaccard_forest as J
from topicscope.llm.components import component_labels


def brute(rows, similarity=0.8):
    """class_id, copy_id, n_copies, n_links, n_text_links of each row by comparing all pairs of texts."""
    words = {t: tuple(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in rows}
    members = {}
    for d, t in rows:
        if words[t]:
            members.setdefault(words[t], []).append(d)
    sets = {w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in members}
    texts = list(members)
    links = {w: set() for w in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both / (len(sets[a]) + len(sets[b]) - both) >= similarity - 1e-12:
                links[a].add(b)
                links[b].add(a)
    least = {}
    for w in texts:
        seen, todo = {w}, [w]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        least[w] = min(d for x in seen for d in members[x])
    out = []
    for d, t in rows:
        w = words[t]
        if not w:
            out.append((d, d, d, 1, 0, 0))
        else:
            others = len(members[w]) - 1 + sum(len(members[x]) for x in links[w])
            out.append((d, least[w], min(members[w]), len(members[w]), others, len(links[w])))
    return sorted(out, key=repr)


def near_copies(n_groups, copies, words=60, edits=2, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    texts = []
    for _ in range(n_groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(words)] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


def test_groups_links_and_edge_cases(spark):
    texts = near_copies(12, 6) + near_copies(1, 40, edits=1, seed=1) + EDGE_TEXTS
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", ", ")]
    rows = list(enumerate(texts))
    got = J.jaccard_classes(docs_table(spark, rows, extra=True).repartition(4))
    assert by_id(got) == brute(rows)


def test_crowded_nodes_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    rows = list(enumerate(near_copies(1, 60, words=80, edits=2, seed=2) + near_copies(3, 4, seed=3)))
    assert by_id(J.jaccard_classes(docs_table(spark, rows))) == brute(rows)


def test_long_texts_make_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_WORDS", 300)
    rows = list(enumerate(near_copies(1, 25, words=80, edits=2, seed=5)))
    assert by_id(J.jaccard_classes(docs_table(spark, rows))) == brute(rows)


def test_shortening_finds_what_long_prefixes_miss(spark):
    texts = near_copies(60, 2, words=50, edits=1, seed=4)
    rows = list(enumerate(texts))
    got = J.jaccard_classes(docs_table(spark, rows))
    assert by_id(got) == brute(rows)
    assert J.meeting_chance(np.float64(0.8), J.PREFIXES[0]) < J.meeting_chance(np.float64(0.8), J.PREFIXES[-1])


def test_shortening_goes_on_until_the_target(spark, monkeypatch):
    """With few trees long prefixes miss links; the estimate notices and the rounds go on."""
    monkeypatch.setattr(J, "TREES", 6)
    monkeypatch.setattr(J, "_MULT", J._MULT[:, : 6 * J.DEPTH])
    rows = list(enumerate(near_copies(80, 2, words=60, edits=1, seed=7)))
    got = by_id(J.jaccard_classes(docs_table(spark, rows)))
    want = brute(rows)
    found, true = sum(r[5] for r in got), sum(r[5] for r in want)
    assert found >= 0.97 * true
    alone = by_id(J.jaccard_classes(docs_table(spark, rows), target_recall=0.1))     # ends after the first round
    assert sum(r[5] for r in alone) <= found


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    got = by_id(J.jaccard_classes(docs_table(spark, [(3, text), (3, text), (None, text), (None, "only null ids here")])))
    assert [r[:4] for r in got if r[0] == 3] == [(3, 3, 3, 3)] * 2
    assert {r[1] for r in got if r[0] is None} == {3, None}


def brute_shared_ids(rows):
    """``brute`` for ids that are null or shared: classes by row number, then the least id of their rows."""
    numbered = {r[0]: r for r in brute([(k, t) for k, (_, t) in enumerate(rows)])}

    def least(k, column):
        if not re.findall(r"[^\W_]+", rows[k][1] or ""):
            return rows[k][0]
        return min((rows[x][0] for x, r in numbered.items() if r[column] == numbered[k][column] and rows[x][0] is not None), default=None)

    return sorted(((rows[k][0], least(k, 1), least(k, 2), *r[3:]) for k, r in numbered.items()), key=repr)


def test_near_copies_beside_repeated_and_null_ids(spark):
    a, b, c, d, e, f = (t for g in range(3) for t in near_copies(1, 2, words=60, edits=1, seed=20 + g))
    assert len({a, b, c, d, e, f}) == 6
    rows = [(3, a), (3, a), (5, b)]                     # repeated rows beside a near copy
    rows += [(None, c), (None, c), (None, d)]           # no row of the class has an id
    rows += [(None, e), (9, f), (9, "other words under the same id")] + [(9, f"hot id {k}") for k in range(20)]
    rows += [(None, None), (None, ""), (7, " "), (7, " ")]
    got = by_id(J.jaccard_classes(docs_table(spark, rows).repartition(3)))
    assert got == brute_shared_ids(rows)
    assert {r[3:] for r in got if r[0] in (3, 5)} == {(2, 2, 1), (1, 2, 1)}


def test_every_class_has_one_first_row(spark):
    a, b = near_copies(1, 2, words=60, edits=1, seed=20)
    rows = [(3, a), (3, a), (3, b), (None, a), (None, "alone"), (None, None), (4, "")]
    keyed = J.with_row_keys(docs_table(spark, rows).repartition(3))
    got = J.keyed_classes(keyed).collect()
    assert len({r.row_key for r in got}) == len(rows)
    assert sorted(str(r.doc_id) for r in got if r.row_key == r.class_key) == ["3", "4", "None", "None"]


def test_empty(spark):
    assert J.jaccard_classes(docs_table(spark, [])).count() == 0


def test_every_pair_belongs_to_one_cell():
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, (40, J.TREES, J.DEPTH)).astype(np.uint32)
    block = np.zeros(40, int)
    seen = np.zeros((40, 40), int)
    for before, prefix in ((None, 5), (5, 3), (3, 2)):
        for tree in range(J.TREES):
            keys = [label[k, tree, :prefix].tobytes() for k in range(40)]
            for key in set(keys):
                at = np.array([k for k in range(40) if keys[k] == key])
                own = J._pairs_that_meet(label[at], block[at], 0, 0, tree, prefix, before)
                seen[np.ix_(at, at)] += own
    meets = np.array([[(label[i, :, :2] == label[j, :, :2]).all(axis=1).any() and i != j for j in range(40)] for i in range(40)])
    assert (seen == meets).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, scratch, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    least = {}
    for x in list(parent):
        least[find(x)] = min(least.get(find(x), x), x)
    got = component_labels(spark.createDataFrame(edges, "a long, b long"), scratch)
    assert {r.a: r.label for r in got.collect()} == {x: least[find(x)] for x in list(parent)}
