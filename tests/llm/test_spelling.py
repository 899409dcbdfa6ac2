"""Spelling variants against a brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from topicscope.llm import spelling_variants as sv

from .helpers import EDGE_TEXTS, docs_table


def plain_words(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def fixture_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(6, 16))) for _ in range(60)] + ["x" * 7, "y" * 200, "ab" * 70, "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    words = list(base)
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            words += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ×") + w[k:], w[:k] + rng.choice("abcÀ") + w[k + 1 :]]
    text = lambda: " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, k=80))
    rows = [(k, t) for k, t in enumerate(EDGE_TEXTS)] + [(50 + k, text()) for k in range(60)]
    rows.append((203, "internationalesq " * 2 + "internationales " * 40 + "internationale " * 900))  # a chain of forms
    return rows + [(None, rows[20][1]), (50, rows[12][1]), (50, rows[12][1])]


def test_equals_brute_force(spark):
    rows = fixture_rows()
    got, want = result(sv.spelling_variants(docs_table(spark, rows, extra=True))), plain_variants(rows)
    assert got == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want) and max(len(r[0]) for r in want) > 100


def test_edits_at_every_place_of_long_words(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abc") for _ in range(size)) for size in (7, 8, 31, 33, 65, 200)]
    words = {"q" * k for k in (4000, 4001, 4002)} | {"q" * 4000 + "r", "s" * 40}
    for w in bases:
        size = len(w)
        words |= {w} | {w[:k] + w[k + 1 :] for k in range(size)} | {w[:k] + c + w[k:] for k in range(size + 1) for c in "az"} | {w[:k] + "z" + w[k + 1 :] for k in range(size)}
    words = [x for x in words if len(x) >= 7]
    folder = sv.scratch_path(spark, f"t-{rng.random()}")
    pairs = sv.near_words(spark.createDataFrame([(x, 2) for x in words], "word string, n long"), folder).collect()
    for w in [*bases, "q" * 4001, "q" * 4000 + "r"]:
        assert {r.near for r in pairs if r.word == w} == {x for x in words if one_edit(w, x)}


def test_no_words(spark):
    assert sv.spelling_variants(docs_table(spark, [])).count() == 0
    assert sv.spelling_variants(docs_table(spark, [(1, None), (2, "short words only")])).count() == 0


def test_partial_sums_are_bounded(spark, monkeypatch):
    rows = fixture_rows()
    monkeypatch.setattr(sv, "HELD", 10)
    got = list(sv._count_words(docs_table(spark, rows).select("doc_id", "text").toArrow().to_batches()))
    assert len(got) > 5 and max(b.num_rows for b in got) < 400


@pytest.mark.parametrize("doc_id", [None, 7, -3])
def test_words_of_a_text(doc_id):
    text = " ".join(EDGE_TEXTS[1:]) + " Überraschung ÜBERRASCHUNG ×÷×÷×÷×÷ straßenbahn"
    count = Counter()
    for w, n in sv.text_words(doc_id, text + " " + text).items():
        count[w] += n
    assert {w: n for w, n in count.items() if n > 1} == plain_words([(doc_id, text + " " + text)])
