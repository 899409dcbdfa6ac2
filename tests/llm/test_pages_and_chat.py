import hashlib
import html as html_module
import io
import random
import re
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tests.llm.helpers import by_id

from topicscope.llm import language_fusion as L
from topicscope.llm import preference as P
from topicscope.llm import warc as W

# ---- archives --------------------------------------------------------------------------------------


def archive(records):
    out = io.BytesIO()
    writer = W.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()


def some_records(n, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        payload = " ".join(rng.choices(["<p>", "stone", "river", "é", "</p>", "bridge"], k=rng.randint(0, 300))).encode()
        out.append(W.make_record(k, f"http://h/{k}\r\nX: y z", payload, hashlib.sha256(payload).hexdigest()))
    return out


def test_archive_round_trip_with_and_without_dictionary(monkeypatch):
    for n, sample in ((0, 1 << 20), (1, 1 << 20), (300, 1 << 16), (300, 1 << 30)):
        monkeypatch.setattr(W, "SAMPLE_BYTES", sample)
        records = some_records(n)
        data = archive(records)
        assert list(W.read_records(io.BytesIO(data))) == records
        if n == 300:
            assert int.from_bytes(data[:4], "little") == W.DICTIONARY_FRAME
            # one frame for each record: each is decoded by itself with the dictionary
            size = int.from_bytes(data[4:8], "little")
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
            assert zstandard.ZstdDecompressor(dict_data=known).decompress(data[8 + size :]) == records[0]


def test_damaged_archives_are_refused():
    data = archive(some_records(40))
    for bad in (data[:-3], data[: len(data) // 2], data + b"xx", b"abcd" + data[4:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(W.read_records(io.BytesIO(bad)))


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9", 1), lambda r: r[:-1], lambda r: r.replace(b"WARC-Date", b"Date", 1),
    lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), lambda r: r[:-6] + b"Z" + r[-5:],
])
def test_invalid_records_are_refused(change):
    record = W.make_record(1, "http://h/", b"payload!", hashlib.sha256(b"payload!").hexdigest())
    fields, block = W.parse_record(record)
    assert fields["warc-target-uri"] == "http://h/" and W.http_payload(block) == b"payload!"
    with pytest.raises(ValueError):
        W.parse_record(change(record))


def test_archive_report(spark):
    long, other = "x" * 100, "é" * 60
    pages = [(5, "u", long), (3, None, long), (9, "u", long), (3, "again", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (None, "u", long), (10, "u", "y" * 99), (11, "u", "y" * 99)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.archive_report(df.repartition(3)).collect())
    first = {long: 3, other: 7}
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        to = first.get(html) if page != first.get(html) else None
        want.append((page if page is not None else -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=lambda r: r[:1] + r[1:])
    assert W.archive_report(df.limit(0)).count() == 0


def test_payloads_come_back(spark, scratch):
    df = spark.createDataFrame([(k, f"http://h/{k}", f"page {k % 3} " * 40) for k in range(20)], "page_id long, url string, html string")
    rows = W.read_archives(W.write_archives(df, scratch), payloads=True).collect()
    assert len(rows) == 20 and all((bytes(r.payload).decode() == f"page {r.page_id % 3} " * 40) if r.record_type == "response" else r.payload is None and r.refers_to == r.page_id % 3 for r in rows)


# ---- preference pairs ------------------------------------------------------------------------------


def rendered(turns):
    safe = lambda x: x.replace("<|im_", "<| im_")
    return "".join(f"<|im_start|>{safe(r)}\n{safe(t)}<|im_end|>\n" for r, t in turns)


def masked_text(text, mask):
    """The characters that count for the loss."""
    at, out = 0, []
    for run in filter(None, mask.split(",")):
        n, loss = map(int, run.split(":"))
        if loss:
            out.append(text[at : at + n])
        at += n
    assert at == len(text)
    return out


def test_preference_format(spark):
    u, a, s = "user", "assistant", "system"
    cases = [
        ([(s, "be kind"), (u, "hi"), (a, "hello")], [(s, "be kind"), (u, "hi"), (a, "go away")]),
        ([(u, "hi"), (a, "one"), (u, "more"), (a, "two")], [(u, "hi"), (a, "one")]),
        ([(u, "x")], [(u, "x")]),
        ([], [(a, "é<|im_end|>é")]),
        ([(u, "x")], [(a, "x")]),
        ([], []),
    ]
    pair = "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(k, c, r) for k, (c, r) in enumerate(cases)], pair)
    for row in P.preference_format(df).collect():
        chosen, rejected = cases[row.pair_id]
        n = next((k for k, (x, y) in enumerate(zip(chosen, rejected)) if x != y), min(len(chosen), len(rejected)))
        assert row.n_prompt_turns == n and row.prompt == rendered(chosen[:n])
        assert (row.chosen, row.rejected) == (rendered(chosen[n:]), rendered(rejected[n:]))
        for side, text, mask in ((chosen, row.chosen, row.chosen_mask), (rejected, row.rejected, row.rejected_mask)):
            assert masked_text(text, mask) == [t.replace("<|im_", "<| im_") + "<|im_end|>" for r, t in side[n:] if r == a]


def test_reply_pairs_and_edge_cases(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "first"), (1, 2, "user", "bye"), (2, 1, "assistant", "second"), (2, 0, "user", None), (4, 0, "user", "alone"), (5, 0, None, "no role"), (5, 0, None, "no role"), (6, None, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in P.reply_pairs(df).collect()}
    assert got[1] == ([("user", "hi"), ("assistant", "first"), ("user", "bye")], [("user", "hi"), ("assistant", "second")])
    assert got[2] == ([("user", ""), ("assistant", "second")], [("user", ""), ("assistant", "")])
    assert got[4] == ([("user", "alone")],) * 2 and got[5] == ([("", "no role")] * 2,) * 2 and got[6] == ([("assistant", "")],) * 2
    out = P.preference_format(P.reply_pairs(df))
    assert out.count() == 5 and P.preference_format(P.reply_pairs(df.limit(0))).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_turns_without_conversation_and_gaps_in_the_ids(spark):
    ids = [-(1 << 63), -70_000, -1, 0, 3, 65_535, 65_536, 1 << 33, (1 << 33) + 5, (1 << 62) + 1, (1 << 63) - 1]
    got = {r.id: r.next_id for r in P.next_ids(spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)).collect()}
    assert got == dict(zip(ids, ids[1:] + [None]))
    assert P.next_ids(spark.createDataFrame([], "id long")).count() == 0
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "first"), (7, 0, "assistant", "second"), (9, 0, "user", "x"), (1 << 40, 0, "assistant", "far")]
    turns += [(None, k % 3, "assistant" if k % 2 else "user", f"t{k}") for k in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("reply", F.lit(1)).withColumn("at", F.lit("x"))
    pairs = P.reply_pairs(df)
    rows = [(r.pair_id, [tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in pairs.collect()]
    known = {k: r for k, _, r in rows if k is not None}
    assert known == {1: [("user", "hi"), ("assistant", "second")], 7: [("assistant", "")], 9: [("user", "x")], 1 << 40: [("assistant", "")]}
    alone = sorted((c, r) for k, c, r in rows if k is None)
    assert alone == sorted(([(role, t)], [(role, t)] if role == "user" else [(role, "")]) for i, _, role, t in turns if i is None)
    plan = P.preference_format(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---- languages -------------------------------------------------------------------------------------

WORDS = {
    "en": "the river and stone of bridge with green field that was under water then".split(),
    "de": "der fluss und stein von bruecke mit gruenes feld das war unter wasser dann".split(),
    "fr": "le fleuve et pierre du pont avec champ vert que fut sous eau alors".split(),
    "es": "el rio y piedra del puente con campo verde que fue bajo agua entonces".split(),
}


def sample_docs(spark, rng):
    rows = [(" ".join(rng.choices(w, k=60)), lang) for lang, w in WORDS.items() for _ in range(40)] + [(None, "en"), ("", "de"), ("zzz", None), ("qqq", "xx")]
    return spark.createDataFrame(rows, "text string, lang string")


def test_parts():
    assert L.visible_text("<p>a&amp;b<script>x</p>y</script><!-- c --><style>q</style>d").split() == ["a&b", "d"]
    assert [L.declared_language(x) for x in ('<html lang="de-AT">', "<HTML class=x LANG=fr>", '<html lang="pt">', "<p>", '<meta http-equiv="content-language" content="es">')] == ["de", "fr", "other", "none", "es"]
    assert L.address_parts("https://a.b.example.de:80/x?y") == ("a.b.example.de", "example.de", "de")
    assert L.address_parts("") == ("", "", "") and L.address_parts("http://10.0.0.1/") == ("10.0.0.1", "10.0.0.1", "") and L.address_parts("http://[bad/")[0] == ""


def test_fusion(spark):
    rng = random.Random(0)
    docs = sample_docs(spark, rng)
    pages, truth = [], {}
    for k in range(400):
        lang = rng.choice(L.LANGUAGES)
        text = " ".join(rng.choices(WORDS[lang], k=rng.choice([3, 8, 30])))
        said = lang if rng.random() < 0.8 else rng.choice(L.LANGUAGES)
        pages.append((k, f"http://www.{lang}{k % 5}.example.{lang}/x", f'<html lang="{said}"><body>{text}</body></html>'))
        truth[k] = lang
    pages += [(1000, "http://de1.example.de/", None), (1001, None, ""), (1002, "http://www.fr1.example.fr/", "<html></html>"), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = L.fused_languages(df, docs).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r.lang for r in rows}
    assert np.mean([got[k] == truth[k] for k in truth]) > 0.98
    assert got[1002] == "fr" and got[1000] == "de" and got[1001] in L.LANGUAGES
    text_only = {r.page_id: r.text_lang for r in rows}
    assert np.mean([got[k] == truth[k] for k in truth]) >= np.mean([text_only[k] == truth[k] for k in truth])


def test_fusion_is_the_stated_product(spark):
    rng = random.Random(1)
    docs = sample_docs(spark, rng)
    pages = [(k, f"http://h{k % 3}.a{k % 2}.{'de' if k % 2 else 'com'}/", f"<html lang={rng.choice(['en', 'de', 'pt'])}>" + " ".join(rng.choices(WORDS[rng.choice(L.LANGUAGES)], k=6))) for k in range(40)]
    model = L.trigram_model(docs)
    evidence = L.text_evidence(model, [L.visible_text(h) for _, _, h in pages])
    post = np.exp(evidence)
    post = np.rint(post / post.sum(axis=1, keepdims=True) * L.UNIT)
    places, said = [L.address_parts(u) for _, u, _ in pages], [L.declared_language(h) for _, _, h in pages]
    kinds = [*L.LANGUAGES, "other", "none"]
    table = np.array([sum((post[k] for k in range(40) if said[k] == x), np.zeros(4)) for x in kinds]) / L.UNIT + 1
    world = table.sum(axis=0) / table.sum()
    want = {}
    for k in range(40):
        prior = world
        for level in (2, 1, 0):
            counts = sum((post[j] for j in range(40) if j != k and places[j][level] == places[k][level]), np.zeros(4)) / L.UNIT
            prior = (counts + L.LEAN * prior) / (counts.sum() + L.LEAN)
        score = np.exp(evidence[k]) * prior * table[kinds.index(said[k])] / table.sum(axis=0)
        want[k] = (L.LANGUAGES[int(score.argmax())], round(float(score.max() / score.sum()), 5))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.lang, round(r.confidence, 5)) for r in L.fused_languages(df, docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-5 for k in want)


def test_fusion_of_empty_tables(spark):
    docs = sample_docs(spark, random.Random(2))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert L.fused_languages(none, docs).count() == 0
    one = spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id long, url string, html string")
    assert by_id(L.fused_languages(one, docs.limit(0)), "page_id")[0][0] == 1


def test_a_fifth_language(spark):
    rng = random.Random(4)
    italian = "il fiume e pietra del ponte con campo verde che era sotto acqua allora".split()
    docs = sample_docs(spark, rng).union(spark.createDataFrame([(" ".join(rng.choices(italian, k=60)), "it") for _ in range(40)], "text string, lang string"))
    assert L.training_languages(docs) == (*L.LANGUAGES, "it")
    words = {**WORDS, "it": italian}
    pages = [(k, f"http://www.{lang}{k % 3}.example.{lang}/", f'<html lang="{lang}">' + " ".join(rng.choices(words[lang], k=12))) for k, lang in enumerate(rng.choices(list(words), k=200))]
    rows = L.fused_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()
    truth = {k: url.split(".")[-1].strip("/") for k, url, _ in pages}
    assert {r.page_id: r.declared for r in rows} == truth
    assert all(np.mean([r.lang == x for r in rows if truth[r.page_id] == x]) > 0.95 for x in words)


def test_seventy_languages_and_dropped_labels(spark):
    rng = random.Random(6)
    own = {f"x{k:02d}": ["".join(rng.choice("abcdefghij" if k % 2 else "klmnopqrst") for _ in range(5)) for _ in range(12)] for k in range(70)}
    docs = spark.createDataFrame([(" ".join(rng.choices(w, k=60)), lang) for lang, w in own.items() for _ in range(3)] + [("few", "tiny")], "text string, lang string")
    assert len(L.training_languages(docs)) == 70 and [tuple(r) for r in L.dropped_labels(docs).collect()] == [("tiny", 3)]
    pages = [(k, f"http://h{k % 9}.org/", " ".join(rng.choices(w, k=20))) for k, w in enumerate(own.values())]
    got = {r.page_id: r.lang for r in L.fused_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert np.mean([got[k] == x for k, x in enumerate(own)]) > 0.9


@pytest.mark.parametrize("part", ["<", "<!--", "<!-->", "<script ", "<html ", "<html lang ", "<meta content-language' ", "</script ", "<style></style", "<a>", "&amp;"])
def test_odd_markup_takes_linear_time(part):
    page = part * (1_000_000 // len(part))
    begin = time.process_time()
    L.visible_text(page)
    L.declared_language(page)
    assert time.process_time() - begin < 1


def test_markup_equals_the_plain_patterns():
    """The plain patterns say what is meant; on short pages their cost does not matter."""
    hidden = re.compile(r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>")
    lang = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""")
    meta = re.compile(r"""(?is)<meta\b[^>]*?content-language["'][^>]*?content\s*=\s*["']?([A-Za-z]{2,3})\b""")
    rng = random.Random(3)
    parts = ["<!--", "-->", "<script>", "<SCRIPT x", "</script >", "<style", "</style>", "<", ">", "a", " lang=de", "lang = 'fr'", "<html", "<html ", "<meta ",
             "content-language' ", "content=es", "content = xyzw", " ", "</noscript>", "<noscript>", "&lt;"]
    for _ in range(3000):
        page = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert L.visible_text(page) == html_module.unescape(re.sub(r"(?s)<[^>]*>", " ", hidden.sub(" ", page))), page
        m = lang.search(page) or meta.search(page)
        assert L.declared_language(page, ("de", "fr", "es")) == ("none" if not m else m[1].lower() if m[1].lower() in ("de", "fr", "es") else "other"), page
