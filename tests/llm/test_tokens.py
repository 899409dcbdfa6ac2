import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyarrow import BufferReader
from tests.llm.helpers import EDGE_TEXTS, docs_table
from tokenizers import Tokenizer

from topicscope.llm import byte_bpe, token_files, word_transducer
from topicscope.llm.spans import HashIndex, runs, text_groups

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list("aabcdest's're'll'ving  \n\n\t.,!?'\"12é中文字ßÄÉ́  \x1c\x85　😀ſ٣Ⅷ²İΣσÅ") + ["<|endoftext|>", "<|startoftext|>", "<|"]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)] + [t or "" for t in EDGE_TEXTS]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def plain():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(library):
    texts = random_texts(3000)
    tokenizer = word_transducer.WordTokenizer.of(WORDS)
    got = np.concatenate([tokenizer.counts(texts[lo:hi]) for lo, hi in text_groups(texts)])
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_maps_compose_to_the_sequential_run():
    word_transducer.class_table()
    rng = np.random.default_rng(1)
    step, emit = word_transducer.cutting_table()
    for n in (1, 2, 7, 8, 9, 700):
        classes = rng.integers(0, 10, n).astype(np.int16)
        want, state = [], 0
        for c in classes:
            want.append(emit[state, c])
            state = step[state, c]
        for chunk in (1, 4, 16, 512):
            assert word_transducer.emissions(classes, chunk).tolist() == want


def test_word_ids_are_the_librarys(library):
    texts = random_texts(1500, 2)
    lengths, ids = token_files.LibraryIds.of(WORDS).encode(texts, 1)
    ends = np.cumsum(lengths)
    for t, b, e in zip(texts, ends - lengths, ends):
        assert ids[b:e].tolist() == library.encode(t, add_special_tokens=False).ids + [1]


def test_words_and_caches_start_anew(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 50)
    monkeypatch.setattr(word_transducer, "MOST_TRANSITIONS", 40)
    tokenizer = word_transducer.WordTokenizer(WORDS)
    texts = random_texts(200, 3)
    got = [int(tokenizer.counts([t])[0]) for t in texts]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("kind", range(5))
def test_simple8b_round_trip(kind):
    rng = np.random.default_rng(kind)
    for n in (0, 1, 2, 239, 240, 241, 1023, 1024, 1025, 5000):
        values = [
            rng.integers(0, 49408, n), np.zeros(n), rng.integers(0, 2, n), 1 << rng.integers(0, 63, n), (1 << 62) + rng.integers(0, 9, n),
        ][kind].astype(np.uint64)
        if kind == 4 and n:
            values[0] = np.uint64((1 << 64) - 1)
        words, sizes = token_files.pack(values)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = np.minimum(np.arange(len(sizes) + 1) * token_files.BLOCK, n)
        if n:
            assert (token_files.unpack(words, first, ids) == values).all()


def test_token_file_blocks_and_damage():
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out)
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 900, 40)
    ids = rng.integers(0, 49408, lengths.sum())
    at = 0
    for lo in range(0, 40, 7):
        n = lengths[lo : lo + 7]
        writer.add([None if k == 3 else k for k in range(lo, lo + len(n))], n, ids[at : at + n.sum()])
        at += n.sum()
    assert writer.close() == (40, len(ids))
    data = out.getvalue()
    reader = token_files.TokenFileReader(BufferReader(data))
    assert reader.doc_ids == [None if k == 3 else k for k in range(40)] and reader.lengths.tolist() == lengths.tolist()
    assert np.concatenate(list(reader.checked_blocks())).tolist() == ids.tolist()
    _, some = reader.blocks(3, 5)
    assert some.tolist() == ids[3 * token_files.BLOCK : 5 * token_files.BLOCK].tolist()
    with pytest.raises(ValueError):
        token_files.TokenFileReader(BufferReader(data[:-1]))
    bad = bytearray(data)
    bad[40] ^= 1
    with pytest.raises(ValueError):
        list(token_files.TokenFileReader(BufferReader(bytes(bad))).checked_blocks())


def test_prefix_encoder_appends_and_edits():
    ranks = byte_bpe.read_ranks(RANKS)
    trees = byte_bpe.MergeTrees(ranks)
    rng = random.Random(4)
    for _ in range(150):
        data = "".join(rng.choices("abcdeth ing", k=80)).encode()
        encoder = byte_bpe.PrefixEncoder(trees)
        for k in range(0, 80, 9):
            encoder.append(data[k : k + 9])
            assert encoder.tokens() == byte_bpe.merge_by_rank(data[: k + 9], ranks)
        i = rng.randint(0, 80)
        j = rng.randint(i, min(80, i + 5))
        new = "".join(rng.choices("abcxing", k=rng.randint(0, 6))).encode()
        encoder.edit(i, j, new)
        whole = byte_bpe.PrefixEncoder(trees)
        whole.append(data[:i] + new + data[j:])
        assert (encoder.data, encoder.last) == (whole.data, whole.last)


def test_reports_on_edge_cases(spark, library, plain):
    rows = [(k, t) for k, t in enumerate(EDGE_TEXTS + random_texts(50, 6))]
    rows += [rows[4], (None, "no id")]
    df = docs_table(spark, rows, extra=True).repartition(3)
    counts = {(r.doc_id, r.n_tokens, r.n_bytes, r.over_limit) for r in word_transducer.token_counts(df, WORDS, 1000).collect()}
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    assert counts == {(d, len(ids[t]), len((t or "").encode()), len(ids[t]) > 1000) for d, t in rows}

    got = [tuple(r) for r in token_files.token_file_report(df, WORDS).collect()]
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = np.array(ids[t] + [1], "<u4")
        want.append((d, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(got, key=lambda r: r[1]) == want

    got = {tuple(r) for r in byte_bpe.round_trip_report(df, RANKS).collect()}
    want = set()
    for d, t in rows:
        own = plain.encode_ordinary(t or "")
        want.add((d, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(df, RANKS), RANKS)
    assert sorted((r.doc_id or -1, bytes(r.data)) for r in back.collect()) == sorted((d or -1, (t or "").encode()) for d, t in rows)


def test_empty_tables(spark):
    empty = docs_table(spark, [])
    assert word_transducer.token_counts(empty, WORDS).count() == 0
    assert token_files.token_file_report(empty, WORDS).count() == 0
    assert byte_bpe.round_trip_report(empty, RANKS).count() == 0


def test_hash_index_and_runs():
    rng = np.random.default_rng(0)
    index = HashIndex(4)
    keys = np.unique(rng.integers(1, 1 << 63, 20000).astype(np.uint64))
    for part in np.array_split(rng.permutation(keys), 9):
        assert (index.find(part) == -1).all()
        index.add(part)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    begins, ends = runs(np.array([1, 1, 0, 1, 1, 1], bool), np.array([0, 4, 4, 6]))
    assert (begins.tolist(), ends.tolist()) == ([0, 3, 4], [2, 4, 6])
